"""Projection, weights, degrees, rankings and graph metrics over the part graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.edges import candidate_id, candidate_targets, edge_rank, tier_name
from strandline.functions.paths import cost_ticks
from strandline.operators import graph as G
from strandline.plans import views as V
from strandline.session import written

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = V.registrar(QUERIES, SQL)


def _pairs(spark, sf):
    return G.pair_weights(G.project(V.part_edges(spark, sf)))


def _sparse(spark, sf, whole=False):
    return V.relations(spark, sf, whole).where("from_id <> to_id").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).distinct()


@query(V.sql("SELECT from_id, to_id, resolution, unnest(targets) AS target, CAST(len(targets) AS BIGINT) AS n_targets FROM targets", "targets"))
def candidate_targets_of_edges(spark: SparkSession, sf: str) -> DataFrame:
    t = candidate_targets(F.col("to_id"), F.array("alt1", "alt2"), F.col("resolution"))
    return V.part_edges(spark, sf).withColumn("t", t).select("from_id", "to_id", "resolution", F.explode("t").alias("target"), F.size("t").cast("long").alias("n_targets"))


@query(V.sql("SELECT from_id, target, relation, confidence, resolution, round(share, 9) AS share FROM projected", "projected"))
def candidate_projection(spark: SparkSession, sf: str) -> DataFrame:
    return G.project(V.part_edges(spark, sf)).select("from_id", "target", "relation", "confidence", "resolution", F.round("share", 9).alias("share"))


@query(V.sql("SELECT from_id, target, round(base_weight * share, 9) AS weight FROM projected", "projected"))
def edge_weight(spark: SparkSession, sf: str) -> DataFrame:
    return G.project(V.part_edges(spark, sf)).select("from_id", "target", F.round(F.col("base_weight") * F.col("share"), 9).alias("weight"))


@query(V.sql("SELECT from_id, to_id, CASE WHEN resolution = 'exact' AND confidence = 'static_certain' THEN 'certain' WHEN resolution IN ('exact', 'unique_name') THEN 'resolved' ELSE 'all' END AS tier FROM part_edges", "part_edges"))
def edge_tier(spark: SparkSession, sf: str) -> DataFrame:
    return V.part_edges(spark, sf).select("from_id", "to_id", tier_name(edge_rank(F.col("confidence"), F.col("resolution"))).alias("tier"))


@query("SELECT p_partkey AS id, 'b:' || substr(sha256(p_partkey || '|large_node'), 1, 16) AS candidate_id FROM part")
def candidate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), candidate_id(F.concat(F.col("p_partkey").cast("string"), F.lit("|large_node"))).alias("candidate_id"))


@query(V.sql("SELECT from_id, first_target, relation, ambiguous, key, count(*) AS multiplicity, min(l_orderkey) AS first_evidence FROM (SELECT *, targets[1] AS first_target, resolution = 'ambiguous' AS ambiguous, array_to_string(targets, ',') AS key FROM targets WHERE len(list_filter(targets, lambda x: x <> from_id)) > 0) t GROUP BY ALL", "targets").replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5"))
def edge_dedup(spark: SparkSession, sf: str) -> DataFrame:
    e = V.part_edges(spark, sf).withColumn("t", candidate_targets(F.col("to_id"), F.array("alt1", "alt2"), F.col("resolution")))
    real = e.where(F.exists("t", lambda x: x != F.col("from_id")))
    return real.groupBy("from_id", F.element_at("t", 1).alias("first_target"), "relation", (F.col("resolution") == "ambiguous").alias("ambiguous"), F.array_join("t", ",").alias("key")).agg(F.count("*").alias("multiplicity"), F.min("l_orderkey").alias("first_evidence"))


@query(V.sql("SELECT DISTINCT from_id AS src, target AS dst FROM projected WHERE from_id <> target AND from_id IN (SELECT p_partkey FROM part WHERE p_size >= 5) AND target IN (SELECT p_partkey FROM part WHERE p_size >= 5)", "projected"))
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    known = V.table(spark, sf, "part").where("p_size >= 5").select(F.col("p_partkey").alias("k"))
    e = G.project(V.part_edges(spark, sf)).where("from_id <> target").select(F.col("from_id").alias("src"), F.col("target").alias("dst")).distinct()
    return e.join(known, F.col("src") == F.col("k"), "left_semi").join(known, F.col("dst") == F.col("k"), "left_semi")


@query(V.sql("SELECT DISTINCT x.missing FROM (SELECT from_id AS missing FROM projected UNION ALL SELECT target FROM projected) x WHERE missing NOT IN (SELECT p_partkey FROM part WHERE p_size >= 5)", "projected"))
def dangling_edges(spark: SparkSession, sf: str) -> DataFrame:
    known = V.table(spark, sf, "part").where("p_size >= 5").select(F.col("p_partkey").alias("k"))
    ends = G.project(V.part_edges(spark, sf)).select(F.explode(F.array("from_id", "target")).alias("missing")).distinct()
    return ends.join(known, F.col("missing") == F.col("k"), "left_anti")


@query(V.sql("SELECT src, dst, round(weight, 9) AS weight FROM pairs", "pairs"))
def pair_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).withColumn("weight", F.round("weight", 9))


_DEGREES = "SELECT n.*, coalesce(i.c, 0) AS fan_in, coalesce(o.c, 0) AS fan_out, coalesce(i.w, 0.0::DOUBLE) AS weighted_fan_in, coalesce(o.w, 0.0::DOUBLE) AS weighted_fan_out FROM nodes n LEFT JOIN (SELECT dst, count(*) AS c, sum(weight) AS w FROM pairs GROUP BY 1) i ON i.dst = n.id LEFT JOIN (SELECT src, count(*) AS c, sum(weight) AS w FROM pairs GROUP BY 1) o ON o.src = n.id"


def _degrees(spark, sf):
    return G.degrees(_pairs(spark, sf), V.part_nodes(spark, sf))


@query(V.sql(f"SELECT id, fan_in, fan_out, round(weighted_fan_in, 6) AS weighted_fan_in, round(weighted_fan_out, 6) AS weighted_fan_out FROM ({_DEGREES}) d", "nodes", "pairs"))
def fan_in_out(spark: SparkSession, sf: str) -> DataFrame:
    return _degrees(spark, sf).select("id", "fan_in", "fan_out", F.round("weighted_fan_in", 6).alias("weighted_fan_in"), F.round("weighted_fan_out", 6).alias("weighted_fan_out"))


@query(V.sql("SELECT CAST(sum(token_cost) AS BIGINT) AS total_token_cost, sum(token_cost * CASE category WHEN 'vendored' THEN 0 WHEN 'generated' THEN 1 ELSE 10 END) / 10.0::DOUBLE AS total_effective_cost FROM nodes", "nodes"))
def cost_totals(spark: SparkSession, sf: str) -> DataFrame:
    return V.part_nodes(spark, sf).agg(F.sum("token_cost").alias("total_token_cost"), (F.sum(F.col("token_cost") * cost_ticks(F.col("category"))) / 10).alias("total_effective_cost"))


@query(V.sql("SELECT id, token_cost * CASE category WHEN 'vendored' THEN 0 WHEN 'generated' THEN 1 ELSE 10 END / 10.0::DOUBLE AS effective_cost FROM nodes", "nodes"))
def effective_cost(spark: SparkSession, sf: str) -> DataFrame:
    return V.part_nodes(spark, sf).select("id", (F.col("token_cost") * cost_ticks(F.col("category")) / 10).alias("effective_cost"))


_KEYS = ("fan_in", "fan_out", "weighted_fan_in", "weighted_fan_out")
_LONG = " UNION ALL ".join(f"SELECT id, package, category, '{k}' AS key, round(CAST({k} AS DOUBLE), 6) AS value FROM d" for k in _KEYS)


def _long(spark, sf):
    d = _degrees(spark, sf).select("id", "package", "category", *[F.round(F.col(k).cast("double"), 6).alias(k) for k in _KEYS])
    return d.unpivot(["id", "package", "category"], list(_KEYS), "key", "value")


@query(V.sql(f"SELECT key, rank, id, value FROM (SELECT key, id, value, row_number() OVER (PARTITION BY key ORDER BY value DESC, id) AS rank FROM (WITH d AS ({_DEGREES}) {_LONG}) x) y WHERE rank <= 10", "nodes", "pairs"))
def rankings(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("key").orderBy(F.desc("value"), "id")
    return _long(spark, sf).withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("key", F.col("rank").cast("long").alias("rank"), "id", "value")


@query(V.sql(f"SELECT category, key, rank, id, value FROM (SELECT category, key, id, value, row_number() OVER (PARTITION BY category, key ORDER BY value DESC, id) AS rank FROM (WITH d AS ({_DEGREES}) {_LONG}) x) y WHERE rank <= 10", "nodes", "pairs"))
def rankings_by_category(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("category", "key").orderBy(F.desc("value"), "id")
    return _long(spark, sf).withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("category", "key", F.col("rank").cast("long").alias("rank"), "id", "value")


@query(V.sql(f"SELECT id, fan_in FROM ({_DEGREES}) d ORDER BY fan_in DESC, kind, id LIMIT 10", "nodes", "pairs"))
def top_metric(spark: SparkSession, sf: str) -> DataFrame:
    """Ties keep the input's order: that of kinds, then of ids."""
    return _degrees(spark, sf).orderBy(F.desc("fan_in"), "kind", "id").limit(10).select("id", "fan_in")


@query(V.sql("SELECT package, name, n, first_seen FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY n DESC, first_seen, name) AS k FROM (SELECT a.p_brand AS package, b.p_type AS name, count(*) AS n, min(l_orderkey) AS first_seen FROM part_edges JOIN part a ON from_id = a.p_partkey JOIN part b ON to_id = b.p_partkey WHERE relation = 'CALLS' GROUP BY 1, 2) x) y WHERE k <= 20", "part_edges"))
def top_names_per_group(spark: SparkSession, sf: str) -> DataFrame:
    p = V.table(spark, sf, "part")
    e = V.part_edges(spark, sf).where("relation = 'CALLS'").join(p.select(F.col("p_partkey").alias("ka"), F.col("p_brand").alias("package")), F.col("from_id") == F.col("ka")).join(p.select(F.col("p_partkey").alias("kb"), F.col("p_type").alias("name")), F.col("to_id") == F.col("kb"))
    c = e.groupBy("package", "name").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_seen"))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("package").orderBy(F.desc("n"), "first_seen", "name"))).where("k <= 20").drop("k")


@query(V.sql(f"SELECT id, fan_in FROM ({_DEGREES}) d WHERE category = 'production' AND contains(lower(kind), 'e') ORDER BY fan_in DESC, id LIMIT 50 OFFSET 50", "nodes", "pairs"))
def node_page(spark: SparkSession, sf: str) -> DataFrame:
    d = _degrees(spark, sf).where((F.col("category") == "production") & F.contains(F.lower("kind"), F.lit("e")))
    return d.orderBy(F.desc("fan_in"), "id").offset(50).limit(50).select("id", "fan_in")


@query(V.sql("SELECT id, round(CASE WHEN hi = lo THEN 10.0::DOUBLE ELSE 10 + 40 * (sqrt(token_cost) - lo) / (hi - lo) END, 6) AS size FROM nodes, (SELECT min(sqrt(token_cost)) AS lo, max(sqrt(token_cost)) AS hi FROM nodes) m", "nodes"))
def node_sizes(spark: SparkSession, sf: str) -> DataFrame:
    n = V.part_nodes(spark, sf)
    m = n.agg(F.min(F.sqrt("token_cost")).alias("lo"), F.max(F.sqrt("token_cost")).alias("hi"))
    return n.join(F.broadcast(m)).select("id", F.round(F.when(F.col("hi") == F.col("lo"), 10.0).otherwise(10 + 40 * (F.sqrt("token_cost") - F.col("lo")) / (F.col("hi") - F.col("lo"))), 6).alias("size"))


@query(V.sql("SELECT id, neighbor, contribution FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY contribution DESC, neighbor) AS k FROM (SELECT id, neighbor, round(sum(w), 6) AS contribution FROM (SELECT from_id AS id, target AS neighbor, base_weight * share AS w FROM projected WHERE from_id <> target UNION ALL SELECT target, from_id, base_weight * share FROM projected WHERE from_id <> target) x GROUP BY 1, 2) y) z WHERE k <= 10", "projected"))
def neighbors(spark: SparkSession, sf: str) -> DataFrame:
    p = G.project(V.part_edges(spark, sf)).where("from_id <> target").withColumn("w", F.col("base_weight") * F.col("share"))
    both = p.select(F.explode(F.array(F.struct(F.col("from_id").alias("id"), F.col("target").alias("neighbor"), "w"), F.struct(F.col("target").alias("id"), F.col("from_id").alias("neighbor"), "w"))).alias("x")).select("x.*")
    s = both.groupBy("id", "neighbor").agg(F.round(F.sum("w"), 6).alias("contribution"))
    return s.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("contribution"), "neighbor"))).where("k <= 10").drop("k")


@query(V.sql("SELECT from_pkg, to_pkg, string_agg(relation || ':' || n, ',' ORDER BY n DESC, relation) AS relations FROM (SELECT a.p_brand AS from_pkg, b.p_brand AS to_pkg, relation, count(*) AS n FROM part_edges JOIN part a ON from_id = a.p_partkey JOIN part b ON to_id = b.p_partkey GROUP BY 1, 2, 3) x GROUP BY 1, 2", "part_edges"))
def pair_relation_tally(spark: SparkSession, sf: str) -> DataFrame:
    p = V.table(spark, sf, "part")
    e = V.part_edges(spark, sf).join(p.select(F.col("p_partkey").alias("ka"), F.col("p_brand").alias("from_pkg")), F.col("from_id") == F.col("ka")).join(p.select(F.col("p_partkey").alias("kb"), F.col("p_brand").alias("to_pkg")), F.col("to_id") == F.col("kb"))
    c = e.groupBy("from_pkg", "to_pkg", "relation").count()
    listed = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "relation")))
    return c.groupBy("from_pkg", "to_pkg").agg(listed.alias("l")).select("from_pkg", "to_pkg", F.array_join(F.transform("l", lambda x: F.concat(x["relation"], F.lit(":"), (-x["n"]).cast("string"))), ",").alias("relations"))


@query(V.sql("SELECT package, count(*) AS n FROM nodes GROUP BY 1 ORDER BY n DESC, package", "nodes"))
def layer_tally(spark: SparkSession, sf: str) -> DataFrame:
    return V.part_nodes(spark, sf).groupBy("package").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "package")


@query(V.sql("SELECT path FROM files WHERE contains(lower(path), 'api/src1') ORDER BY path <> 'app/api/src1/f21.py', path LIMIT 1", "files"))
def path_search(spark: SparkSession, sf: str) -> DataFrame:
    hit = V.files(spark, sf).where(F.contains(F.lower("path"), F.lit("api/src1")))
    return hit.agg(F.min_by("path", F.struct((F.col("path") != "app/api/src1/f21.py").alias("other"), "path")).alias("path"))


@query(V.sql("SELECT n.id, coalesce(sum(t.ticks), 0) / 10.0::DOUBLE AS hop_2_cost FROM nodes n LEFT JOIN (SELECT DISTINCT a AS id, b FROM (SELECT src AS a, dst AS b FROM u UNION SELECT x.src, y.dst FROM u x JOIN u y ON x.dst = y.src) h WHERE a <> b) h ON h.id = n.id LEFT JOIN (SELECT id, token_cost * CASE category WHEN 'vendored' THEN 0 WHEN 'generated' THEN 1 ELSE 10 END AS ticks FROM nodes) t ON t.id = h.b GROUP BY 1", "nodes", "sparse_pairs").replace("SELECT n.id, coalesce", ", u AS (SELECT src, dst FROM sparse_pairs UNION SELECT dst, src FROM sparse_pairs) SELECT n.id, coalesce", 1).replace(") , u AS", "), u AS"), whole=True)
def hop2_cost(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    n = V.part_nodes(spark, sf).withColumn("ticks", F.col("token_cost") * cost_ticks(F.col("category")))
    return G.two_hop_cost(_sparse(spark, sf, whole), n)


@query(V.sql("SELECT n.id, coalesce(min(r.dst), n.id) AS component FROM nodes n LEFT JOIN r ON r.src = n.id GROUP BY n.id", "nodes", "sparse_pairs", recursive="u AS (SELECT src, dst FROM sparse_pairs UNION SELECT dst, src FROM sparse_pairs), r AS (SELECT src, least(src, dst) AS dst FROM u UNION SELECT u.src, r.dst FROM u JOIN r ON u.dst = r.src WHERE r.dst < u.src)"), whole=True)
def connected_components(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    return G.components(_sparse(spark, sf, whole), V.part_nodes(spark, sf))


_REACH = "r AS (SELECT src, dst FROM sparse_pairs UNION SELECT r.src, e.dst FROM r JOIN sparse_pairs e ON r.dst = e.src)"
_SCC = "SELECT a.src AS id, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src"


@query(V.sql(_SCC, "sparse_pairs", recursive=_REACH), whole=True)
def scc(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    return G.strong_components(_sparse(spark, sf, whole))


@query(V.sql(f"SELECT component, count(DISTINCT id) AS members, count(*) AS internal_pairs FROM (SELECT s.component, s.id, e.dst FROM ({_SCC}) s JOIN sparse_pairs e ON e.src = s.id JOIN ({_SCC}) t ON t.id = e.dst AND t.component = s.component) x GROUP BY 1", "sparse_pairs", recursive=_REACH), whole=True)
def scc_metrics(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    e, s = _sparse(spark, sf, whole), G.strong_components(_sparse(spark, sf, whole))
    inside = e.join(s.select(F.col("id").alias("a"), "component"), F.col("src") == F.col("a")).join(s.select(F.col("id").alias("b"), F.col("component").alias("other")), F.col("dst") == F.col("b")).where("component = other")
    return inside.groupBy("component").agg(F.countDistinct("src").alias("members"), F.count("*").alias("internal_pairs"))


@query(V.sql(f"SELECT component, src, dst, k FROM (SELECT s.component, e.src, e.dst, row_number() OVER (PARTITION BY s.component ORDER BY p.weight, e.src, e.dst) AS k FROM ({_SCC}) s JOIN sparse_pairs e ON e.src = s.id JOIN ({_SCC}) t ON t.id = e.dst AND t.component = s.component JOIN (SELECT src, dst, round(weight, 9) AS weight FROM pairs) p ON p.src = e.src AND p.dst = e.dst) x WHERE k <= 10", "sparse_pairs", "pairs", recursive=_REACH), whole=True)
def scc_cut_candidates(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    e, s = _sparse(spark, sf, whole), G.strong_components(_sparse(spark, sf, whole))
    inside = e.join(s.select(F.col("id").alias("a"), "component"), F.col("src") == F.col("a")).join(s.select(F.col("id").alias("b"), F.col("component").alias("other")), F.col("dst") == F.col("b")).where("component = other").select("component", "src", "dst")
    w = inside.join(_pairs(spark, sf).withColumn("weight", F.round("weight", 9)), ["src", "dst"])
    return w.withColumn("k", F.row_number().over(Window.partitionBy("component").orderBy("weight", "src", "dst")).cast("long")).where("k <= 10").select("component", "src", "dst", "k")


_CLOSED = "SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM r WHERE dst % 3 = 0) AND id % 3 <> 0"


@query(V.sql(_CLOSED, "nodes", "sparse_pairs", recursive=_REACH), whole=True)
def closed_ancestry(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """Nodes that reach no open one (here: ids divisible by three) and are none."""
    n = V.part_nodes(spark, sf).select("id")
    back = _sparse(spark, sf, whole).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return n.join(G.reach(back, n.where("id % 3 = 0")), "id", "left_anti")


@query(V.sql("SELECT id, CASE WHEN id IN (SELECT id FROM t) THEN 'tested' WHEN id IN (SELECT id FROM p) THEN 'uncertain' ELSE 'untested' END AS test_reach FROM nodes", "nodes", "part_edges_sparse", recursive="t AS (SELECT id FROM nodes WHERE category = 'test' UNION SELECT e.to_id FROM t JOIN part_edges_sparse e ON e.from_id = t.id WHERE e.resolution IN ('exact', 'unique_name')), p AS (SELECT id FROM nodes WHERE category = 'test' UNION SELECT e.to_id FROM p JOIN part_edges_sparse e ON e.from_id = p.id)"), whole=True)
def reach_status(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    n = V.part_nodes(spark, sf)
    known = F.col("resolution").isin("exact", "unique_name")
    e = written(V.relations(spark, sf, whole).groupBy(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).agg(F.max(known).alias("known")), "relations")
    tests = n.where("category = 'test'").select("id")
    sure = G.reach(e.where("known"), tests).select("id", F.lit(1).alias("sure"))
    may = G.reach(e, tests).select("id", F.lit(1).alias("may"))
    return n.select("id").join(sure, "id", "left").join(may, "id", "left").select("id", F.when(F.col("sure") == 1, "tested").when(F.col("may") == 1, "uncertain").otherwise("untested").alias("test_reach"))


@query(V.sql("SELECT id, round(score, 9) AS pagerank FROM r WHERE i = 10", "nodes", "pairs", "sparse_pairs", recursive="pp AS (SELECT p.* FROM pairs p JOIN sparse_pairs s ON p.src = s.src AND p.dst = s.dst), " + V.pagerank_sql(10)), whole=None)
def pagerank_k(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    if whole:  # every pair, to the operator's own tolerance
        return G.pagerank(_pairs(spark, sf), V.part_nodes(spark, sf)).select("id", F.round("score", 9).alias("pagerank"))
    e = _pairs(spark, sf).join(_sparse(spark, sf), ["src", "dst"])
    return G.pagerank(e, V.part_nodes(spark, sf), iterations=10, tolerance=None).select("id", F.round("score", 9).alias("pagerank"))



@query(None)
def betweenness_exact(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: enumerating all paths is too much for it; tests compare with another algorithm."""
    e = V.nation_edges(spark, sf).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    return G.betweenness(e, V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"))).select("id", F.round("betweenness", 9).alias("betweenness"))


@query(None, whole=None)
def betweenness_sampled(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    if whole:  # every pair, sampled as the operator does by itself
        return G.betweenness(_sparse(spark, sf, True), V.part_nodes(spark, sf).select("id")).select("id", F.round("betweenness", 9).alias("betweenness"))
    return G.betweenness(_sparse(spark, sf), V.part_nodes(spark, sf).select("id"), exact_up_to=10, sample=20).select("id", F.round("betweenness", 9).alias("betweenness"))


@query(V.sql("SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n FROM nodes) x WHERE r IN (SELECT i * n // 100 FROM range(100) t(i))", "nodes"))
def sample_sources(spark: SparkSession, sf: str) -> DataFrame:
    return G.sample_sources(V.part_nodes(spark, sf).select("id"), 100)


@query(V.sql("SELECT 'relation' AS what, relation AS name, count(*) AS n FROM part_edges GROUP BY 2 UNION ALL SELECT 'confidence', confidence, count(*) FROM part_edges GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*) FROM nodes GROUP BY 2", "part_edges", "nodes"))
def graph_histograms(spark: SparkSession, sf: str) -> DataFrame:
    e = V.part_edges(spark, sf).select(F.explode(F.array(F.struct(F.lit("relation").alias("what"), F.col("relation").alias("name")), F.struct(F.lit("confidence").alias("what"), F.col("confidence").alias("name")))).alias("x")).select("x.*")
    return e.unionByName(V.part_nodes(spark, sf).select(F.lit("kind").alias("what"), F.col("kind").alias("name"))).groupBy("what", "name").agg(F.count("*").alias("n"))
