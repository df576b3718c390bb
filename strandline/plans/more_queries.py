"""Ownership, documents, visibility and further changes over the same views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.operators import candidates as C
from strandline.operators import graph as G
from strandline.operators import structure as S
from strandline.operators.coverage import coverage
from strandline.plans import views as V
from strandline.session import written
from strandline.sources.migrations import table_references

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = V.registrar(QUERIES, SQL)


def _sparse(spark, sf, whole=False):
    return V.relations(spark, sf, whole).where("from_id <> to_id").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).distinct()


_REACH = "r AS (SELECT src, dst FROM sparse_pairs UNION SELECT r.src, e.dst FROM r JOIN sparse_pairs e ON r.dst = e.src)"
_SCC = "SELECT a.src AS id, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src"


@query(V.sql("SELECT from_id, to_id, relation FROM part_edges e JOIN nodes a ON a.id = from_id JOIN nodes b ON b.id = to_id WHERE relation = 'READS' OR (relation IN ('CALLS', 'IMPORTS') AND a.category = 'production' AND b.category = 'production' AND a.package = b.package)", "part_edges", "nodes"))
def ownership_edges(spark: SparkSession, sf: str) -> DataFrame:
    """One relation always owns; two others only between production nodes of one package."""
    n = V.part_nodes(spark, sf).select("id", "category", "package")
    e = V.part_edges(spark, sf).join(n.toDF("ia", "ca", "pa"), F.col("from_id") == F.col("ia")).join(n.toDF("ib", "cb", "pb"), F.col("to_id") == F.col("ib"))
    inner = F.col("relation").isin("CALLS", "IMPORTS") & (F.col("ca") == "production") & (F.col("cb") == "production") & (F.col("pa") == F.col("pb"))
    return e.where((F.col("relation") == "READS") | inner).select("from_id", "to_id", "relation")


@query(V.sql("SELECT n.id AS node, f.path AS file FROM nodes n LEFT JOIN files f ON f.doc_id = n.id", "nodes", "files"))
def node_files(spark: SparkSession, sf: str) -> DataFrame:
    f = V.files(spark, sf).select("doc_id", F.col("path").alias("file"))
    return V.part_nodes(spark, sf).join(f, F.col("id") == F.col("doc_id"), "left").select(F.col("id").alias("node"), "file")


@query(V.sql("SELECT package, count(*) AS nodes, CAST(sum(token_cost) AS BIGINT) AS token_cost, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM nodes GROUP BY 1", "nodes"))
def file_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return V.part_nodes(spark, sf).groupBy("package").agg(F.count("*").alias("nodes"), F.sum("token_cost").alias("token_cost"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"))


@query("SELECT conv_id, string_agg(DISTINCT name, ',' ORDER BY name) AS imports FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS name FROM conversations) x GROUP BY 1")
def external_imports(spark: SparkSession, sf: str) -> DataFrame:
    names = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0)))
    return V.table(spark, sf, "conversations").select("conv_id", names.alias("name")).groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("imports"))


_MODULES = "SELECT DISTINCT regexp_replace(replace(regexp_replace(path, '\\.py$', ''), '/', '.'), '\\.__init__$', '') AS module FROM files WHERE path LIKE '%.py'"


@query(V.sql(f"SELECT DISTINCT array_to_string(list_slice(p, a, b), '.') AS name FROM (SELECT string_split(module, '.') AS p FROM ({_MODULES}) m) x, range(1, 6) s(a), range(1, 6) t(b) WHERE a <= b AND b <= len(p) AND array_to_string(list_slice(p, 1, a - 1), '.') NOT IN ('app', 'vendor.lib')", "files"))
def internal_module(spark: SparkSession, sf: str) -> DataFrame:
    """Dotted sub-ranges of project modules whose prefix is no package itself."""
    m = V.files(spark, sf).where(F.col("path").endswith(".py")).select(F.split(T.module_name(F.col("path")), r"\.").alias("p")).distinct()
    a = m.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("a"))
    packages = spark.createDataFrame([("app",), ("vendor.lib",)], "k string")
    free = a.withColumn("prefix", F.array_join(F.slice("p", F.lit(1), F.col("a") - 1), ".")).join(F.broadcast(packages), F.col("prefix") == F.col("k"), "left_anti")
    return free.select(F.explode(F.transform(F.sequence("a", F.size("p")), lambda b: F.array_join(F.slice("p", F.col("a"), b - F.col("a") + 1), "."))).alias("name")).distinct()


@query("SELECT conv_id, turn, CASE WHEN starts_with(name, '_') OR role IN ('private', 'protected', 'internal') THEN 'private' ELSE 'public' END AS visibility FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '_' || role ELSE role END AS name, CASE WHEN turn % 3 = 0 THEN 'private' ELSE role END AS role FROM conversations) x")
def visibility(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("_"), F.col("role"))).otherwise(F.col("role"))
    prefix = F.when(F.col("turn") % 3 == 0, F.lit("  private  static")).otherwise(F.col("role"))
    return V.table(spark, sf, "conversations").select("conv_id", "turn", T.visibility(name, prefix).alias("visibility"))


_LINKS = "SELECT page_id AS doc, regexp_extract(href, '^([^?#]*)', 1) AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS href FROM pages) x"
_INVENTORY = "SELECT DISTINCT '/' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 3 = 0 THEN '.md' WHEN doc_id % 3 = 1 THEN '/README.md' ELSE '' END AS path FROM documents UNION SELECT DISTINCT regexp_extract(href, '^([^?#]*)', 1) FROM (SELECT unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS href FROM pages WHERE page_id % 2 = 0) y"


def _links(spark, sf):
    h = F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1)))
    return V.table(spark, sf, "pages").select(F.col("page_id").alias("doc"), h.alias("href")).select("doc", F.regexp_extract("href", "^([^?#]*)", 1).alias("target"))


def _resolved_links(spark, sf):
    """Each link tries its target as it is, then with five endings; the first that the inventory holds counts."""
    d = F.col("doc_id")
    made = V.table(spark, sf, "documents").select(F.concat(F.lit("/"), d.cast("string"), F.when(d % 3 == 0, ".md").when(d % 3 == 1, "/README.md").otherwise("")).alias("path"))
    have = made.unionByName(_links(spark, sf).where("doc % 2 = 0").select(F.col("target").alias("path"))).distinct()
    endings = F.array(*[F.lit(x) for x in ("", ".md", ".mdx", "/README.md", "/index.md", "/index.mdx")])
    links = written(_links(spark, sf).groupBy("doc", "target").agg(F.count("*").alias("n")), "links")
    tries = links.select("target").distinct().select("target", F.posexplode(endings).alias("k", "ending")).withColumn("try", F.concat("target", "ending"))
    hit = tries.join(have, F.col("try") == F.col("path")).groupBy(F.col("target").alias("t")).agg(F.min_by("path", "k").alias("path"))
    return links.join(hit, F.col("target") == F.col("t"), "left").select("doc", "target", "n", "path", F.when(F.col("path").isNull(), "dangling").otherwise("resolved").alias("status"))


_RESOLVED = f"SELECT l.doc, l.target, l.n, h.path, CASE WHEN h.path IS NULL THEN 'dangling' ELSE 'resolved' END AS status FROM (SELECT doc, target, count(*) AS n FROM ({_LINKS}) q GROUP BY 1, 2) l LEFT JOIN (SELECT target, arg_min(path, k) AS path FROM (SELECT DISTINCT target FROM ({_LINKS}) z) t JOIN (SELECT * FROM (VALUES (0, ''), (1, '.md'), (2, '.mdx'), (3, '/README.md'), (4, '/index.md'), (5, '/index.mdx')) v(k, e)) e ON true JOIN ({_INVENTORY}) i ON i.path = target || e GROUP BY 1) h ON h.target = l.target"


@query(_RESOLVED)
def doc_links(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved_links(spark, sf)


@query(f"SELECT status, CAST(sum(n) AS BIGINT) AS links FROM ({_RESOLVED}) x GROUP BY 1")
def doc_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved_links(spark, sf).groupBy("status").agg(F.sum("n").alias("links"))


@query(f"SELECT doc, count(*) AS dangling_count FROM ({_RESOLVED}) x WHERE status = 'dangling' GROUP BY 1")
def dangling_docs(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved_links(spark, sf).where("status = 'dangling'").groupBy("doc").agg(F.count("*").alias("dangling_count"))


_SUFFIXES = "SELECT DISTINCT id, array_to_string(list_slice(p, a, len(p)), '.') AS name FROM (SELECT doc_id AS id, string_split(replace(path, '/', '.'), '.') AS p FROM files) x, range(1, 8) t(a) WHERE a <= len(p)"


@query(V.sql(f"SELECT name, CASE WHEN k = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, k AS candidates, first FROM (SELECT name, count(*) AS k, min(id) AS first FROM ({_SUFFIXES}) s GROUP BY 1) y WHERE name IN (SELECT 'f' || page_id || '.py' FROM pages UNION SELECT 'py')", "files"))
def doc_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers in texts against every dotted suffix of the symbols' paths."""
    p = F.split(F.translate("path", "/", "."), r"\.")
    s = V.files(spark, sf).select(F.col("doc_id").alias("id"), F.explode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda a: F.array_join(F.slice(p, a, F.size(p)), "."))).alias("name")).distinct()
    asked = V.table(spark, sf, "pages").select(F.concat(F.lit("f"), F.col("page_id").cast("string"), F.lit(".py")).alias("a")).unionByName(spark.createDataFrame([("py",)], "a string")).distinct()
    found = s.join(asked, F.col("name") == F.col("a"), "left_semi").groupBy("name").agg(F.count("*").alias("candidates"), F.min("id").alias("first"))
    return found.select("name", F.when(F.col("candidates") == 1, "resolved").otherwise("ambiguous").alias("status"), "candidates", "first")


@query(V.sql(f"SELECT s.component, CASE WHEN count(DISTINCT t.component) > 0 THEN min(t.component) END AS parent FROM ({_SCC.replace('r a', 'q a').replace('r b', 'q b')}) s LEFT JOIN ({_SCC}) t ON t.id = s.id GROUP BY 1", "part_edges_sparse", "sparse_pairs", recursive=_REACH + ", q AS (SELECT DISTINCT from_id AS src, to_id AS dst FROM part_edges_sparse WHERE from_id <> to_id AND resolution <> 'unresolved' UNION SELECT q.src, e.to_id FROM q JOIN part_edges_sparse e ON q.dst = e.from_id WHERE e.from_id <> e.to_id AND resolution <> 'unresolved')"), whole=True)
def scc_parent(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """Components of the stricter graph in those of the whole one: one member decides, as components nest."""
    strict = V.relations(spark, sf, whole).where("from_id <> to_id and resolution <> 'unresolved'").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).distinct()
    inner = written(G.strong_components(strict), "inner").groupBy("component").agg(F.min("id").alias("member"))
    outer = G.strong_components(_sparse(spark, sf, whole)).select(F.col("id").alias("k"), F.col("component").alias("parent"))
    return inner.join(outer, F.col("member") == F.col("k"), "left").select("component", "parent")


_PKG = "p AS (SELECT DISTINCT a.p_type AS src, b.p_type AS dst FROM part_edges_sparse JOIN part a ON a.p_partkey = from_id JOIN part b ON b.p_partkey = to_id WHERE a.p_type <> b.p_type AND resolution = 'exact' AND confidence = 'static_certain'), r AS (SELECT src, dst FROM p UNION SELECT r.src, p.dst FROM r JOIN p ON r.dst = p.src)"


@query(V.sql("SELECT a.src AS id, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src", "part_edges_sparse", recursive=_PKG), whole=True)
def package_cycle(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    p = V.table(spark, sf, "part")
    e = V.relations(spark, sf, whole).where("resolution = 'exact' and confidence = 'static_certain'").join(p.select(F.col("p_partkey").alias("ka"), F.col("p_type").alias("src")), F.col("from_id") == F.col("ka")).join(p.select(F.col("p_partkey").alias("kb"), F.col("p_type").alias("dst")), F.col("to_id") == F.col("kb"))
    return G.strong_components(e.where("src <> dst").select("src", "dst").distinct())


@query(V.sql(f"SELECT component, members FROM (SELECT component, count(*) AS members FROM ({_SCC}) s GROUP BY 1) x ORDER BY members DESC, component LIMIT 20", "sparse_pairs", recursive=_REACH), whole=True)
def cycle_list(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    return G.strong_components(_sparse(spark, sf, whole)).groupBy("component").agg(F.count("*").alias("members")).orderBy(F.desc("members"), "component").limit(20)


@query(V.sql(f"SELECT 'dependency_cycle' AS kind, id AS target FROM ({_SCC}) s UNION ALL SELECT 'large_node', id FROM nodes WHERE line_count > 45", "sparse_pairs", "nodes", recursive=_REACH), whole=True)
def finding_targets(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """Cycles are about their members, other findings about their target."""
    c = G.strong_components(_sparse(spark, sf, whole)).groupBy("component").agg(F.collect_list("id").alias("members")).select(F.lit("dependency_cycle").alias("kind"), F.col("component").alias("target"), "members")
    n = V.part_nodes(spark, sf).where("line_count > 45").select(F.lit("large_node").alias("kind"), F.col("id").alias("target"), F.lit(None).cast("array<bigint>").alias("members"))
    return c.unionByName(n).select("kind", F.explode(F.when(F.col("kind") == "dependency_cycle", F.col("members")).otherwise(F.array("target"))).alias("target"))


@query(V.sql("SELECT n.id, CASE WHEN count(DISTINCT o.file) = 1 THEN min(o.file) END AS file FROM nodes n LEFT JOIN o ON o.id = n.id GROUP BY 1", "nodes", "sparse_pairs", recursive="o AS (SELECT id, package AS file FROM nodes WHERE id % 5 = 0 UNION SELECT e.dst, o.file FROM o JOIN sparse_pairs e ON e.src = o.id WHERE e.dst % 5 <> 0)"), whole=True)
def owner_propagation(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """Nodes without a file take it from what owns them, as long as it is one: labels run along pairs to a fixpoint."""
    n, e = V.part_nodes(spark, sf), written(_sparse(spark, sf, whole).where("dst % 5 <> 0"), "own")
    labels = frontier = written(n.where("id % 5 = 0").select("id", F.col("package").alias("file")), "own")
    while True:
        new = frontier.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), "file").distinct().join(labels, ["id", "file"], "left_anti")
        frontier = written(new, "own")
        if frontier.isEmpty():
            break
        labels = written(labels.unionByName(frontier), "own")
    one = labels.groupBy(F.col("id").alias("k")).agg(F.countDistinct("file").alias("n"), F.min("file").alias("f"))
    return n.join(one, F.col("id") == F.col("k"), "left").select("id", F.when(F.col("n") == 1, F.col("f")).alias("file"))


@query(V.sql("SELECT id, min(d) AS depth FROM r GROUP BY 1", "sparse_pairs", "nodes", recursive="r AS (SELECT id, 0 AS d FROM nodes WHERE id % 10 = 0 UNION SELECT e.dst, r.d + 1 FROM r JOIN sparse_pairs e ON e.src = r.id WHERE r.d < 3)"), whole=None)
def prefix_propagation(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """First visits from the roots: all of them, or at most three inclusions deep in the sparse sample, as the SQL has it."""
    roots = V.part_nodes(spark, sf).where("id % 10 = 0")
    return G.first_visits(_sparse(spark, sf, whole), roots, None if whole else 3)


_CLOSURE = "r AS (SELECT from_pkg AS src, to_pkg AS dst FROM x UNION SELECT r.src, x.to_pkg FROM r JOIN x ON r.dst = x.from_pkg)"
_X = "x AS (SELECT DISTINCT p.p_brand AS from_pkg, q.p_brand AS to_pkg FROM part_edges_sparse JOIN part p ON p.p_partkey = from_id JOIN part q ON q.p_partkey = to_id WHERE relation = 'IMPORTS' AND p.p_brand <> q.p_brand AND q > 49)"


def _exports(spark, sf, whole=False):
    p = V.table(spark, sf, "part")
    e = V.relations(spark, sf, whole).where("relation = 'IMPORTS'" if whole else "relation = 'IMPORTS' and q > 49").join(p.select(F.col("p_partkey").alias("ka"), F.col("p_brand").alias("src")), F.col("from_id") == F.col("ka")).join(p.select(F.col("p_partkey").alias("kb"), F.col("p_brand").alias("dst")), F.col("to_id") == F.col("kb"))
    return e.where("src <> dst").select("src", "dst").distinct()


@query(V.sql("SELECT src, dst FROM r", "part_edges_sparse", recursive=_X.replace("AND q > 49", "AND part_edges_sparse.q > 49") + ", " + _CLOSURE), whole=(" AND part_edges_sparse.q > 49",))
def visibility_closure(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    return G.closure(_exports(spark, sf, whole))


@query(V.sql("SELECT DISTINCT c.p_brand AS consumer, d.p_brand AS provider FROM part_edges_sparse e JOIN part c ON c.p_partkey = from_id JOIN part d ON d.p_partkey = to_id WHERE relation = 'CALLS' AND c.p_brand <> d.p_brand AND NOT EXISTS (SELECT 1 FROM r WHERE r.src = c.p_brand AND r.dst = d.p_brand)", "part_edges_sparse", recursive=_X.replace("AND q > 49", "AND part_edges_sparse.q > 49") + ", " + _CLOSURE), whole=(" AND part_edges_sparse.q > 49",))
def unprovided_injection(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """Calls between packages whose target the caller's package does not see."""
    p = V.table(spark, sf, "part")
    used = V.relations(spark, sf, whole).where("relation = 'CALLS'").join(p.select(F.col("p_partkey").alias("ka"), F.col("p_brand").alias("consumer")), F.col("from_id") == F.col("ka")).join(p.select(F.col("p_partkey").alias("kb"), F.col("p_brand").alias("provider")), F.col("to_id") == F.col("kb")).where("consumer <> provider").select("consumer", "provider").distinct()
    seen = G.closure(_exports(spark, sf, whole))
    return used.join(seen, (F.col("consumer") == F.col("src")) & (F.col("provider") == F.col("dst")), "left_anti")


@query("SELECT m.page_id, m.name, coalesce(t.n, 0) AS tables, CASE WHEN t.n IS NULL THEN 'unmatched' WHEN t.n = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM (SELECT page_id, lower(split_part(split_part(url, '://', 2), '.', 1)) AS name FROM pages) m LEFT JOIN (SELECT lower(split_part(split_part(url, '://', 2), '.', 1)) AS name, count(DISTINCT split_part(split_part(url, '://', 2), '/', 1)) AS n FROM pages WHERE page_id % 3 = 0 GROUP BY 1) t ON t.name = m.name")
def migration_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Table names (first label of hosts) of all pages against the tables that every third page defines."""
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    m = V.table(spark, sf, "pages").select("page_id", T.normalize_table(F.concat(F.lit('"'), F.split_part(host, F.lit("."), F.lit(1)), F.lit('"'))).alias("name"), host.alias("host"))
    t = m.where("page_id % 3 = 0").groupBy(F.col("name").alias("k")).agg(F.countDistinct("host").alias("n"))
    return m.join(t, F.col("name") == F.col("k"), "left").select("page_id", "name", F.coalesce("n", F.lit(0)).alias("tables"), F.when(F.col("n").isNull(), "unmatched").when(F.col("n") == 1, "matched").otherwise("ambiguous").alias("status"))


@query("SELECT id, count(*) AS copies, count(DISTINCT h) AS versions FROM (SELECT doc_id % 100 AS id, sha256(text) AS h FROM documents) x GROUP BY 1")
def merge_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of one id from several analyzers: more than one version is a conflict."""
    return V.table(spark, sf, "documents").groupBy((F.col("doc_id") % 100).alias("id")).agg(F.count("*").alias("copies"), F.countDistinct(F.sha2("text", 256)).alias("versions"))


@query(V.sql("SELECT kind, target, count(*) AS n FROM (SELECT 'large_node' AS kind, package AS target FROM nodes WHERE line_count > 40 UNION ALL SELECT 'costly_node', package FROM nodes WHERE token_cost > 1500) x GROUP BY 1, 2", "nodes"))
def candidate_counts(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array_compact(F.array(F.when(F.col("line_count") > 40, "large_node"), F.when(F.col("token_cost") > 1500, "costly_node")))
    return V.part_nodes(spark, sf).select(F.explode(kinds).alias("kind"), F.col("package").alias("target")).groupBy("kind", "target").agg(F.count("*").alias("n"))


def _recycle(side: str) -> str:
    return f"r_{side} AS (SELECT from_pkg AS src, to_pkg AS dst FROM y_{side} UNION SELECT r.src, y.to_pkg FROM r_{side} r JOIN y_{side} y ON r.dst = y.from_pkg)"


_DC = ", ".join(f"y_{s} AS (SELECT * FROM snap_{s} WHERE from_pkg < 'Brand#3' AND right(from_pkg, 1) = right(to_pkg, 1)), {_recycle(s)}" for s in ("base", "cur"))
_CYC = "(SELECT a.src AS id, least(a.src, min(a.dst)) AS c FROM r_{0} a JOIN r_{0} b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src)"


@query(V.sql(f"SELECT n.c AS cycle, CASE WHEN count(t.id) = 0 THEN 'new' ELSE 'grown' END AS change, count(*) FILTER (t.id IS NULL) AS added FROM {_CYC.format('cur')} n LEFT JOIN {_CYC.format('base')} t ON t.id = n.id GROUP BY 1 HAVING count(t.id) = 0 OR count(*) FILTER (t.id IS NULL) > 0 OR count(DISTINCT t.c) > 1", "snap_base", "snap_cur", recursive=_DC), whole=(" WHERE from_pkg < 'Brand#3' AND right(from_pkg, 1) = right(to_pkg, 1)",))
def delta_cycles(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """Cycles that are new, that gained members, or in which several earlier ones met; shrinking says nothing."""
    def cycles(df, id_, c):
        e = df.where("true" if whole else "from_pkg < 'Brand#3' and right(from_pkg, 1) = right(to_pkg, 1)").select(F.col("from_pkg").alias("src"), F.col("to_pkg").alias("dst"))
        return G.strong_components(e).toDF(id_, c)

    now, then = cycles(V.snap_cur(spark, sf, whole), "id", "cycle"), cycles(V.snap_base(spark, sf, whole), "k", "c")
    g = now.join(then, F.col("id") == F.col("k"), "left").groupBy("cycle").agg(F.count("k").alias("known"), F.count_if(F.col("k").isNull()).alias("added"), F.countDistinct("c").alias("met"))
    return g.where("known = 0 or added > 0 or met > 1").select("cycle", F.when(F.col("known") == 0, "new").otherwise("grown").alias("change"), "added")


_VIOL = "(SELECT DISTINCT from_pkg, to_pkg FROM snap_{0} WHERE substr(from_pkg, 7, 1) > substr(to_pkg, 7, 1))"


@query(V.sql(f"SELECT coalesce(a.from_pkg, b.from_pkg) AS from_pkg, coalesce(a.to_pkg, b.to_pkg) AS to_pkg, CASE WHEN b.from_pkg IS NULL THEN 'new' ELSE 'gone' END AS change FROM {_VIOL.format('cur')} a FULL JOIN {_VIOL.format('base')} b ON a.from_pkg = b.from_pkg AND a.to_pkg = b.to_pkg WHERE a.from_pkg IS NULL OR b.from_pkg IS NULL", "snap_cur", "snap_base"), whole=True)
def delta_violations(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """A package of a lower layer may not use one of a higher layer (its brand's first digit)."""
    bad = lambda df: df.where("substr(from_pkg, 7, 1) > substr(to_pkg, 7, 1)")
    return S.changes(bad(V.snap_cur(spark, sf, whole)), bad(V.snap_base(spark, sf, whole)), ["from_pkg", "to_pkg"])


_FAN = "(SELECT from_pkg AS target, count(*) AS m FROM snap_{0} GROUP BY 1 HAVING count(*) > {1})"


@query(V.sql(f"SELECT coalesce(n.target, t.target) AS target, CASE WHEN t.target IS NULL THEN 'new' WHEN n.target IS NULL THEN 'resolved' ELSE 'strengthened' END AS change, t.m AS baseline, n.m AS current FROM {_FAN.format('cur', 4)} n FULL JOIN {_FAN.format('base', 4)} t ON n.target = t.target WHERE t.target IS NULL OR n.target IS NULL OR n.m > t.m", "snap_cur", "snap_base"), whole=True)
def delta_candidates(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    def wide(df, t, m):
        return df.groupBy(F.col("from_pkg").alias(t)).agg(F.count("*").alias(m)).where(f"{m} > 4")

    j = wide(V.snap_cur(spark, sf, whole), "tn", "current").join(wide(V.snap_base(spark, sf, whole), "tb", "baseline"), F.col("tn") == F.col("tb"), "full")
    kept = j.where("tb is null or tn is null or current > baseline")
    return kept.select(F.coalesce("tn", "tb").alias("target"), F.when(F.col("tb").isNull(), "new").when(F.col("tn").isNull(), "resolved").otherwise("strengthened").alias("change"), "baseline", "current")


_SYM = "(SELECT user_id AS id, string_agg(DISTINCT event_type, ' , ' ORDER BY event_type) AS signature, count(*) AS refs FROM events WHERE event_id % 2 = {0} AND value > 60 GROUP BY 1)"


@query(f"SELECT t.id, CASE WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM {_SYM.format(0)} t LEFT JOIN {_SYM.format(1)} n ON n.id = t.id WHERE (n.id IS NULL OR replace(n.signature, ' ', '') <> replace(t.signature, ' ', '')) AND (t.id % 4 <> 0 OR t.refs > 1)")
def delta_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Removed symbols and changed signatures; private ones (ids divisible by four) only if used more than once."""
    e = V.table(spark, sf, "events").where("value > 60")

    def side(k, id_, sig, refs):
        return e.where(F.col("event_id") % 2 == k).groupBy(F.col("user_id").alias(id_)).agg(F.array_join(F.sort_array(F.collect_set("event_type")), " , ").alias(sig), F.count("*").alias(refs))

    j = side(0, "id", "then", "refs").join(side(1, "k", "now", "r2"), F.col("id") == F.col("k"), "left")
    differs = F.col("k").isNull() | (T.squeeze_signature(F.col("now")) != T.squeeze_signature(F.col("then")))
    return j.where(differs & ((F.col("id") % 4 != 0) | (F.col("refs") > 1))).select("id", F.when(F.col("k").isNull(), "removed").otherwise("changed").alias("change"))


_REN = "CASE {0} WHEN 'Brand#11' THEN 'Brand#12' WHEN 'Brand#22' THEN 'Brand#23' ELSE {0} END"
_BASE = f"(SELECT DISTINCT {_REN.format('from_pkg')} AS from_pkg, {_REN.format('to_pkg')} AS to_pkg FROM snap_base)"


@query(V.sql(f"SELECT coalesce(a.from_pkg, b.from_pkg) AS from_pkg, coalesce(a.to_pkg, b.to_pkg) AS to_pkg, CASE WHEN b.from_pkg IS NULL THEN 'new' ELSE 'gone' END AS change FROM snap_cur a FULL JOIN {_BASE} b ON a.from_pkg = b.from_pkg AND a.to_pkg = b.to_pkg WHERE a.from_pkg IS NULL OR b.from_pkg IS NULL", "snap_cur", "snap_base"), whole=True)
def delta_renames(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """The baseline's names are mapped before it is compared."""
    renames = spark.createDataFrame([("Brand#11", "Brand#12"), ("Brand#22", "Brand#23")], "old string, new string")
    base = V.snap_base(spark, sf, whole)
    for c in ("from_pkg", "to_pkg"):
        base = base.join(F.broadcast(renames), F.col(c) == F.col("old"), "left").withColumn(c, F.coalesce("new", c)).drop("old", "new")
    return S.changes(V.snap_cur(spark, sf, whole), base.distinct(), ["from_pkg", "to_pkg"])


@query(V.sql("SELECT array_to_string(targets, ',') AS targets, CAST(len(targets) AS BIGINT) AS size, count(*) AS edges FROM targets WHERE resolution = 'ambiguous' AND len(targets) > 1 GROUP BY 1, 2", "targets"))
def candidate_group_members(spark: SparkSession, sf: str) -> DataFrame:
    """The dictionary of candidate groups, each list once, and how many relations hold its id."""
    edges, groups = C.intern(V.part_edges(spark, sf).withColumn("candidates", F.array("alt1", "alt2")))
    lists = groups.groupBy("group_id").agg(F.array_join(F.sort_array(F.collect_list("target")), ",").alias("targets"), F.count("*").alias("size"))
    used = edges.where("group_id is not null").groupBy(F.col("group_id").alias("g")).agg(F.count("*").alias("edges"))
    return lists.join(used, F.col("group_id") == F.col("g")).select("targets", "size", "edges")


@query(V.sql("SELECT from_id, target, relation, confidence, resolution, round(share, 9) AS share, round(base_weight * share, 9) AS weight FROM projected", "projected"))
def grouped_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Relations on their possible targets by way of the group dictionary, which is joined last."""
    edges, groups = C.intern(V.part_edges(spark, sf).withColumn("candidates", F.array("alt1", "alt2")))
    p = C.project(edges, groups)
    return p.select("from_id", "target", "relation", "confidence", "resolution", F.round("share", 9).alias("share"), F.round(F.col("base_weight") * F.col("share"), 9).alias("weight"))


_STATES = "SELECT source AS path, lang AS producer, CASE WHEN quality IS NULL THEN 'skipped' WHEN quality = 1 AND toxic = 0 THEN 'complete' WHEN quality = 0 AND toxic = 1 THEN 'partial' ELSE 'failed' END AS status FROM documents LEFT JOIN labels USING (doc_id) WHERE source <> 'src3'"


@query(f"SELECT CASE WHEN g = 1 THEN 'file' WHEN g = 0 THEN 'result' ELSE 'producer' END AS level, path, producer, CASE WHEN p OR (c AND k > 1) THEN 'partial' WHEN f THEN 'failed' WHEN c THEN 'complete' ELSE 'skipped' END AS status, CASE WHEN p THEN 'mixed' ELSE '' END AS reasons, n AS n_results FROM (SELECT path, producer, grouping(path, producer) AS g, bool_or(status = 'partial') AS p, bool_or(status = 'complete') AS c, bool_or(status = 'failed') AS f, count(DISTINCT status) AS k, count(*) AS n FROM ({_STATES}) x GROUP BY GROUPING SETS ((path), (path, producer), (producer))) y UNION ALL SELECT 'file', 'src3', NULL, 'excluded', 'too_large', 0 WHERE EXISTS (SELECT 1 FROM documents WHERE source = 'src3')")
def coverage_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as files, languages as producers: statuses by file, by both and by producer in one pass; one source is left out by a reason."""
    d = V.table(spark, sf, "documents").join(V.table(spark, sf, "labels"), "doc_id", "left")
    q, t = F.col("quality"), F.col("toxic")
    status = F.when(q.isNull(), "skipped").when((q == 1) & (t == 0), "complete").when((q == 0) & (t == 1), "partial").otherwise("failed")
    results = d.select(F.col("source").alias("path"), F.col("lang").alias("producer"), status.alias("status")).withColumn("reasons", F.when(F.col("status") == "partial", F.array(F.lit("mixed"))))
    inventory = V.table(spark, sf, "documents").select(F.col("source").alias("path"), F.when(F.col("source") == "src3", "too_large").alias("excluded")).distinct()
    return coverage(inventory, results).select("level", "path", "producer", "status", F.array_join("reasons", ",").alias("reasons"), "n_results")


@query("SELECT id, unnest(names) AS name FROM (SELECT p_partkey AS id, list_distinct([lower(p_brand), lower(p_type), 's' || p_size]) AS names FROM part) x")
def script_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The tables that a script made from each part touches: quoted names, comments, and semicolons inside texts."""
    p = V.table(spark, sf, "part")
    script = F.concat(F.lit('-- DROP TABLE no;\nALTER TABLE ONLY "'), "p_brand", F.lit('" RENAME TO ['), "p_type", F.lit("]; /* CREATE TABLE not; */ INSERT INTO x VALUES (';DROP TABLE y;'); DROP TABLE IF EXISTS a.b.S"), F.col("p_size").cast("string"), F.lit(" CASCADE"))
    return p.select(F.col("p_partkey").alias("id"), F.explode(table_references(script)).alias("name"))
