"""Graph-shaped views over the given tables, for Spark and (as text) for SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive line items of an order as a relation between parts."""
    li = table(spark, sf_dir, "lineitem")
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n_parts"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    s = li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("from_id"), F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*order)).alias("to_id"), F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"), F.col("l_quantity").alias("q")).where("to_id is not null")
    s = s.join(F.broadcast(n))  # a count
    third = F.col("l_linenumber") % 3
    unsure = (F.col("ls") == "F") & (third == 2)
    return s.select(
        "l_orderkey",
        "from_id",
        "to_id",
        "q",
        F.when(F.col("l_linenumber") % 4 == 0, "TESTS").when(F.col("l_linenumber") % 4 == 1, "IMPORTS").when(F.col("l_linenumber") % 4 == 2, "CALLS").otherwise("READS").alias("relation"),
        F.when(F.col("rf") == "N", "static_certain").when(F.col("rf") == "A", "static_inferred").when(F.col("ls") == "O", "framework_inferred").otherwise("dynamic_required").alias("confidence"),
        F.when(F.col("ls") == "O", "exact").when(third == 0, "unresolved").when(third == 1, "unique_name").otherwise("ambiguous").alias("resolution"),
        F.when(unsure, (F.col("to_id") * 7 + 1) % F.col("n_parts")).alias("alt1"),
        F.when(unsure, (F.col("to_id") * 11 + 3) % F.col("n_parts")).alias("alt2"),
    )


def part_edges_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_edges(spark, sf_dir).where("q > 48")


def relations(spark: SparkSession, sf_dir: str, whole: bool) -> DataFrame:
    """All relations between parts, or the sparse sample that SQL can close over."""
    return part_edges(spark, sf_dir) if whole else part_edges_sparse(spark, sf_dir)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    places = ("app/api/", "app/services/", "app/db/", "tests/", "vendor/lib/", "app/migrations/")
    place = F.when(F.lit(False), "")
    for i, p in enumerate(places):
        place = place.when(d % 7 == i, p)
    suffix = F.when(d % 11 == 0, "_pb2.py").when(d % 5 == 0, ".spec.ts").otherwise(".py")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(place.otherwise("src/"), F.col("source"), F.lit("/f"), d.cast("string"), suffix).alias("path"), F.col("text").alias("content"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_brand").alias("file_path"), (F.col("p_partkey") % 40).alias("start_line"), (F.col("p_partkey") % 40 + F.col("p_size")).alias("end_line"))


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("file_path"), F.col("l_quantity").cast("int").alias("line")).distinct()


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes: id, package, cost, lines and category."""
    p = table(spark, sf_dir, "part")
    first = p.agg(F.min("p_type").alias("first_type"))
    cat = F.when(F.col("p_type") == F.col("first_type"), "vendored").when(F.col("p_partkey") % 17 == 0, "generated").when(F.col("p_size") >= 48, "test").otherwise("production")
    return p.join(F.broadcast(first)).select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("package"), F.col("p_type").alias("kind"), F.col("p_size").cast("long").alias("line_count"), F.col("p_retailprice").cast("long").alias("token_cost"), cat.alias("category"))


def _snapshot(spark: SparkSession, sf_dir: str, when: str, whole: bool) -> DataFrame:
    e = relations(spark, sf_dir, whole)
    p = table(spark, sf_dir, "part")
    a, b = p.select(F.col("p_partkey").alias("ka"), F.col("p_brand").alias("from_pkg")), p.select(F.col("p_partkey").alias("kb"), F.col("p_brand").alias("to_pkg"))
    o = table(spark, sf_dir, "orders").where(when).select("o_orderkey")
    return e.join(a, F.col("from_id") == F.col("ka")).join(b, F.col("to_id") == F.col("kb")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).where("from_pkg <> to_pkg").select("from_pkg", "to_pkg").distinct()


def snap_base(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return _snapshot(spark, sf_dir, "o_orderdate < TIMESTAMP '1997-01-01 00:00:00'", whole)


def snap_cur(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return _snapshot(spark, sf_dir, "o_orderdate > TIMESTAMP '1997-01-01 00:00:00'", whole)


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    c = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").alias("from_id"), F.col("s_nationkey").alias("to_id")).agg(F.count("*").alias("n"))
    )
    return c.withColumn("k", F.row_number().over(Window.partitionBy("from_id").orderBy(F.desc("n"), "to_id"))).where("k <= 3").drop("k")


_ATTR = "SELECT p_partkey AS id, p_brand AS package, p_type AS kind, CAST(p_size AS BIGINT) AS line_count, CAST(floor(p_retailprice) AS BIGINT) AS token_cost, CASE WHEN p_type = (SELECT min(p_type) FROM part) THEN 'vendored' WHEN p_partkey % 17 = 0 THEN 'generated' WHEN p_size >= 48 THEN 'test' ELSE 'production' END AS category FROM part"
_SNAP = "SELECT DISTINCT a.p_brand AS from_pkg, b.p_brand AS to_pkg FROM part_edges_sparse e JOIN part a ON e.from_id = a.p_partkey JOIN part b ON e.to_id = b.p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE a.p_brand <> b.p_brand AND o_orderdate {} TIMESTAMP '1997-01-01 00:00:00'"

#: The same views as SQL, in an order in which each uses only earlier ones.
SQL = {
    "part_edges": """SELECT l_orderkey, from_id, to_id, q,
  CASE l_linenumber % 4 WHEN 0 THEN 'TESTS' WHEN 1 THEN 'IMPORTS' WHEN 2 THEN 'CALLS' ELSE 'READS' END AS relation,
  CASE WHEN rf = 'N' THEN 'static_certain' WHEN rf = 'A' THEN 'static_inferred' WHEN ls = 'O' THEN 'framework_inferred' ELSE 'dynamic_required' END AS confidence,
  CASE WHEN ls = 'O' THEN 'exact' WHEN l_linenumber % 3 = 0 THEN 'unresolved' WHEN l_linenumber % 3 = 1 THEN 'unique_name' ELSE 'ambiguous' END AS resolution,
  CASE WHEN ls = 'F' AND l_linenumber % 3 = 2 THEN (to_id * 7 + 1) % (SELECT count(*) FROM part) END AS alt1,
  CASE WHEN ls = 'F' AND l_linenumber % 3 = 2 THEN (to_id * 11 + 3) % (SELECT count(*) FROM part) END AS alt2
FROM (SELECT l_orderkey, l_linenumber, l_partkey AS from_id, LEAD(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS to_id,
  l_returnflag AS rf, l_linestatus AS ls, l_quantity AS q FROM lineitem) s WHERE to_id IS NOT NULL""",
    "part_edges_sparse": "SELECT * FROM part_edges WHERE q > 48",
    "targets": "SELECT *, CASE WHEN resolution = 'ambiguous' THEN list_sort(list_distinct([to_id, alt1, alt2])) ELSE [to_id] END AS targets FROM part_edges",
    "projected": "SELECT from_id, target, relation, confidence, resolution, 1.0::DOUBLE / n AS share, least(CASE WHEN confidence = 'static_certain' THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END, CASE WHEN resolution IN ('exact', 'unique_name') THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END) AS base_weight, CASE WHEN resolution = 'exact' AND confidence = 'static_certain' THEN 0 WHEN resolution IN ('exact', 'unique_name') THEN 1 ELSE 2 END AS rank FROM (SELECT *, len(targets) AS n, unnest(targets) AS target FROM targets) t",
    "pairs": "SELECT from_id AS src, target AS dst, max(base_weight * share) AS weight FROM projected WHERE from_id <> target GROUP BY 1, 2",
    "nodes": _ATTR,
    "files": """SELECT doc_id, concat(CASE doc_id % 7 WHEN 0 THEN 'app/api/' WHEN 1 THEN 'app/services/' WHEN 2 THEN 'app/db/' WHEN 3 THEN 'tests/' WHEN 4 THEN 'vendor/lib/' WHEN 5 THEN 'app/migrations/' ELSE 'src/' END, source, '/f', CAST(doc_id AS VARCHAR),
  CASE WHEN doc_id % 11 = 0 THEN '_pb2.py' WHEN doc_id % 5 = 0 THEN '.spec.ts' ELSE '.py' END) AS path, text AS content FROM documents""",
    "spans": "SELECT p_partkey AS node_id, p_brand AS file_path, p_partkey % 40 AS start_line, p_partkey % 40 + p_size AS end_line FROM part",
    "uses": "SELECT DISTINCT p_brand AS file_path, CAST(l_quantity AS INT) AS line FROM lineitem JOIN part ON l_partkey = p_partkey",
    "nation_edges": "SELECT from_id, to_id, n FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY n DESC, to_id) AS k FROM (SELECT c_nationkey AS from_id, s_nationkey AS to_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2) c) r WHERE k <= 3",
    "snap_base": _SNAP.format("<"),
    "snap_cur": _SNAP.format(">"),
    "sparse_pairs": "SELECT DISTINCT from_id AS src, to_id AS dst FROM part_edges_sparse WHERE from_id <> to_id",
}
_NEEDS = {"part_edges_sparse": ("part_edges",), "targets": ("part_edges",), "projected": ("targets",), "pairs": ("projected",), "snap_base": ("part_edges_sparse",), "snap_cur": ("part_edges_sparse",), "sparse_pairs": ("part_edges_sparse",)}


def sql(body: str, *views: str, recursive: str = "") -> str:
    """body with the views it uses (and what they use) as common table expressions."""
    wanted: set[str] = set()

    def need(v: str) -> None:
        if v not in wanted:
            wanted.add(v)
            for x in _NEEDS.get(v, ()):
                need(x)

    for v in views:
        need(v)
    parts = [f"{v} AS ({SQL[v]})" for v in SQL if v in wanted]
    if recursive:
        parts.append(recursive)
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}" if parts else body


def pagerank_sql(rounds: int) -> str:
    """r (i, id, score): the scores of nodes after i rounds over the pairs pp."""
    return f"""deg AS (SELECT src, count(*) AS d, sum(weight) AS w FROM pp GROUP BY 1),
r AS (SELECT 0 AS i, id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS score FROM nodes
 UNION ALL SELECT q.i + 1, q.id, (0.15::DOUBLE + 0.85::DOUBLE * q.spread) / q.n + coalesce(q.got, 0) FROM (
  SELECT s.i, s.id, s.n, s.spread, g.got FROM (SELECT r.i, r.id, count(*) OVER () AS n, sum(r.score * (1 - coalesce(deg.w / deg.d, 0))) OVER () AS spread FROM r LEFT JOIN deg ON deg.src = r.id WHERE r.i < {rounds}) s
  LEFT JOIN (SELECT pp.dst, 0.85::DOUBLE * sum(r.score * pp.weight / deg.d) AS got FROM r JOIN pp ON pp.src = r.id JOIN deg ON deg.src = pp.src WHERE r.i < {rounds} GROUP BY 1) g ON g.dst = s.id) q)"""


def whole_sql(text: str, drop: tuple[str, ...] = ()) -> str:
    """A query's SQL over all relations instead of the sparse sample, without the further conditions in drop."""
    for old, new in ((SQL["part_edges_sparse"], "SELECT * FROM part_edges"), *((d, "") for d in drop)):
        if old not in text:
            raise ValueError(f"not in the SQL: {old}")
        text = text.replace(old, new)
    return text


def registrar(queries: dict, texts: dict[str, str]):
    """The decorator that registers a query; whole: also as NAME_whole, over all relations, with SQL unless that is None."""

    def query(sql: str | None = None, whole: tuple[str, ...] | bool | None = False):
        def add(f):
            queries[f.__name__] = f
            if sql:
                texts[f.__name__] = sql
            if whole is not False:
                queries[f"{f.__name__}_whole"] = partial(f, whole=True)
                if whole is not None:
                    texts[f"{f.__name__}_whole"] = whole_sql(sql, () if whole is True else whole)
            return f

        return add

    return query
