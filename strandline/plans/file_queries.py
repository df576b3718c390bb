"""Texts, paths, packages, rules, findings and changes over the file, part and snapshot views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import paths as P
from strandline.functions import text as T
from strandline.functions.edges import candidate_targets, edge_rank, edge_weight
from strandline.operators import checks as C
from strandline.operators import findings as N
from strandline.operators import graph as G
from strandline.operators import rules as R
from strandline.operators import structure as S
from strandline.plans import views as V
from strandline.session import written

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = V.registrar(QUERIES, SQL)


_TOKENS = "CAST(greatest(1, CAST(ceil(length(regexp_replace({0}, '[0-9]+', '', 'g')) / 4.0) AS BIGINT) + coalesce(list_sum(list_transform(regexp_extract_all({0}, '[0-9]+'), lambda x: CAST(ceil(length(x) / 3.0) AS BIGINT))), 0)) AS BIGINT)"
_NL = "(length({0}) - length(replace({0}, chr(10), '')))"


@query(f"SELECT doc_id, {_TOKENS.format('text')} AS token_estimate FROM documents")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("token_estimate"))


@query(f"SELECT doc_id, length(text) AS char_count, CASE WHEN text = '' THEN 0 ELSE {_NL.format('text')} + 1 END AS line_count, greatest(1, {_NL.format('text')} + CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 0 ELSE 1 END) AS end_line FROM documents")
def text_cost(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return V.table(spark, sf, "documents").select("doc_id", F.length(t).cast("long").alias("char_count"), T.line_count(t).alias("line_count"), T.module_end_line(t).alias("end_line"))


_SPAN = "array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10))"


@query(f"SELECT doc_id, {_TOKENS.format('span')} AS span_tokens, length(span) AS span_chars FROM (SELECT doc_id, {_SPAN} AS span FROM documents) x")
def span_cost(spark: SparkSession, sf: str) -> DataFrame:
    s = T.span_text(F.col("text"), 2, 4)
    return V.table(spark, sf, "documents").select("doc_id", T.token_estimate(s).alias("span_tokens"), F.length(s).cast("long").alias("span_chars"))


@query("SELECT value, count(*) AS uses, min(event_id) AS first_event FROM (SELECT event_id, unnest(regexp_extract_all(props, '\"([^\"]*)\"', 1)) AS value FROM events) x GROUP BY 1")
def literal_index(spark: SparkSession, sf: str) -> DataFrame:
    lit = F.explode(F.regexp_extract_all("props", F.lit('"([^"]*)"'), F.lit(1)))
    return V.table(spark, sf, "events").select("event_id", lit.alias("value")).groupBy("value").agg(F.count("*").alias("uses"), F.min("event_id").alias("first_event"))


@query("SELECT event_type, key, count(*) AS n FROM (SELECT event_type, unnest(regexp_extract_all(props, '\"([^\"]+)\"\\s*:', 1)) AS key FROM events WHERE json_valid(props)) x GROUP BY 1, 2")
def config_keys(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events").where(F.expr("try_parse_json(props) is not null"))
    return e.select("event_type", F.explode(F.regexp_extract_all("props", F.lit(r'"([^"]+)"\s*:'), F.lit(1))).alias("key")).groupBy("event_type", "key").agg(F.count("*").alias("n"))


_GEN = "(regexp_matches({0}, '(_pb2(_grpc)?\\.pyi?|\\.g\\.(dart|kt)|\\.freezed\\.dart|_generated\\.[a-z]+)$') OR regexp_matches(lower({0}), '(^|/)(migrations|__generated__|generated)/') OR regexp_matches('/' || lower({0}), '/(alembic|migrations)/versions/') OR regexp_matches({0}, '(?i:(^|/)schemas/)(.*/)?[0-9]+\\.json$'))"
_VEN = "regexp_matches(lower({0}), '(^|/)(vendor|vendored|third_party|thirdparty|node_modules|site-packages)(/|$)')"
_TST = "(regexp_matches({0}, '(^|/)(test_[^/]*\\.py|[^/]+_test\\.py|[^/]+\\.(test|spec)\\.(ts|tsx|js|jsx|mjs|cjs)|[^/]+Test\\.kt)$') OR regexp_matches(lower({0}), '(^|/)(test|tests|__tests__|spec)/'))"


@query(V.sql(f"SELECT path, concat_ws(',', CASE WHEN {_GEN.format('path')} THEN 'generated' END, CASE WHEN {_VEN.format('path')} THEN 'vendored' END, CASE WHEN {_TST.format('path')} THEN 'test' END) AS flags FROM files", "files"))
def path_flags(spark: SparkSession, sf: str) -> DataFrame:
    return V.files(spark, sf).select("path", F.array_join(P.path_flags(F.col("path")), ",").alias("flags"))


_CAT = f"CASE WHEN {_VEN.format('path')} THEN 'vendored' WHEN {_GEN.format('path')} THEN 'generated' WHEN {_TST.format('path')} THEN 'test' ELSE 'production' END"


@query(V.sql(f"SELECT path, {_CAT} AS category FROM files", "files"))
def category(spark: SparkSession, sf: str) -> DataFrame:
    return V.files(spark, sf).select("path", P.category(F.col("path")).alias("category"))


@query(V.sql("SELECT path, regexp_replace(replace(regexp_replace(path, '\\.py$', ''), '/', '.'), '\\.__init__$', '') AS module FROM files WHERE path LIKE '%.py'", "files"))
def module_name(spark: SparkSession, sf: str) -> DataFrame:
    return V.files(spark, sf).where(F.col("path").endswith(".py")).select("path", T.module_name(F.col("path")).alias("module"))


_SEGMENTS = "SELECT url, CASE WHEN len(s) = 0 THEN [url] ELSE s END AS s FROM (SELECT DISTINCT url, list_filter(string_split(url, '/'), lambda x: x <> '') AS s FROM pages WHERE url IS NOT NULL) q"


@query(f"WITH p AS ({_SEGMENTS}), g AS (SELECT s[-1] AS k, count(*) AS n, max(len(s)) AS longest FROM p GROUP BY 1), c AS (SELECT k, d, count(DISTINCT array_to_string(list_slice(s, -least(d, len(s)), -1), '/')) = any_value(n) AS apart FROM p JOIN g ON k = s[-1] JOIN range(2, 64) t(d) ON d <= longest WHERE n > 1 GROUP BY 1, 2), e AS (SELECT g.k, CASE WHEN n = 1 THEN 1 ELSE coalesce(min(d) FILTER (apart), any_value(longest)) END AS d FROM g LEFT JOIN c ON c.k = g.k GROUP BY g.k, n) SELECT page_id, array_to_string(list_slice(s, -least(d, len(s)), -1), '/') AS label FROM pages JOIN p ON p.url = pages.url JOIN e ON e.k = s[-1]")
def short_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Short labels of URLs; pages of one URL share its label. The SQL goes to 63 segments, the given URLs have 6."""
    pages = V.table(spark, sf, "pages").where("url is not null").select("page_id", "url")
    labels = written(S.short_labels(pages.select(F.col("url").alias("path"))), "labels")
    return pages.join(labels, F.col("url") == F.col("path")).select("page_id", "label")


@query(V.sql("SELECT path, CASE WHEN path LIKE 'app/db/src1/%' THEN 'explicit_output' WHEN regexp_matches(path, '(^|/)(package-lock\\.json|yarn\\.lock|pnpm-lock\\.yaml|poetry\\.lock|Pipfile\\.lock)$') THEN 'lockfile' WHEN path LIKE 'vendor/%' OR path LIKE 'node_modules/%' OR path LIKE 'third_party/%' THEN 'vendored' WHEN path LIKE 'build/%' OR path LIKE 'dist/%' OR path LIKE '%.min.js' THEN 'generated_path' WHEN content IS NULL THEN 'unreadable' WHEN strlen(content) > 20000 THEN 'too_large' WHEN contains(substr(content, 1, 8192), chr(0)) THEN 'binary' WHEN regexp_matches(array_to_string(list_slice(string_split(content, chr(10)), 1, 8), chr(10)), '(?i)generated file|do not edit|license') THEN 'generated_marker' END AS reason FROM files", "files"))
def snapshot_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    policy = P.ScanPolicy(max_file_bytes=20000, outputs=("app/db/src1",), markers=("generated file", "do not edit", "license"))
    return V.files(spark, sf).select("path", P.exclusion_reason(F.col("path"), F.col("content"), policy).alias("reason"))


@query(V.sql("SELECT specifier, CASE WHEN specifier LIKE '@%' THEN array_to_string(list_slice(string_split(specifier, '/'), 1, 2), '/') ELSE split_part(specifier, '/', 1) END AS package FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN '@' || path ELSE path END AS specifier FROM files) x", "files"))
def ts_package_name(spark: SparkSession, sf: str) -> DataFrame:
    f = V.files(spark, sf).select(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("@"), F.col("path"))).otherwise(F.col("path")).alias("specifier"))
    return f.select("specifier", T.package_of_specifier(F.col("specifier")).alias("package"))


_ROUTE = "'/' || array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '^(?i:https?://[^/]*)', ''), '/'), lambda s: s <> ''), lambda s: CASE WHEN s LIKE '{%' AND s LIKE '%}' OR s LIKE ':%' OR contains(s, '${') THEN '{}' ELSE s END), '/')"


@query(f"SELECT page_id, {_ROUTE} AS route FROM pages")
def route_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "pages").select("page_id", T.normalize_route(F.col("url")).alias("route"))


@query(f"SELECT c.page_id, c.route, coalesce(s.n, 0) AS servers, CASE WHEN s.n IS NULL THEN 'unmatched' WHEN s.n = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM (SELECT page_id, split_part({_ROUTE}, '/', 2) AS route FROM pages) c LEFT JOIN (SELECT lang AS route, count(DISTINCT source) AS n FROM documents WHERE doc_id % 50 = 0 AND lang <> 'de' GROUP BY 1) s ON s.route = c.route")
def route_matching(spark: SparkSession, sf: str) -> DataFrame:
    c = V.table(spark, sf, "pages").select("page_id", F.split_part(T.normalize_route(F.col("url")), F.lit("/"), F.lit(2)).alias("route"))
    s = V.table(spark, sf, "documents").where("doc_id % 50 = 0 and lang <> 'de'").groupBy(F.col("lang").alias("r")).agg(F.countDistinct("source").alias("n"))
    return c.join(s, F.col("route") == F.col("r"), "left").select("page_id", "route", F.coalesce("n", F.lit(0)).alias("servers"), F.when(F.col("n").isNull(), "unmatched").when(F.col("n") == 1, "matched").otherwise("ambiguous").alias("status"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 3 THEN 'my-' || b WHEN 4 THEN 'täble' || p_partkey WHEN 5 THEN '1' || b || '$' ELSE b END AS table_name FROM (SELECT p_partkey, lower(regexp_replace(p_brand, '[^A-Za-z0-9_]', '_', 'g')) AS b FROM part) x")
def table_name_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Dotted and quoted in three ways, and with a dash, an umlaut or a digit in front; the last part comes out bare."""
    b = F.regexp_replace("p_brand", "[^A-Za-z0-9_]", "_")
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, F.concat(F.lit('public."'), b, F.lit('"'))).when(k == 1, F.concat(F.lit("`db`.`"), b, F.lit("`"))).when(k == 2, F.concat(F.lit("dbo . ["), b, F.lit("]")))
    name = name.when(k == 3, F.concat(F.lit("public.my-"), b)).when(k == 4, F.concat(F.lit("Täble"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit(' a."b".1'), b, F.lit("$ ")))
    return V.table(spark, sf, "part").select("p_partkey", T.normalize_table(name).alias("table_name"))


@query("SELECT conv_id, turn, translate(regexp_replace(regexp_replace(text, '\\s+', '', 'g'), '[,;]+([)\\]}>])', '\\1', 'g'), '''', '\"') AS squeezed FROM conversations")
def signature_squeeze(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "conversations").select("conv_id", "turn", T.squeeze_signature(F.col("text")).alias("squeezed"))


def _owner(spark, sf):
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("file"))


def _rolled(spark, sf):
    """Part relations rolled up to brands. A relation is identified by all its columns."""
    e = V.part_edges(spark, sf)
    t = candidate_targets(F.col("to_id"), F.array("alt1", "alt2"), F.col("resolution"))
    once = e.groupBy(*e.columns).count().select(*e.columns, F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy"), t.alias("t"))
    p = once.select(F.xxhash64(*e.columns, "copy").alias("edge_id"), "from_id", F.explode("t").alias("target"), "relation", "confidence", "resolution", F.size("t").alias("n_targets"))
    return S.roll_up(p, _owner(spark, sf))


_ROLLED = "(SELECT src, dst, relation, confidence, resolution, count(*) AS evidence_count, max(hits / CAST(n AS DOUBLE)) AS share FROM (SELECT edge_id, a.p_brand AS src, b.p_brand AS dst, relation, confidence, resolution, n, count(*) AS hits FROM (SELECT *, len(targets) AS n, unnest(targets) AS target FROM (SELECT *, row_number() OVER () AS edge_id FROM targets) q) x JOIN part a ON a.p_partkey = from_id JOIN part b ON b.p_partkey = target GROUP BY 1, 2, 3, 4, 5, 6, 7) y GROUP BY 1, 2, 3, 4, 5)"


@query(V.sql(f"SELECT src, dst, relation, confidence, resolution, evidence_count, round(share, 9) AS share FROM {_ROLLED} r", "targets"))
def file_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _rolled(spark, sf).withColumn("share", F.round("share", 9))


_WEIGHT = "least(CASE WHEN confidence = 'static_certain' THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END, CASE WHEN resolution IN ('exact', 'unique_name') THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END)"
_RANKED = f"(SELECT src, dst, relation, evidence_count, {_WEIGHT} * share AS weight, CASE WHEN resolution = 'exact' AND confidence = 'static_certain' THEN 0 WHEN resolution IN ('exact', 'unique_name') THEN 1 ELSE 2 END AS rank FROM {_ROLLED} r WHERE relation <> 'TESTS' AND src <> dst)"
_TIER = "CASE {0} WHEN 0 THEN 'certain' WHEN 1 THEN 'resolved' ELSE 'all' END"


def _tiers(spark, sf):
    c, r = F.col("confidence"), F.col("resolution")
    return S.tier_pairs(_rolled(spark, sf), edge_weight(c, r) * F.col("share"), edge_rank(c, r))


@query(V.sql(f"SELECT {_TIER.format('t')} AS tier, src, dst, round(max(weight), 9) AS max_weight, CAST(sum(evidence_count) AS BIGINT) AS evidence_count, {_TIER.format('min(rank)')} AS pair_tier, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations FROM {_RANKED} r JOIN range(3) x(t) ON r.rank <= x.t GROUP BY t, src, dst", "targets"))
def file_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _tiers(spark, sf).withColumn("max_weight", F.round("max_weight", 9))


_PP = f"(SELECT src, dst, max(weight) AS max_weight, sum(evidence_count) AS evidence_count FROM {_RANKED} r GROUP BY 1, 2)"
_PM = f"(SELECT p.package, p.file_count, coalesce(i.n, 0) AS ca, coalesce(o.n, 0) AS ce, coalesce(i.w, 0) AS wca, coalesce(o.w, 0) AS wce, CASE WHEN coalesce(i.n, 0) + coalesce(o.n, 0) > 0 THEN coalesce(o.n, 0) / CAST(coalesce(i.n, 0) + coalesce(o.n, 0) AS DOUBLE) END AS instability FROM (SELECT p_brand AS package, count(*) AS file_count FROM part GROUP BY 1) p LEFT JOIN (SELECT dst, count(*) AS n, sum(max_weight) AS w FROM e GROUP BY 1) i ON i.dst = p.package LEFT JOIN (SELECT src, count(*) AS n, sum(max_weight) AS w FROM e GROUP BY 1) o ON o.src = p.package)"


def _certain(spark, sf, whole=False):
    """Certain pairs between brands, of the sparse sample or of all relations."""
    e = V.relations(spark, sf, whole).where("resolution = 'exact' and confidence = 'static_certain' and relation <> 'TESTS'")
    o = _owner(spark, sf)
    a, b = o.select(F.col("node").alias("na"), F.col("file").alias("src")), o.select(F.col("node").alias("nb"), F.col("file").alias("dst"))
    return e.join(a, F.col("from_id") == F.col("na")).join(b, F.col("to_id") == F.col("nb")).where("src <> dst").groupBy("src", "dst").agg(F.lit(1.0).alias("max_weight"), F.count("*").alias("evidence_count"))


_CERTAIN = "e AS (SELECT a.p_brand AS src, b.p_brand AS dst, 1.0::DOUBLE AS max_weight, count(*) AS evidence_count FROM part_edges_sparse x JOIN part a ON a.p_partkey = from_id JOIN part b ON b.p_partkey = to_id WHERE resolution = 'exact' AND confidence = 'static_certain' AND relation <> 'TESTS' AND a.p_brand <> b.p_brand GROUP BY 1, 2)"


def _metrics(spark, sf, whole=False):
    return S.package_metrics(_certain(spark, sf, whole), _owner(spark, sf).groupBy(F.col("file").alias("package")).agg(F.count("*").alias("file_count")))


def _with_e(body: str) -> str:
    return V.sql("@", "part_edges_sparse").replace(" @", f", {_CERTAIN} {body}")


@query(_with_e("SELECT src, dst, max_weight, evidence_count FROM e"), whole=True)
def package_pairs(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    return _certain(spark, sf, whole)


@query(_with_e(f"SELECT package, file_count, ca, ce, round(instability, 9) AS instability FROM {_PM} m"), whole=True)
def package_metrics(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    return _metrics(spark, sf, whole).select("package", "file_count", "ca", "ce", F.round("instability", 9).alias("instability"))


@query(_with_e(f"SELECT package, instability FROM (SELECT package, round(instability, 9) AS instability FROM {_PM} m) x ORDER BY instability DESC NULLS LAST, package LIMIT 10"), whole=True)
def unstable_packages(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    return _metrics(spark, sf, whole).select("package", F.round("instability", 9).alias("instability")).orderBy(F.desc_nulls_last("instability"), "package").limit(10)


@query(_with_e(f"SELECT e.src AS from_package, e.dst AS to_package, round(b.instability - a.instability, 9) AS instability_delta FROM e JOIN {_PM} a ON a.package = e.src JOIN {_PM} b ON b.package = e.dst WHERE b.instability > a.instability"), whole=True)
def unstable_dependency(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    m = written(_metrics(spark, sf, whole).select("package", "instability"), "metrics")
    a, b = m.toDF("pa", "ia"), m.toDF("pb", "ib")
    return _certain(spark, sf, whole).join(a, F.col("src") == F.col("pa")).join(b, F.col("dst") == F.col("pb")).where("ib > ia").select(F.col("src").alias("from_package"), F.col("dst").alias("to_package"), F.round(F.col("ib") - F.col("ia"), 9).alias("instability_delta"))


#: Layers by globs over paths: api and services, data, and tests.
LAYERS = {"app/api/**": "interface", "app/services/**": "interface", "app/db/**": "data", "app/migrations/**": "data", "tests/**": "tests"}


def _layers(spark, sf):
    f = V.files(spark, sf).select("doc_id", "path")
    rules = spark.createDataFrame([(P.path_glob(g), layer) for g, layer in LAYERS.items()], "pattern string, layer string")
    hit = f.join(F.broadcast(rules), F.regexp_like("path", F.col("pattern")))
    one = hit.groupBy("doc_id", "path").agg(F.collect_set("layer").alias("l"))
    return one.select("doc_id", "path", F.when(F.size("l") > 1, F.raise_error(F.lit("a file is in several layers"))).otherwise(F.element_at("l", 1)).alias("layer"))


_LAYER = "(SELECT doc_id, path, CASE WHEN path LIKE 'app/api/%' OR path LIKE 'app/services/%' THEN 'interface' WHEN path LIKE 'app/db/%' OR path LIKE 'app/migrations/%' THEN 'data' WHEN path LIKE 'tests/%' THEN 'tests' END AS layer FROM files)"


@query(V.sql(f"SELECT path, layer FROM {_LAYER} l WHERE layer IS NOT NULL", "files"))
def layer_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return _layers(spark, sf).select("path", "layer")


@query(V.sql(f"SELECT coalesce(layer, 'unassigned') AS layer, count(*) AS files FROM {_LAYER} l GROUP BY 1", "files"))
def layer_coverage(spark: SparkSession, sf: str) -> DataFrame:
    l = _layers(spark, sf).select(F.col("doc_id").alias("k"), "layer")
    return V.files(spark, sf).join(l, F.col("doc_id") == F.col("k"), "left").groupBy(F.coalesce("layer", F.lit("unassigned")).alias("layer")).agg(F.count("*").alias("files"))


@query(V.sql(f"SELECT DISTINCT a.path AS from_path, b.path AS to_path, a.layer AS from_layer, b.layer AS to_layer FROM part_edges_sparse e JOIN {_LAYER} a ON a.doc_id = e.from_id JOIN {_LAYER} b ON b.doc_id = e.to_id WHERE a.layer = 'data' AND b.layer = 'interface' OR a.layer = 'interface' AND b.layer = 'tests'", "part_edges_sparse", "files"), whole=True)
def layer_violations(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    forbid = spark.createDataFrame([("data", "interface"), ("interface", "tests")], "fl string, tl string")
    l = written(_layers(spark, sf), "layers")
    a, b = l.toDF("ka", "from_path", "from_layer"), l.toDF("kb", "to_path", "to_layer")
    e = V.relations(spark, sf, whole).join(a, F.col("from_id") == F.col("ka")).join(b, F.col("to_id") == F.col("kb"))
    return e.join(F.broadcast(forbid), (F.col("from_layer") == F.col("fl")) & (F.col("to_layer") == F.col("tl"))).select("from_path", "to_path", "from_layer", "to_layer").distinct()


@query(V.sql(f"SELECT layer, host, count(*) AS uses FROM (SELECT l.layer, split_part(split_part(p.url, '://', 2), '/', 1) AS host FROM pages p JOIN {_LAYER} l ON l.doc_id = p.page_id) x WHERE layer = 'data' AND host LIKE '%.net' OR layer = 'interface' AND host NOT LIKE '%.com' GROUP BY 1, 2", "files"))
def external_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Data may not use *.net; interface may only use *.com. Distinct (layer, name) pairs meet the globs."""
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    used = V.table(spark, sf, "pages").select("page_id", host.alias("host")).join(_layers(spark, sf), F.col("page_id") == F.col("doc_id")).groupBy("layer", "host").agg(F.count("*").alias("uses"))
    net, com = F.regexp_like("host", F.lit(P.name_glob("*.net"))), F.regexp_like("host", F.lit(P.name_glob("*.com")))
    return used.where(((F.col("layer") == "data") & net) | ((F.col("layer") == "interface") & ~com))


@query(V.sql("SELECT path, module_path FROM (SELECT f.path, m.d AS module_path, row_number() OVER (PARTITION BY f.path ORDER BY length(m.d) DESC, m.d) AS k FROM files f JOIN (SELECT unnest(['', 'app', 'app/db', 'app/api/src1', 'tests', 'vendor/lib/src2']) AS d) m ON m.d = '' OR starts_with(f.path, m.d || '/')) x WHERE k = 1", "files"))
def longest_prefix_package(spark: SparkSession, sf: str) -> DataFrame:
    dirs = ["", "app", "app/db", "app/api/src1", "tests", "vendor/lib/src2"]
    return S.longest_prefix(V.files(spark, sf).select("path"), F.broadcast(spark.createDataFrame([(d, d) for d in dirs], "module_dir string, module_path string")))


@query(V.sql("SELECT path, CASE WHEN path LIKE '%.py' THEN 'pkg:python:' || replace(regexp_extract(path, '^(.*)/', 1), '/', '.') ELSE 'pkg:dir:' || regexp_extract(path, '^(.*)/', 1) END AS package FROM files", "files"))
def package_assignment(spark: SparkSession, sf: str) -> DataFrame:
    d = P.dirname(F.col("path"))
    py = F.concat(F.lit("pkg:python:"), F.translate(d, "/", "."))
    return V.files(spark, sf).select("path", F.when(F.col("path").endswith(".py"), py).otherwise(F.concat(F.lit("pkg:dir:"), d)).alias("package"))


@query(V.sql("SELECT file_path, line, node_id FROM (SELECT u.*, s.node_id, row_number() OVER (PARTITION BY u.file_path, u.line ORDER BY s.end_line - s.start_line, s.node_id) AS k FROM uses u JOIN spans s ON s.file_path = u.file_path AND u.line BETWEEN s.start_line AND s.end_line) x WHERE k = 1", "uses", "spans"))
def smallest_enclosing_span(spark: SparkSession, sf: str) -> DataFrame:
    return S.enclosing(V.uses(spark, sf), V.spans(spark, sf))


@query(V.sql("SELECT node_id, count(*) AS uses FROM (SELECT s.node_id, row_number() OVER (PARTITION BY u.file_path, u.line ORDER BY s.end_line - s.start_line, s.node_id) AS k FROM uses u JOIN spans s ON s.file_path = u.file_path AND u.line BETWEEN s.start_line AND s.end_line) x WHERE k = 1 GROUP BY 1", "uses", "spans"))
def config_usage(spark: SparkSession, sf: str) -> DataFrame:
    return S.enclosing(V.uses(spark, sf), V.spans(spark, sf)).groupBy("node_id").agg(F.count("*").alias("uses"))


_WORDS = "SELECT {0} AS id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS name FROM {1}"


@query(f"SELECT u.name, CASE WHEN k IS NULL THEN 'unresolved' WHEN k = 1 THEN 'unique_name' ELSE 'ambiguous' END AS resolution, h.first AS target, coalesce(k, 0) AS candidates FROM (SELECT DISTINCT name FROM ({_WORDS.format('page_id', '(SELECT page_id, url AS text FROM pages)')}) p) u LEFT JOIN (SELECT name, count(*) AS k, min(id) AS first FROM (SELECT DISTINCT id, name FROM ({_WORDS.format('item_id', 'benchmark')}) b) d GROUP BY 1) h ON h.name = u.name")
def name_resolution(spark: SparkSession, sf: str) -> DataFrame:
    words = lambda c: F.explode(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)))
    names = V.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), words("text").alias("name")).distinct()
    return S.resolve(names, V.table(spark, sf, "pages").select(words("url").alias("name")).distinct())


_EDGEN = "SELECT e.*, a.category AS ca, b.category AS cb, a.package AS pa, b.package AS pb FROM part_edges e JOIN nodes a ON a.id = e.from_id JOIN nodes b ON b.id = e.to_id"


def _edge_nodes(spark, sf):
    n = V.part_nodes(spark, sf).select("id", "category", "package")
    return V.part_edges(spark, sf).join(n.toDF("ia", "ca", "pa"), F.col("from_id") == F.col("ia")).join(n.toDF("ib", "cb", "pb"), F.col("to_id") == F.col("ib"))


@query(V.sql(f"SELECT from_id, to_id, confidence, resolution, count(*) AS n FROM ({_EDGEN}) x WHERE ca = 'test' AND cb <> 'test' GROUP BY 1, 2, 3, 4", "part_edges", "nodes"))
def tests_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edge_nodes(spark, sf).where("ca = 'test' and cb <> 'test'").groupBy("from_id", "to_id", "confidence", "resolution").agg(F.count("*").alias("n"))


@query(V.sql("SELECT h.id, h.rank, coalesce(u.unsure, 0) AS uncertain FROM (SELECT r.id, row_number() OVER (ORDER BY round(score, 9) DESC, r.id) AS rank FROM r JOIN nodes ON nodes.id = r.id WHERE i = 60 AND category = 'production') h LEFT JOIN u ON u.to_id = h.id WHERE h.rank <= 50 AND coalesce(u.sure, 0) = 0", "pairs", "nodes", recursive="pp AS (SELECT * FROM pairs), u AS (SELECT to_id, count(*) FILTER (resolution IN ('exact', 'unique_name')) AS sure, count(*) FILTER (resolution IN ('ambiguous', 'unresolved')) AS unsure FROM part_edges JOIN nodes a ON a.id = from_id WHERE relation = 'TESTS' AND a.category = 'test' GROUP BY 1), " + V.pagerank_sql(60)))
def untested_hub(spark: SparkSession, sf: str) -> DataFrame:
    """Of the fifty production nodes of greatest PageRank, those that no test reaches for certain."""
    n, e = V.part_nodes(spark, sf), V.part_edges(spark, sf)
    scores = G.pagerank(G.pair_weights(G.project(e)), n).select("id", F.round("score", 9).alias("score"))
    return N.untested_hubs(n, e, scores)


_SIDES = "SELECT from_id AS id, * FROM (SELECT from_id, to_id, confidence, resolution FROM part_edges_sparse WHERE from_id <> to_id) x UNION ALL SELECT to_id AS id, * FROM (SELECT from_id, to_id, confidence, resolution FROM part_edges_sparse WHERE from_id <> to_id) y"


@query(V.sql(f"SELECT n.id, count(s.id) FILTER (confidence = 'framework_inferred') AS framework_edges, count(s.id) FILTER (confidence = 'dynamic_required') AS dynamic_edges, count(s.id) FILTER (confidence LIKE 'static_%') AS uncertain_static_edges FROM nodes n LEFT JOIN ({_SIDES}) s ON s.id = n.id WHERE n.category = 'production' AND n.id NOT IN (SELECT id FROM ({_SIDES}) t WHERE confidence LIKE 'static_%' AND resolution IN ('exact', 'unique_name')) GROUP BY 1", "nodes", "part_edges_sparse"), whole=True)
def isolated_node(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    return N.isolated_nodes(V.part_nodes(spark, sf).where("category = 'production'"), V.relations(spark, sf, whole))


@query(V.sql(f"SELECT to_id AS id, count(DISTINCT pa) FILTER (resolution IN ('exact', 'unique_name')) AS external_refs, count(DISTINCT pa) - count(DISTINCT pa) FILTER (resolution IN ('exact', 'unique_name')) AS uncertain_external_refs FROM ({_EDGEN}) x WHERE pa <> pb GROUP BY 1", "part_edges", "nodes"))
def symbol_refs(spark: SparkSession, sf: str) -> DataFrame:
    e = _edge_nodes(spark, sf).where("pa <> pb").groupBy(F.col("to_id").alias("id"), "pa").agg(F.max(F.col("resolution").isin("exact", "unique_name").cast("int")).alias("sure"))
    return e.groupBy("id").agg(F.sum("sure").cast("long").alias("external_refs"), F.sum(1 - F.col("sure")).cast("long").alias("uncertain_external_refs"))


@query(V.sql("SELECT package, count(*) AS unreferenced_count FROM nodes WHERE category = 'production' AND id NOT IN (SELECT to_id FROM part_edges_sparse WHERE relation <> 'READS') AND kind NOT LIKE 'S%' GROUP BY 1", "nodes", "part_edges_sparse"), whole=True)
def unreferenced_symbol(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    n = V.part_nodes(spark, sf).where("category = 'production' and not startswith(kind, 'S')")
    return N.unreferenced(n, V.relations(spark, sf, whole).where("relation <> 'READS'"), "package")


@query(V.sql(f"SELECT to_id AS id, count(DISTINCT pa) AS directories, CASE WHEN count(DISTINCT pa) = 1 THEN max(l_orderkey) - min(l_orderkey) + 1 ELSE 0 END AS line_span FROM ({_EDGEN}) x WHERE pa <> pb GROUP BY 1 HAVING count(DISTINCT pa) > 1 OR max(l_orderkey) - min(l_orderkey) + 1 > 2000", "part_edges", "nodes"))
def evidence_spread(spark: SparkSession, sf: str) -> DataFrame:
    e = _edge_nodes(spark, sf).where("pa <> pb").groupBy(F.col("to_id").alias("id"), "pa").agg(F.min("l_orderkey").alias("a"), F.max("l_orderkey").alias("z"))
    s = e.groupBy("id").agg(F.count("*").alias("directories"), (F.max("z") - F.min("a") + 1).alias("span"))
    return s.where("directories > 1 or span > 2000").select("id", "directories", F.when(F.col("directories") == 1, F.col("span")).otherwise(0).alias("line_span"))


@query(f"SELECT * FROM (SELECT doc_id, {_NL.format('text')} + 1 AS line_count, {_TOKENS.format('text')} AS token_count FROM documents) x WHERE line_count > 40 OR token_count > 2400")
def large_node(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    n = V.table(spark, sf, "documents").select("doc_id", (T.newlines(t) + 1).cast("long").alias("line_count"), T.token_estimate(t).alias("token_count"))
    return N.large_nodes(n, 40, 2400)


@query(V.sql(f"SELECT pb AS package, count(*) AS edges, count(DISTINCT from_id) AS sources FROM ({_EDGEN}) x WHERE resolution = 'unresolved' OR confidence = 'dynamic_required' GROUP BY 1", "part_edges", "nodes"))
def unresolved_boundary(spark: SparkSession, sf: str) -> DataFrame:
    return N.unresolved_boundaries(_edge_nodes(spark, sf).withColumn("package", F.col("pb")), "package")


@query("SELECT source, CASE WHEN bool_or(s = 'partial') OR (bool_or(s = 'complete') AND count(DISTINCT s) > 1) THEN 'partial' WHEN bool_or(s = 'failed') THEN 'failed' WHEN bool_or(s = 'complete') THEN 'complete' ELSE 'skipped' END AS status, count(DISTINCT s) AS kinds FROM (SELECT source, CASE WHEN quality IS NULL THEN 'skipped' WHEN quality = 1 AND toxic = 0 THEN 'complete' WHEN quality = 0 AND toxic = 1 THEN 'partial' ELSE 'failed' END AS s FROM documents LEFT JOIN labels USING (doc_id)) x GROUP BY 1")
def coverage_status(spark: SparkSession, sf: str) -> DataFrame:
    q, t = F.col("quality"), F.col("toxic")
    d = V.table(spark, sf, "documents").join(V.table(spark, sf, "labels"), "doc_id", "left").select("source", F.when(q.isNull(), "skipped").when((q == 1) & (t == 0), "complete").when((q == 0) & (t == 1), "partial").otherwise("failed").alias("s"))
    g = d.groupBy("source").agg(F.collect_set("s").alias("s"))
    has = lambda x: F.array_contains("s", x)
    return g.select("source", F.when(has("partial") | (has("complete") & (F.size("s") > 1)), "partial").when(has("failed"), "failed").when(has("complete"), "complete").otherwise("skipped").alias("status"), F.size("s").cast("long").alias("kinds"))


@query("SELECT event_id, CAST(user_id AS VARCHAR) || '/' || event_type || CASE WHEN n > 1 THEN ' [' || n || ']' ELSE '' END AS case_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) x")
def occurrence_number(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    e = V.table(spark, sf, "events").withColumn("n", n)
    return e.select("event_id", F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"), F.when(F.col("n") > 1, F.concat(F.lit(" ["), F.col("n").cast("string"), F.lit("]"))).otherwise("")).alias("case_id"))


@query(V.sql("SELECT group_id, count(*) AS edges FROM (SELECT 'cg:' || sha256(array_to_string(targets, ',')) AS group_id FROM targets WHERE resolution = 'ambiguous') x GROUP BY 1", "targets"))
def candidate_groups(spark: SparkSession, sf: str) -> DataFrame:
    t = candidate_targets(F.col("to_id"), F.array("alt1", "alt2"), F.col("resolution"))
    return V.part_edges(spark, sf).where("resolution = 'ambiguous'").groupBy(F.concat(F.lit("cg:"), F.sha2(F.array_join(t, ","), 256)).alias("group_id")).agg(F.count("*").alias("edges"))


@query(V.sql("SELECT coalesce(a.from_pkg, b.from_pkg) AS from_pkg, coalesce(a.to_pkg, b.to_pkg) AS to_pkg, CASE WHEN b.from_pkg IS NULL THEN 'new' ELSE 'gone' END AS change FROM snap_cur a FULL JOIN snap_base b ON a.from_pkg = b.from_pkg AND a.to_pkg = b.to_pkg WHERE a.from_pkg IS NULL OR b.from_pkg IS NULL", "snap_cur", "snap_base"), whole=True)
def delta_package_dependencies(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    return S.changes(V.snap_cur(spark, sf, whole), V.snap_base(spark, sf, whole), ["from_pkg", "to_pkg"])


def _inst(side: str) -> str:
    return f"(SELECT p, sum(o) / CAST(count(*) AS DOUBLE) AS i FROM (SELECT from_pkg AS p, 1 AS o FROM {side} UNION ALL SELECT to_pkg, 0 FROM {side}) x GROUP BY 1)"


@query(V.sql(f"SELECT a.p AS package, round(a.i - b.i, 9) AS delta FROM {_inst('snap_cur')} a JOIN {_inst('snap_base')} b ON a.p = b.p WHERE abs(a.i - b.i) >= 0.2 - 1e-12", "snap_cur", "snap_base"), whole=True)
def delta_instability(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    def inst(df, name):
        m = S.package_metrics(df.select(F.col("from_pkg").alias("src"), F.col("to_pkg").alias("dst"), F.lit(1.0).alias("max_weight")), df.select(F.explode(F.array("from_pkg", "to_pkg")).alias("package")).groupBy("package").agg(F.count("*").alias("file_count")))
        return m.select(F.col("package").alias(f"p_{name}"), F.col("instability").alias(name))

    j = inst(V.snap_cur(spark, sf, whole), "now").join(inst(V.snap_base(spark, sf, whole), "before"), F.col("p_now") == F.col("p_before"))
    return j.where("abs(now - before) >= 0.2 - 1e-12").select(F.col("p_now").alias("package"), F.round(F.col("now") - F.col("before"), 9).alias("delta"))


@query(V.sql("SELECT change, count(*) AS n FROM (SELECT CASE WHEN b.from_pkg IS NULL THEN 'new' ELSE 'gone' END AS change FROM snap_cur a FULL JOIN snap_base b ON a.from_pkg = b.from_pkg AND a.to_pkg = b.to_pkg WHERE a.from_pkg IS NULL OR b.from_pkg IS NULL) x GROUP BY 1", "snap_cur", "snap_base"), whole=True)
def delta_counts(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    return delta_package_dependencies(spark, sf, whole).groupBy("change").agg(F.count("*").alias("n"))


@query(V.sql("SELECT count(*) > 0 AS regressed FROM snap_cur a WHERE NOT EXISTS (SELECT 1 FROM snap_base b WHERE a.from_pkg = b.from_pkg AND a.to_pkg = b.to_pkg)", "snap_cur", "snap_base"), whole=True)
def regression_gate(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    return V.snap_cur(spark, sf, whole).join(V.snap_base(spark, sf, whole), ["from_pkg", "to_pkg"], "left_anti").agg((F.count("*") > 0).alias("regressed"))


_CASES = "SELECT user_id, event_type, count(*) FILTER (value > 50) AS strong, count(*) FILTER (value <= 50) AS weak, count(*) FILTER (value > 90) AS mocks FROM events WHERE event_id % 2 = {0} GROUP BY 1, 2"


@query(f"SELECT * FROM (SELECT coalesce(n.user_id, t.user_id) AS user_id, coalesce(n.event_type, t.event_type) AS event_type, concat_ws(',', CASE WHEN n.user_id IS NULL THEN 'removed' END, CASE WHEN t.user_id IS NULL AND n.strong = 0 THEN 'new_without_strong_assertions' END, CASE WHEN n.strong < t.strong THEN 'fewer_strong_assertions' END, CASE WHEN t.user_id IS NULL AND n.mocks >= 3 OR n.mocks - t.mocks >= 2 THEN 'added_mocks' END) AS reasons FROM ({_CASES.format(1)}) n FULL JOIN ({_CASES.format(0)}) t ON n.user_id = t.user_id AND n.event_type = t.event_type) x WHERE reasons <> ''")
def delta_test_changes(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events")

    def cases(k, name):
        v = F.col("value")
        return e.where(F.col("event_id") % 2 == k).groupBy("user_id", "event_type").agg(*[F.count_if(c).alias(f"{a}_{name}") for c, a in ((v > 50, "strong"), (v > 90, "mocks"))])

    j = cases(1, "n").join(cases(0, "t"), ["user_id", "event_type"], "full")
    gone, new = F.col("strong_n").isNull(), F.col("strong_t").isNull()
    reasons = F.concat_ws(",", F.when(gone, "removed"), F.when(new & (F.col("strong_n") == 0), "new_without_strong_assertions"), F.when(F.col("strong_n") < F.col("strong_t"), "fewer_strong_assertions"), F.when((new & (F.col("mocks_n") >= 3)) | (F.col("mocks_n") - F.col("mocks_t") >= 2), "added_mocks"))
    return j.select("user_id", "event_type", reasons.alias("reasons")).where("reasons <> ''")


@query(V.sql("SELECT kind, rank, id, score FROM (SELECT kind, id, score, row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) AS rank FROM (SELECT kind, id, token_cost AS score FROM nodes) x) y WHERE rank <= 10", "nodes"))
def handout_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return S.top(V.part_nodes(spark, sf).select("kind", "id", F.col("token_cost").alias("score")), ["kind"], [F.desc("score"), "id"], 10).select("kind", "rank", "id", "score")


@query(V.sql("SELECT kind, package, score, duplicates FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, package) AS k FROM (SELECT kind, package, max(token_cost) AS score, count(*) AS duplicates FROM nodes GROUP BY 1, 2) x) y WHERE k <= 2", "nodes"))
def focus_candidates(spark: SparkSession, sf: str) -> DataFrame:
    best = V.part_nodes(spark, sf).groupBy("kind", "package").agg(F.max("token_cost").alias("score"), F.count("*").alias("duplicates"))
    return S.top(best, ["kind"], [F.desc("score"), "package"], 2).select("kind", "package", "score", "duplicates")


#: Rules over the files' paths; hosts of pages stand in for external names.
DOCUMENT = {
    "version": 1,
    "layers": {"interface": {"paths": ["app/api/**", "app/services/**"]}, "data": {"paths": ["app/db/**", "app/migrations/**"]}, "tests": {"paths": ["tests/**"]}, "library": {"packages": ["vendor*"]}},
    "allow": {"data": ["library"], "library": []},
    "forbid": [{"from": "interface", "to": ["tests"], "to_external": ["group:net"]}],
    "external": {"net": ["*.net"]},
    "allow_external": {"data": ["*.com"]},
}
_RULED = "l AS (SELECT doc_id, path, CASE WHEN path LIKE 'app/api/%' OR path LIKE 'app/services/%' THEN 'interface' WHEN path LIKE 'app/db/%' OR path LIKE 'app/migrations/%' THEN 'data' WHEN path LIKE 'tests/%' THEN 'tests' WHEN path LIKE 'vendor%' THEN 'library' END AS layer FROM files)"


def _ruled(spark, sf):
    f = written(V.files(spark, sf).select("doc_id", "path"), "files")
    packages = f.select("path", F.substring_index("path", "/", 1).alias("package"))
    return f, R.assign_layers(f, packages, R.parse_rules(DOCUMENT))


def _with_ruled(body: str, *views: str) -> str:
    return V.sql("@", *views).replace(" @", f", {_RULED} {body}")


@query(_with_ruled("SELECT coalesce(n.layer, l.layer) AS layer, count(l.doc_id) AS files FROM l FULL JOIN (SELECT unnest(['interface', 'data', 'tests', 'library']) AS layer) n ON n.layer = l.layer GROUP BY 1", "files"))
def rule_layer_counts(spark: SparkSession, sf: str) -> DataFrame:
    f, layers = _ruled(spark, sf)
    return R.layer_counts(f, layers, R.parse_rules(DOCUMENT))


@query(_with_ruled("SELECT DISTINCT a.path AS src, b.path AS dst, a.layer AS from_layer, b.layer AS to_layer, CASE WHEN a.layer = 'interface' THEN 'forbid' ELSE 'allow' END AS rule_type FROM part_edges e JOIN l a ON a.doc_id = e.from_id JOIN l b ON b.doc_id = e.to_id WHERE a.layer <> b.layer AND (a.layer = 'interface' AND b.layer = 'tests' OR a.layer = 'data' AND b.layer <> 'library' OR a.layer = 'library')", "files", "part_edges"))
def rule_pair_violations(spark: SparkSession, sf: str) -> DataFrame:
    """All relations between files by a document's allow lists and prohibitions."""
    f, layers = _ruled(spark, sf)
    e = V.part_edges(spark, sf).select("from_id", "to_id").distinct()
    pairs = e.join(f.toDF("ka", "src"), F.col("from_id") == F.col("ka")).join(f.toDF("kb", "dst"), F.col("to_id") == F.col("kb")).select("src", "dst")
    return R.pair_violations(pairs, layers, R.parse_rules(DOCUMENT))


@query(_with_ruled("SELECT path, layer, host AS name, CASE WHEN layer = 'data' THEN 'allow_external' ELSE 'forbid_external' END AS rule_type, CASE WHEN layer = 'data' THEN '' ELSE 'group:net' END AS matched, count(*) AS uses FROM (SELECT l.path, l.layer, split_part(split_part(p.url, '://', 2), '/', 1) AS host FROM pages p JOIN l ON l.doc_id = p.page_id) x WHERE layer = 'data' AND host NOT LIKE '%.com' OR layer = 'interface' AND host LIKE '%.net' GROUP BY 1, 2, 3", "files"))
def rule_name_violations(spark: SparkSession, sf: str) -> DataFrame:
    f, layers = _ruled(spark, sf)
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    uses = V.table(spark, sf, "pages").select("page_id", host.alias("name")).join(f, F.col("page_id") == F.col("doc_id")).select("path", "name")
    found = R.name_violations(uses, layers, R.parse_rules(DOCUMENT))
    return found.withColumn("matched", F.array_join("matched", ","))


@query(V.sql("SELECT 'span is outside its file' AS check, CAST(node_id AS VARCHAR) AS what FROM spans WHERE start_line < 1 OR end_line > 60 UNION ALL SELECT 'edge leads to no node', CAST(id AS VARCHAR) FROM (SELECT from_id AS id FROM part_edges UNION SELECT to_id FROM part_edges UNION SELECT alt1 FROM part_edges UNION SELECT alt2 FROM part_edges) e WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM nodes)", "spans", "part_edges", "nodes"))
def graph_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with the graph of parts, if each of their files had sixty lines."""
    text = lambda c: F.col(c).cast("string")
    s = V.spans(spark, sf).select(text("node_id").alias("id"), F.col("file_path").alias("file"), "start_line", "end_line", F.lit(0).alias("token_estimate"))
    e = V.part_edges(spark, sf).select(text("from_id").alias("from_id"), text("to_id").alias("to_id"), F.array_compact(F.array(text("alt1"), text("alt2"))).alias("candidates"))
    return C.check_graph(s, e, s.select(F.col("file").alias("path"), F.lit(60).alias("lines")).distinct())


@query(V.sql("SELECT path, row_number() OVER (ORDER BY path) - 1 AS position FROM (SELECT DISTINCT path FROM files) f", "files"))
def file_positions(spark: SparkSession, sf: str) -> DataFrame:
    return N.positions(V.files(spark, sf))


@query(V.sql("SELECT from_id, to_id, relation, count(*) AS n FROM (SELECT from_id, to_id, relation FROM part_edges WHERE l_orderkey % 2 = 0 UNION ALL SELECT from_id, to_id, relation FROM part_edges b WHERE l_orderkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM part_edges a WHERE a.l_orderkey % 2 = 0 AND a.from_id = b.from_id AND a.to_id = b.to_id AND a.relation = b.relation)) x GROUP BY 1, 2, 3", "part_edges"))
def merge_analyzers(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of even orders, then those of odd ones that the even ones do not have; repeats within a half stay."""
    e = V.part_edges(spark, sf)
    halves = [e.where(F.col("l_orderkey") % 2 == k).select("from_id", "to_id", "relation") for k in (0, 1)]
    return N.merge_graphs(halves, ["from_id", "to_id", "relation"]).groupBy("from_id", "to_id", "relation").agg(F.count("*").alias("n"))
