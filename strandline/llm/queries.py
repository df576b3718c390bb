"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, classifier, divergence, fingerprint, jaccard, lattice_lm, packing, quality, repetition, substring, token_counts, url_filter, warc
from strandline.llm.common import shared_dir

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), size=1024, end_id=2)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/strandline-warc-{uuid.uuid4().hex}")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score is the fuller model's, which learns from the training texts; lattice_score has the file's law alone."""
    scored = lattice_lm.score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.col("word_score").alias("score"), F.col("score").alias("lattice_score"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), rule="most")


def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_groups(table(spark, sf_dir, "documents"), n=4, percent=85)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, sf_dir, "documents"), k=20)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.run_digests(repetition.periodic_runs(repetition.with_planted_runs(table(spark, sf_dir, "documents")), shortest=12))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"), least_docs=10, top=10)


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_best_fit_packing,
        op2_quality_rules,
        op3_document_fingerprints,
        op4_warc,
        op5_lm_scoring,
        op6_url_filters,
        op7_token_counts,
        op8_bpe_encoding,
        op9_ngram_jaccard_join,
        op10_substring_dedup,
        op11_periodic_runs,
        op12_quality_classifier,
        op13_source_divergence,
    )}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(string_split_regex(coalesce({}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _archives_sql() -> str:
    return """WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
k AS (SELECT h, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha1(p.h) AS payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN keeper <> page_id THEN keeper END AS refers_to FROM p LEFT JOIN k ON k.h = p.h"""


def _urls_sql() -> str:
    """All rules on every URL, without an index."""
    rest = "CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    sites = " UNION ALL ".join(f"SELECT '{r.host}' AS h, '{r.path}' AS p, '{r.name}' AS name, '{r.verdict}' AS v" for r in url_filter.SITE_RULES)
    low = _LOWER.format("parts.url")
    found = " ".join(f"WHEN regexp_matches({low}, '{r.pattern}') THEN '{r.pattern}'" for r in url_filter.PATTERN_RULES)
    verdict = " ".join(f"WHEN pattern = '{r.pattern}' THEN '{r.verdict}'" for r in url_filter.PATTERN_RULES)
    return f"""WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages), r AS (SELECT page_id, url, {rest} AS rest FROM u),
parts AS (SELECT page_id, url, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
fits AS (SELECT page_id, url, s.name, s.v, row_number() OVER (PARTITION BY page_id, url ORDER BY length(s.name) DESC) AS k
  FROM (SELECT DISTINCT * FROM parts) x JOIN ({sites}) s ON (host = s.h OR ends_with(host, '.' || s.h)) AND starts_with(path, s.p)),
j AS (SELECT parts.page_id, host, path, f.name AS rule, f.v, CASE WHEN f.name IS NULL THEN CASE {found} END END AS pattern
  FROM parts LEFT JOIN fits f ON f.page_id = parts.page_id AND f.url = parts.url AND f.k = 1)
SELECT page_id, host, path, rule, coalesce(v, CASE {verdict} END, 'allow') AS verdict, pattern FROM j"""


def _groups_sql(n: int = 4, percent: int = 85) -> str:
    """All pairs that share an n-gram, and the closure of their links."""
    words = _WORDS.format(_LOWER.format("text"))
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {words} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, array_to_string(list_slice(ws, i, i + {n - 1}), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, CAST(len(ws) AS BIGINT) - {n - 2})) AS i FROM w) a
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND {n - 1}) b),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN c a ON a.doc_id = x JOIN c b ON b.doc_id = y WHERE 100 * o >= {percent} * (a.n + b.n - o)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS d, least(x, y) AS m FROM e UNION SELECT e.x, r.m FROM e JOIN r ON e.y = r.d WHERE r.m < e.x)
SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, least(w.doc_id, coalesce((SELECT min(m) FROM r WHERE r.d = w.doc_id), w.doc_id)) AS component_id FROM w LEFT JOIN c ON c.doc_id = w.doc_id"""


def _repeats_sql(k: int = 20) -> str:
    """Every window by its words; all but the first of each cover their words."""
    return f"""WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + {k - 1}), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, CAST(len(ws) AS BIGINT) - {k - 2})) AS i FROM w) a),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i FROM f WHERE r > 1) g, range({k}) t(j)),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, CAST(len(ws) AS BIGINT) + 1)) AS p FROM w),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) AS t, count(*) AS n FROM p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.p = p.p WHERE g.p IS NULL GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) AS BIGINT) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""


#: crc32 of a text's bytes: the reflected polynomial 0xEDB88320, eight shifts after each byte.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split({}, ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), CAST(4294967295 AS BIGINT))"""


def _runs_sql(shortest: int = 12) -> str:
    """All pairs of equal words of a text, their stretches at each lag, and the least lag of each stretch."""
    return f"""WITH w0 AS (SELECT doc_id, {_WORDS.format("text")} AS ws, {_CRC.format("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
w1 AS (SELECT doc_id, ws, h, CAST(len(ws) AS BIGINT) AS n, h // 10 AS g FROM w0),
w2 AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM w1), w3 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM w2),
w AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws FROM w3),
x AS (SELECT doc_id, n, unnest(ws) AS word, unnest(range(n)) AS i FROM w),
s AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND b.i - a.i <= a.n // 2),
t AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM s),
u AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM t GROUP BY doc_id, q, k HAVING count(*) >= greatest({shortest} - q, q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM u GROUP BY 1, 2, 3),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS k FROM r),
lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM r GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS t FROM x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.i = x.i WHERE g.i IS NULL GROUP BY 1)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(lines.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM w LEFT JOIN lines ON lines.doc_id = w.doc_id LEFT JOIN best b ON b.doc_id = w.doc_id AND b.k = 1 LEFT JOIN kept ON kept.doc_id = w.doc_id"""


def _divergence_sql(least_docs: int = 10, top: int = 10) -> str:
    """All kept terms of all groups, in whole numbers."""
    terms = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    p = lambda c, n: f"(1 + (CAST(1000000000 AS HUGEINT) * ({c} + 2)) // ({n} + 2 * v))"
    f = lambda a, b: f"((({a} - {b}) * ({a} - {b})) // ({a} + {b}))"
    return f"""WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS d FROM documents),
x AS (SELECT lang, source, d, unnest({terms}) AS term FROM d),
kept AS (SELECT lang, term FROM x GROUP BY 1, 2 HAVING count(DISTINCT d) >= {least_docs}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
c AS (SELECT x.lang, x.source, x.term, count(*) AS n FROM x JOIN kept k ON k.lang = x.lang AND k.term = x.term GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
tl AS (SELECT lang, sum(total) AS total FROM t GROUP BY 1), cl AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2),
cells AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, {p("coalesce(c.n, 0)", "t.total")} AS p, {p("cl.n", "tl.total")} AS q
  FROM t JOIN kept k ON k.lang = t.lang JOIN v ON v.lang = t.lang JOIN tl ON tl.lang = t.lang JOIN cl ON cl.lang = t.lang AND cl.term = k.term LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum({f("a.p", "b.p")}) AS value FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
tops AS (SELECT lang, source, 'term' AS part, term AS item, CAST({f("p", "q")} AS BIGINT) AS value FROM cells WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM tops) y)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {top}"""


def oracle_sql() -> dict[str, str]:
    """Tokenisation, Unicode folding, binomial bounds, lattices and packing have no SQL form; tests check those."""
    return {
        "op4_warc": _archives_sql(),
        "op6_url_filters": _urls_sql(),
        "op9_ngram_jaccard_join": _groups_sql(),
        "op10_substring_dedup": _repeats_sql(),
        "op11_periodic_runs": _runs_sql(),
        "op13_source_divergence": _divergence_sql(),
    }
