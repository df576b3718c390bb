"""URL rules, indexed by their rarest literal token; URL tokens fetch candidates, and only those run expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import small_side, written

#: Tokens are runs of these; everything else parts them.
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """A rule on a host (with its subdomains) and a path's beginning, or else a pattern searched in the whole URL.

    literals: strings that every URL that the pattern matches holds as whole tokens; either: strings of which it holds
    one or more as a whole token, if there are no literals. Neither: the pattern always runs.
    """

    verdict: str
    host: str = ""
    path: str = ""
    pattern: str = ""
    literals: tuple[str, ...] = ()
    either: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return self.host + self.path if self.host else self.pattern


#: The listed rules: those on hosts and paths come before patterns.
SITE_RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: Patterns for the other URLs (searched in the lower-cased URL).
PATTERN_RULES = (
    Rule("block", pattern=r"^[a-z]+://([^/?#]*\.)?spam-farm\.", literals=("spam", "farm")),
    Rule("block", pattern=r"^[a-z]+://([^/?#]*\.)?(ads|adserver|doubleclick|casino)\.", either=("ads", "adserver", "doubleclick", "casino")),
    Rule("block", pattern=r"[?&]sessionid=", literals=("sessionid",)),
    Rule("block", pattern=r"/wp-login\.php", literals=("wp", "login")),  # php may go on, as in .php5
    Rule("block", pattern=r"\.(apk|dmg|exe|msi)([?#]|$)", either=("apk", "dmg", "exe", "msi")),
)


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def literal_tokens(rule: Rule) -> tuple[str, ...]:
    """Tokens that every URL that the rule fits holds: those of the host; of a path only those that end inside it."""
    if not rule.host:
        return rule.literals
    path = re.findall(TOKEN + r"(?=[^a-z0-9])", rule.path) if rule.path == rule.path.lower() else []
    return tuple(re.findall(TOKEN, rule.host)) + tuple(path)


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """One row for each rule, or for each of its alternatives (variant), any of which fetches it."""
    keys = [[(t,) for t in r.either] if r.either and not literal_tokens(r) else [literal_tokens(r)] for r in rules]
    rows = [(i, k, r.verdict, r.host, r.path, r.pattern, r.name, list(dict.fromkeys(key))) for i, r in enumerate(rules) for k, key in enumerate(keys[i])]
    return spark.createDataFrame(rows, "rule_id int, variant int, rule_verdict string, rule_host string, rule_path string, pattern string, name string, literals array<string>")


def index_rules(urls: DataFrame, rules: DataFrame, rows: int = 0) -> DataFrame:
    """Rules (so many rows) with `token`: the literal that the fewest of the URLs (column tokens) hold; null where there is none."""
    wanted = rules.select(F.explode("literals").alias("w")).distinct()
    held = urls.select(F.explode("tokens").alias("t"))
    counts = held.join(small_side(wanted, rows), F.col("t") == F.col("w"), "left_semi").groupBy("t").agg(F.count("*").alias("df"))
    best = rules.select("rule_id", "variant", F.explode("literals").alias("w")).join(counts, F.col("w") == F.col("t"), "left")
    best = best.groupBy("rule_id", "variant").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("w").alias("token"))).alias("b")).select(F.col("rule_id").alias("__r"), F.col("variant").alias("__v"), "b.token")
    return rules.join(best, (F.col("rule_id") == F.col("__r")) & (F.col("variant") == F.col("__v")), "left").drop("__r", "__v")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = SITE_RULES + PATTERN_RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The verdict on every URL.

    Returns id_col, host, path, rule (host and path of the longest site rule that fits, else null), verdict (that
    rule's; else block if a pattern rule of that verdict is found, allow if one of that one, else the default) and
    pattern (the first pattern found where no site rule fits). A null URL, or one without ://, has an empty host and
    path, and only patterns can find it. Rows are judged each; an empty table gives an empty result; other columns are
    left out. rules may be a table as rule_table makes it. It is broadcast if its counted rows are few enough.
    """
    spark = pages.sparkSession
    src = pages.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("__url"))
    urls = src.where("__url is not null").select("__url").distinct().select("__url", F.array_distinct(F.regexp_extract_all(_lower(F.col("__url")), F.lit(TOKEN), F.lit(0))).alias("tokens"))
    table = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    n = table.count()
    indexed = small_side(index_rules(urls, table, n), n)
    # a rule without a literal is fetched by the empty token
    asked = urls.select("__url", F.explode(F.array_append("tokens", F.lit(""))).alias("__t"))
    candidates = asked.join(indexed, F.col("__t") == F.coalesce("token", F.lit("")))
    h, p = host_of(F.col("__url")), path_of(F.col("__url"))
    site = F.col("rule_host") != ""
    fits = F.when(site, ((h == F.col("rule_host")) | h.endswith(F.concat(F.lit("."), F.col("rule_host")))) & p.startswith(F.col("rule_path"))).otherwise(F.regexp_like(_lower(F.col("__url")), F.col("pattern")))
    won = candidates.where(fits).groupBy("__url").agg(
        F.max(F.when(site, F.struct(F.length("name").alias("n"), (-F.col("rule_id")).alias("o"), F.col("name").alias("name"), F.col("rule_verdict").alias("v")))).alias("s"),
        F.min(F.when(~site, F.struct(F.col("rule_id").alias("o"), F.col("name").alias("name"), F.col("rule_verdict").alias("v")))).alias("q"),
    )
    # written, so that a URL of very many rows may be split; rows without a URL have no part in the join
    won = written(won.withColumnRenamed("__url", "__w"), "won")
    judged = src.where("__url is not null").join(won, F.col("__url") == F.col("__w"), "left").unionByName(src.where("__url is null"), allowMissingColumns=True)
    url = F.coalesce("__url", F.lit(""))
    return judged.select(
        F.col("__id").alias(id_col),
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        F.col("s.name").alias("rule"),
        F.coalesce("s.v", "q.v", F.lit(default)).alias("verdict"),
        F.when(F.col("s").isNull(), F.col("q.name")).alias("pattern"),
    )
