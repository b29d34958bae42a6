"""URL filters by expansion and hash prefixes, in DataFrame functions only.

Every URL expands into host suffixes x path prefixes (those that end in ``/``, and the empty one), at the depths that occur in
the rules and no others: an expression at any other depth equals no rule's. A rule is filed under its host and the part of its path up to the
last ``/``; both sides meet in an equi-join on a short prefix of the expression's SHA-256 digest. What meets is then
confirmed by the full digest and by the rule's whole path, and the longest rule wins (``block`` before ``allow`` where
two rules have the same text).

Up to ``broadcast_rules`` rules of at most ``DEPTHS`` depths, an URL's row is joined once for each depth with the rules filed
under a digest prefix: no row is copied, numbered or shuffled. Beyond that the distinct (host, path) are expanded into rows, joined
with the rules (repeated over ``salts``, so that an expression that nearly all URLs share is spread over as many tasks), and what
they won is joined back, salted too.

Defined results: a null URL or one without ``://`` has empty host and path and fits no rule;
repeated rows each get their own row; empty tables give empty results; a rule fits an URL with an
empty path only if its own path is empty; the order and the partitions of the rows do not matter; further columns of the pages,
whatever their names, are kept by :func:`judge_urls`, whose new columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, load

NAME = "op4_url_filters"
#: (verdict, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
PREFIX_HEX = 8  # 4 bytes of the digest
DEPTHS = 24
NEW = ("host", "path", "rule", "verdict")


def host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` plus ``host`` and ``path``, which replace columns of the same name."""
    at = f"instr(`{url}`, '://')"
    rest = F.expr(f"CASE WHEN {at} > 0 THEN substring(`{url}`, {at} + 3) ELSE '' END")
    rest = F.coalesce(rest, F.lit(""))
    kept = [c for c in df.columns if c not in ("host", "path")]
    return df.select(
        *[F.col(f"`{c}`") for c in kept],
        ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules with the digest of what they are filed under."""
    return file_rules(spark.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string"))


def digest(host: Column, prefix: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, prefix), 256)


def file_rules(df: DataFrame) -> DataFrame:
    """Rules (verdict, rule_host, rule_path) with the digest, its short prefix, and the depths of what they are filed under."""
    filed = F.regexp_extract("rule_path", "^(?s)(.*/)?", 0)
    return (
        df.dropna(subset=["verdict", "rule_host", "rule_path"])
        .withColumn("rule_host", ascii_lower(F.col("rule_host")))
        .dropDuplicates(["verdict", "rule_host", "rule_path"])
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .withColumn("labels", count_of(F.col("rule_host"), ".") + 1)
        .withColumn("slashes", count_of(filed, "/"))
        .withColumn("digest", digest(F.col("rule_host"), filed))
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    )


def count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def expression(labels: int, slashes: int, host: str = "host", path: str = "path") -> tuple[Column, Column, Column]:
    """(exists, host suffix of so many labels, path prefix of so many slashes)."""
    exists = (count_of(F.col(host), ".") + 1 >= labels) & (count_of(F.col(path), "/") >= slashes)
    prefix = F.concat(F.substring_index(path, "/", slashes), F.lit("/")) if slashes else F.lit("")
    return exists, F.substring_index(host, ".", -labels), prefix


def best(fits: Column) -> Column:
    """The longest of an array of rules; null for none."""
    ranked = F.transform(
        fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), (r["verdict"] == "block").alias("b"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))
    )
    return F.array_max(ranked)


RULE = ("digest", "rule_path", "rule", "verdict")


def by_depth(rows: DataFrame, rules: DataFrame, depths: list[tuple[int, int]]) -> DataFrame:
    """``rows`` (row, host, path) plus ``won``; one join for each depth with the rules of a digest prefix, which has one row."""
    filed = F.broadcast(rules.groupBy("short").agg(F.collect_list(F.struct(*RULE)).alias("filed")))
    found = []
    for k, (labels, slashes) in enumerate(depths):
        exists, suffix, prefix = expression(labels, slashes)
        rows = rows.withColumn(f"full{k}", F.when(exists, digest(suffix, prefix)))
        rows = rows.join(filed.select(F.col("short").alias(f"short{k}"), F.col("filed").alias(f"filed{k}")), F.substring(f"full{k}", 1, PREFIX_HEX) == F.col(f"short{k}"), "left")
        found.append(best(F.expr(f"filter(filed{k}, r -> r.digest = full{k} AND startswith(path, r.rule_path))")))
    won = found[0] if len(found) == 1 else F.greatest(*found)
    return rows.select("row", "host", "path", won.alias("won"))


def by_rows(rows: DataFrame, rules: DataFrame, depths: list[tuple[int, int]], few: bool, salts: int) -> DataFrame:
    """As :func:`by_depth`, by way of rows for each expression of the distinct (host, path)."""
    urls = rows.select("host", "path").distinct()
    each = []
    for labels, slashes in depths:
        exists, suffix, prefix = expression(labels, slashes)
        each.append(F.when(exists, digest(suffix, prefix)))
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    met = urls.withColumn("full", F.explode(F.array_distinct(F.array_compact(F.array(*each))))).withColumn("short", F.substring("full", 1, PREFIX_HEX))
    known = rules.select("short", *RULE)
    if few:
        met = met.join(F.broadcast(known), "short")
    else:
        met = met.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int")).join(known.withColumn("salt", spread), ["short", "salt"])
    fits = met.where((F.col("digest") == F.col("full")) & F.col("path").startswith(F.col("rule_path")))
    won = fits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("b"), "rule", "verdict")).alias("won")
    )
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row", "path"), F.lit(salts)).cast("int"))
    return rows.join(won.withColumn("salt", spread), ["host", "path", "salt"], "left").select("row", "host", "path", "won")


def judge_urls(
    df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_rules: int = 100_000, salts: int = 32, most_depths: int = DEPTHS
) -> DataFrame:
    """All rows and columns of ``df`` plus ``host``, ``path``, ``rule`` and ``verdict``."""
    kept = [c for c in df.columns if c not in NEW]
    # the row's own columns travel inside a struct, so none of their names can clash
    rows = host_path(df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{url}`").alias("url"))).drop("url")
    # distinct pairs of depths of the rules: host labels x path depth, whatever the number of rules
    depths = sorted((r["labels"], r["slashes"]) for r in rules.select("labels", "slashes").distinct().collect())
    if not depths:
        judged = rows.withColumn("won", F.lit(None).cast("struct<rule:string,verdict:string>"))
    else:
        few = rules.limit(broadcast_rules + 1).count() <= broadcast_rules
        judged = by_depth(rows, rules, depths) if few and len(depths) <= most_depths else by_rows(rows, rules, depths, few, salts)
    return judged.select(
        *[F.col(f"row.`{c}`") for c in kept], "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r"""
