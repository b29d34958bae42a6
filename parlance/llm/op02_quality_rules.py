"""Quality rules as a short-circuit cascade, in DataFrame functions only.

The base measures (words, symbols, repeated lines, repeated 3-word windows) are always
computed, as they are part of the result. The remaining rules form a cascade: each one's
cost (time) and selectivity (share rejected) are estimated on a bounded sample, the rules
are ordered by rejection per cost, and a ``CASE`` evaluates them one after another, so a
document that one rule rejects costs nothing in the later ones. The order never changes
a verdict; it only changes ``rejected_by`` and the time.

Defined results: a null, empty or blank text has no words, zero measures and fails the base;
repeated rows each get their own row; an empty table gives an empty result; further columns
of the input are ignored by the query and kept by :func:`quality_cascade`, whose new columns
replace columns of the same name.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, load, words, written

NAME = "op2_quality_rules"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = "[#*$%&|<>]+"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is SQL over the text column ``text`` and the measures; null counts as false."""

    name: str
    rejects: str


#: The rules of the production cascade. Counts compare as integers, so no rounding is involved.
RULES = (
    Rule("symbol_density", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("shouting", r"2 * length(regexp_replace(text, '\\P{Lu}+', '')) > length(regexp_replace(text, '\\P{L}+', ''))"),
    Rule("few_letters", r"2 * length(regexp_replace(text, '\\P{L}+', '')) < word_chars"),
)


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base measures, ``n_lines`` and ``base_failed``; no shuffle, no Python."""
    raw = F.coalesce(F.col(text), F.lit(""))
    df = df.drop(*MEASURES, "n_lines", "base_failed", "_w", "_h", "_s", "_l")
    df = df.withColumn("_w", words(F.col(text)))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    df = df.withColumn("n_symbols", (F.length(raw) - F.length(F.regexp_replace(raw, SYMBOLS, ""))).cast("long"))
    df = df.withColumn("_l", F.filter(F.split(raw, "\n"), lambda x: x.rlike(f"[^{SPACES}]")))
    df = df.withColumn("n_lines", F.size("_l").cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    df = df.withColumn(
        "_h",
        F.expr(
            "CASE WHEN size(_w) < 3 THEN cast(array() AS array<bigint>) "
            "ELSE transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) END"
        ),
    )
    # Windows sorted by hash bring equal ones together: n log n for a text of any length.
    df = df.withColumn(
        "_s",
        F.expr(
            "CASE WHEN size(array_distinct(_h)) = size(_h) THEN cast(array() AS array<struct<h:bigint,i:int>>) "
            "ELSE sort_array(transform(_h, (h, i) -> struct(h, i))) END"
        ),
    )
    df = df.withColumn(
        "_s",
        F.expr(
            "transform(filter(_s, (x, j) -> (j > 0 AND _s[j - 1].h = x.h) "
            "OR (j < size(_s) - 1 AND _s[j + 1].h = x.h)), x -> x.i)"
        ),
    )
    df = df.withColumn(
        "n_repeat_words",
        F.expr("cast(size(array_distinct(concat(_s, transform(_s, p -> p + 1), transform(_s, p -> p + 2)))) AS bigint)"),
    )
    df = df.withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )
    return df.drop("_w", "_l", "_h", "_s")


def estimate(df: DataFrame, rules=RULES, text: str = "text", sample_rows: int = 200, repeats: int = 25) -> list[Rule]:
    """Rules ordered by rejection per cost, measured on a random sample of at most ``sample_rows`` documents, drawn from all partitions.

    Drawing it scans the texts once more, without any measure; the sample stays in the shared folder. Each rule runs ``repeats`` times over it; the time of an empty run is taken off.
    Rules that reject nothing in the sample go last, the cheapest first."""
    texts = df.select(F.col(text).alias("text")).where(F.col(text).isNotNull())
    n = max(df.count(), 1)
    share = min(1.0, 2.0 * sample_rows / n)
    picked = texts if share == 1.0 else texts.sample(fraction=share, seed=11)
    sample = written(measures(picked.limit(sample_rows)).coalesce(1), "op2-sample")
    held = sample.count()
    if not held:
        return list(rules)
    many = sample.coalesce(1).withColumn("_again", F.explode(F.array_repeat(F.lit(1), repeats)))

    def run(sql: str) -> tuple[float, int]:
        began = time.perf_counter()
        # rand() keeps the optimizer from evaluating the rule once for all repeats
        flags = many.select(F.expr(f"coalesce({sql}, false) AND rand(7) >= 0").cast("int").alias("x"))
        hit = flags.agg(F.sum("x").alias("n")).first()["n"]
        return time.perf_counter() - began, hit // repeats

    run("false")
    floor = run("false")[0]
    ranked = []
    for k, rule in enumerate(rules):
        took, hit = run(rule.rejects)
        cost = max(took - floor, 1e-4)
        ranked.append((-(hit / held) / cost, cost, k, rule))
    return [x[-1] for x in sorted(ranked, key=lambda x: x[:3])]


def verdict(rules) -> Column:
    """Name of the first rule that rejects, in order; null if none does. Lazily evaluated."""
    col = F.when(F.col("base_failed"), F.lit("base"))
    for rule in rules:
        col = col.when(F.coalesce(F.expr(rule.rejects), F.lit(False)), F.lit(rule.name))
    return col


def quality_cascade(df: DataFrame, rules=RULES, text: str = "text", order: bool = True) -> DataFrame:
    """All rows and columns of ``df`` plus measures, ``base_failed``, ``rejected_by``, ``kept``."""
    rules = estimate(df, rules, text) if order else list(rules)
    out = measures(df.drop("rejected_by", "kept"), text)
    named = out if text == "text" else out.withColumn("text", F.col(text))
    # The verdict passes through a generator of one row: the optimizer pushes no filter below it. A filter on ``kept`` would else be
    # rewritten into the measures' expressions, whose size multiplies with every step.
    judged = named.withColumn("_v", F.explode(F.array(F.struct(verdict(rules).alias("rejected_by")))))
    return judged.withColumn("rejected_by", F.col("_v.rejected_by")).withColumn("kept", F.col("_v.rejected_by").isNull()).drop("_v")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_cascade(docs).select("doc_id", *MEASURES, "n_lines", "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the cascade keeps, with their own columns only."""
    return quality_cascade(docs).where("kept").select(*docs.columns)


def measures_sql(table: str) -> str:
    """DuckDB SQL for the measures of ``table`` with all its columns."""
    return rf"""
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
  SELECT * EXCLUDE (_w, _l, _t),
    len(_w)::BIGINT AS n_words, length(array_to_string(_w, ''))::BIGINT AS word_chars,
    (length(_t) - length(regexp_replace(_t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
    len(_l)::BIGINT AS n_lines, (len(_l) - len(list_distinct(_l)))::BIGINT AS n_dup_lines,
    coalesce((SELECT count(DISTINCT p) FROM (
      SELECT unnest([i, i + 1, i + 2]) AS p FROM (
        SELECT i, count(*) OVER (PARTITION BY g) AS c FROM (
          SELECT i, _w[i] || ' ' || _w[i + 1] || ' ' || _w[i + 2] AS g
          FROM (SELECT unnest(range(1, len(_w) - 1)) AS i))) WHERE c > 1)), 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, coalesce(text, '') AS _t,
      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS _w,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS _l
    FROM {table}))"""


#: True where the cascade rejects a document that passed the base.
REJECTS_SQL = r"""(10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words
  OR word_chars > 20 * n_words
  OR 2 * length(regexp_replace(text, '\P{Lu}+', '', 'g')) > length(regexp_replace(text, '\P{L}+', '', 'g'))
  OR 2 * length(regexp_replace(text, '\P{L}+', '', 'g')) < word_chars)"""

ORACLE = f"""
SELECT doc_id, {", ".join(MEASURES)}, n_lines, base_failed,
  NOT base_failed AND NOT coalesce({REJECTS_SQL}, false) AS kept
FROM ({measures_sql("documents")})"""
