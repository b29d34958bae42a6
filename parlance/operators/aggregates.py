"""Aggregations: naming, votes, histograms, agreement, verdicts, timings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The colours of speakers, in order of first appearance.
PALETTE = ["🔵", "🟢", "🔴", "🟡", "🟣", "🟠", "🟤", "⚪️", "⚫️"]


def first_appearance(u: DataFrame, key: str = "conv_id") -> DataFrame:
    """Start of each speaker's first row in list order, and the rank of speakers by it."""
    return u.sparkSession.sql(
        f"""
SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY first_seq) - 1 AS rank FROM (
  SELECT {key}, speaker, min_by(start_ms, seq) AS first_ms, min(seq) AS first_seq FROM {{u}} WHERE speaker IS NOT NULL GROUP BY {key}, speaker)""",
        u=u,
    )


def snippets(u: DataFrame, key: str = "conv_id", window_ms: int = 60_000) -> DataFrame:
    """What each speaker says within ``window_ms`` of their first row."""
    return u.sparkSession.sql(
        f"""
SELECT u.{key}, u.speaker, trim(listagg(u.content, ' ') WITHIN GROUP (ORDER BY u.seq)) AS snippet
FROM {{u}} u JOIN {{f}} f ON u.{key} = f.{key} AND u.speaker = f.speaker AND u.start_ms < f.first_ms + {window_ms} GROUP BY u.{key}, u.speaker""",
        u=u,
        f=first_appearance(u, key),
    )


def emoji_map(u: DataFrame, palette: list[str], key: str = "conv_id") -> DataFrame:
    """Speakers with the palette's entries in order of first appearance, from the start again when it ends."""
    entry = F.element_at(F.array(*map(F.lit, palette)), (F.col("rank") % len(palette) + 1).cast("int"))
    return first_appearance(u, key).select(key, "speaker", "rank", entry.alias("emoji"))


def top_two(p: DataFrame, keys: list[str], label: str = "label", prob: str = "prob", least: float = 0.05) -> DataFrame:
    """The most probable label and the next, if that has at least ``least``."""
    k = ", ".join(keys)
    return p.sparkSession.sql(
        f"""
SELECT {k}, max(CASE WHEN r = 1 THEN {label} END) AS top1, max(CASE WHEN r = 1 THEN {prob} END) AS p1,
  max(CASE WHEN r = 2 AND {prob} >= {least} THEN {label} END) AS top2, max(CASE WHEN r = 2 AND {prob} >= {least} THEN {prob} END) AS p2
FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {prob} DESC, {label}) AS r FROM {{p}}) WHERE r <= 2 GROUP BY {k}""",
        p=p,
    )


def vote(attempts: DataFrame, key: str) -> DataFrame:
    """Attempts (key, attempt, label, prob) as one label: the surer wins, the first on ties; ``agreement`` is single, agree or disagree."""
    return attempts.groupBy(key).agg(
        F.max(F.struct("prob", (-F.col("attempt")).alias("a"), "label")).alias("_w"), F.count("*").alias("_n"), F.count_distinct("label").alias("_d")
    ).select(key, F.col("_w.label").alias("label"), F.when(F.col("_n") == 1, "single").when(F.col("_d") == 1, "agree").otherwise("disagree").alias("agreement"))


def majority(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent non-null value; ties go to the one seen first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("_o"))
    return counts.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("_o")).alias("o"), value)).alias("_m")).select(*keys, F.col(f"_m.{value}").alias(value), F.col("_m.n").alias("votes"))


def histogram(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Counts over a fixed domain, zeros included, with the share in percent (one decimal, ties to even)."""
    counts = df.agg(F.count("*").alias("_all"), *[F.count_if(F.col(column) == d).alias(f"_{i}") for i, d in enumerate(domain)])
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("category"), F.col(f"_{i}").alias("n")) for i, d in enumerate(domain)]))
    out = counts.select("_all", rows.alias("_r")).select("_all", "_r.*")
    return out.select("category", "n", F.when(F.col("_all") == 0, F.lit(0.0)).otherwise(F.bround(F.col("n") * 100.0 / F.col("_all"), 1)).alias("pct"))


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows, agreeing rows, and their share in percent."""
    return pairs.agg(F.count("*").alias("common"), F.count_if(F.col(a) == F.col(b)).alias("agreed")).withColumn(
        "pct", F.when(F.col("common") == 0, F.lit(0.0)).otherwise(F.bround(F.col("agreed") * 100.0 / F.col("common"), 1))
    )


def confusion(pairs: DataFrame, a: str, b: str, domain: list) -> DataFrame:
    """Counts for each pair of a domain, zeros included: one pass, no join."""
    cells = [(x, y) for x in domain for y in domain]
    counts = pairs.agg(*[F.count_if((F.col(a) == x) & (F.col(b) == y)).alias(f"_{i}") for i, (x, y) in enumerate(cells)])
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias(a), F.lit(y).alias(b), F.col(f"_{i}").alias("n")) for i, (x, y) in enumerate(cells)]))
    return counts.select(rows.alias("_r")).select("_r.*")


def verdict_rollup(marks: DataFrame, column: str = "verdict", least: float = 0.10) -> DataFrame:
    """Counts of each verdict, those that matter, their rate, and the decision at ``least``."""
    names = ["clean", "missing", "duplicated", "truncated"]
    out = marks.agg(F.count("*").alias("total"), *[F.count_if(F.col(column) == v).alias(v) for v in names])
    material = F.col("missing") + F.col("duplicated") + F.col("truncated")
    rate = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(material / F.col("total"))
    return out.withColumn("material", material).withColumn("rate", F.bround(rate, 4)).withColumn("decision", F.when(rate >= least, "act").otherwise("keep"))


def baseline_delta(now: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer difference of two histograms; what is missing counts as 0."""
    a, b = now.select(key, F.col(value).alias("_now")), before.select(key, F.col(value).alias("_was"))
    return a.join(b, key, "full_outer").select(
        key, F.coalesce("_now", F.lit(0)).alias("now"), F.coalesce("_was", F.lit(0)).alias("was"), (F.coalesce("_now", F.lit(0)) - F.coalesce("_was", F.lit(0))).alias("delta")
    )


def key_mismatch(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: (key, side)."""
    one = a.select(key).join(b.select(key), key, "left_anti").distinct().withColumn("side", F.lit("left"))
    return one.unionByName(b.select(key).join(a.select(key), key, "left_anti").distinct().withColumn("side", F.lit("right")))


def stages_by_model(stages: DataFrame, key: str = "recording_id") -> DataFrame:
    """(key, seq, model, stage, elapsed): a recording's stages in execution order, the model named on its first row only."""
    return stages.sparkSession.sql(
        f"""
SELECT {key}, seq, stage, elapsed, CASE WHEN row_number() OVER (PARTITION BY {key}, model ORDER BY seq) = 1 THEN model END AS model FROM {{s}}""",
        s=stages,
    )


def stage_totals(timings: DataFrame, keys: list[str], value: str = "elapsed") -> DataFrame:
    """Seconds added up by stage, model, or whatever ``keys`` are; a stage may have run in several parts."""
    return timings.groupBy(*keys).agg(F.sum(value).alias(value), F.count("*").alias("parts"))


def given_names(u: DataFrame, names: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, speaker, name, source): names (key, i, name) given by a user, to speakers in order of first appearance; further speakers stay unnamed."""
    ranked = first_appearance(u, key).select(key, "speaker", "rank")
    return ranked.join(names.select(key, F.col("i").alias("rank"), "name"), [key, "rank"]).select(key, "speaker", "name", F.lit("user-specified").alias("source"))


def apply_names(u: DataFrame, names: DataFrame, key: str = "conv_id") -> DataFrame:
    """``u`` with ``name`` from (key, speaker, name); rows of other speakers keep theirs, or null."""
    own = F.col("name") if "name" in u.columns else F.lit(None).cast("string")
    found = names.select(key, "speaker", F.col("name").alias("_n"))
    return u.join(found, [key, "speaker"], "left").withColumn("name", F.coalesce("_n", own)).drop("_n")


def name_sources(u: DataFrame, names: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, speaker, source) of every speaker: where the name came from, or ``unidentified``."""
    all_speakers = u.where("speaker IS NOT NULL").select(key, "speaker").distinct()
    return all_speakers.join(names.select(key, "speaker", "source"), [key, "speaker"], "left").withColumn("source", F.coalesce("source", F.lit("unidentified")))


def label_owners(u: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, label, speaker, first_seq): the first speaker that goes by each label; a name is a label, and a speaker without one."""
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    label = F.coalesce(empty("name"), empty("speaker")) if "name" in u.columns else empty("speaker")
    return u.where("speaker IS NOT NULL").groupBy(key, label.alias("label")).agg(F.min_by("speaker", "seq").alias("speaker"), F.min("seq").alias("first_seq"))


def top_n(p: DataFrame, keys: list[str], label: str = "label", prob: str = "prob", n: int = 3) -> DataFrame:
    """The ``n`` most probable labels (a report, so the limit is the feature); ties in order of the label."""
    k = ", ".join(keys)
    return p.sparkSession.sql(
        f"SELECT * FROM (SELECT {k}, {label}, {prob}, row_number() OVER (PARTITION BY {k} ORDER BY {prob} DESC, {label}) AS rank FROM {{p}}) WHERE rank <= {n}", p=p
    )


def common_marks(human: DataFrame, judge: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows marked by both: key, human, judge), (keys that only one side marked: key, side). Inputs: key, mark."""
    both = human.select(key, F.col("mark").alias("human")).join(judge.select(key, F.col("mark").alias("judge")), key)
    return both, key_mismatch(human, judge, key)


def all_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of either side, once each."""
    return a.select(key).union(b.select(key)).distinct()


def pattern_counts(messages: DataFrame, text: str, pattern: str, rest: str = "<unparsed>") -> DataFrame:
    """(op, n): messages by what the pattern's first group holds; those without a match count as ``rest``."""
    found = F.regexp_extract(text, pattern, 1)
    return messages.groupBy(F.when(F.length(found) > 0, found).otherwise(rest).alias("op")).agg(F.count("*").alias("n"))


def resolve_names(c: DataFrame, key: str = "conv_id") -> DataFrame:
    """Candidates (key, speaker, name, confidence, first_ms): low confidence and bad names go; of speakers who claim one name the surest
    keeps it, then the first to appear."""
    return c.sparkSession.sql(
        f"""
SELECT {key}, speaker, name FROM (
  SELECT *, row_number() OVER (PARTITION BY {key}, name ORDER BY CASE confidence WHEN 'high' THEN 0 ELSE 1 END, first_ms, speaker) AS r
  FROM (SELECT {key}, speaker, trim(name) AS name, confidence, first_ms FROM {{c}} WHERE confidence IN ('high', 'medium') AND trim(name) RLIKE '(?s)^\\\\p{{{{Lu}}}}.')) WHERE r = 1""",
        c=c,
    )


def reduce_groups(df: DataFrame, keys: list[str], order: str, value: str, width: int = 7) -> DataFrame:
    """One level of a reduce tree: every ``width`` rows in order become one, joined by blank lines; a single one passes through."""
    k = ", ".join(keys)
    return df.sparkSession.sql(
        f"""
SELECT {k}, grp AS {order}, listagg({value}, '\\n\\n') WITHIN GROUP (ORDER BY {order}) AS {value}, count(*) AS n FROM (
  SELECT *, (row_number() OVER (PARTITION BY {k} ORDER BY {order}) - 1) DIV {width} AS grp FROM {{d}}) GROUP BY {k}, grp""",
        d=df,
    )
