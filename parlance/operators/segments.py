"""Raw transcript segments: cleaning, shifting in time, and marks that people or judges gave to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = "array<struct<start:double,end:double,word:string,text:string,probability:double>>"


def parse_words(words: Column) -> Column:
    """Words with trimmed content (``word``, else ``text``); blank ones go; none left is null, not empty."""
    named = F.transform(
        words,
        lambda w: F.struct(
            F.coalesce(w["start"], F.lit(0.0)).alias("start"),
            F.coalesce(w["end"], F.lit(0.0)).alias("end"),
            F.trim(F.coalesce(w["word"], w["text"], F.lit(""))).alias("content"),
            w["probability"].alias("probability"),
        ),
    )
    kept = F.filter(named, lambda w: F.length(w["content"]) > 0)
    return F.when(F.size(kept) > 0, kept)


def parse_segments(raw: DataFrame) -> DataFrame:
    """Rows with trimmed, non-blank text; missing times are 0."""
    out = raw.withColumns(
        {"content": F.trim("text"), "start": F.coalesce("start", F.lit(0.0)), "end": F.coalesce("end", F.lit(0.0))}
    ).where(F.length("content") > 0)
    return (out.withColumn("words", parse_words(F.col("words"))) if "words" in raw.columns else out).drop("text")


def shift(segs: DataFrame, seconds: float) -> DataFrame:
    """Segment and word times moved by an offset; an offset of 0 changes nothing, any other drops ``speaker_hint``."""
    if seconds == 0:
        return segs
    out = segs.withColumns({"start": F.col("start") + seconds, "end": F.col("end") + seconds})
    if "words" in segs.columns:
        moved = F.transform("words", lambda w: w.withField("start", w["start"] + seconds).withField("end", w["end"] + seconds))
        out = out.withColumn("words", moved)
    return out.withColumn("speaker_hint", F.lit(None).cast("string")) if "speaker_hint" in segs.columns else out


def is_fallback(sections: DataFrame, u: DataFrame, key: str = "conv_id", titles: tuple[str, ...] = ("Розмова", "Conversation")) -> DataFrame:
    """(key, synthetic): whether a recording has the one section that stands for none: a fixed title and the bounds of all rows."""
    s = sections.groupBy(key).agg(F.count("*").alias("n"), F.min("title").alias("t"), F.min("start_ms").alias("a"), F.max("end_ms").alias("b"))
    b = u.groupBy(key).agg(F.min_by("start_ms", "seq").alias("first"), F.max_by("end_ms", "seq").alias("last"))
    same = (F.col("n") == 1) & F.col("t").isin(*titles) & (F.col("a") == F.col("first")) & (F.col("b") == F.col("last"))
    return s.join(b, key).select(key, same.alias("synthetic"))


def human_marks(sheets: DataFrame, marks: tuple[str, ...] = ("better", "worse", "neutral")) -> DataFrame:
    """(sheet_id, segment_idx, n_ticked, mark) of Markdown sheets (sheet_id, text): ``## Segment N`` and one ticked box each.

    ``mark`` is null where not exactly one known box is ticked."""
    parts = sheets.select("sheet_id", F.explode(F.split("text", r"(?m)^## Segment ")).alias("p"))
    idx = F.regexp_extract("p", r"^(\d+)", 1)
    ticked = F.regexp_extract_all("p", F.lit(r"(?mi)^\s*[-*] \[x\] *(\w+)"), F.lit(1))
    known = F.filter(F.transform(ticked, lambda t: F.lower(t)), lambda t: t.isin(*marks))
    rows = parts.where(F.length(idx) > 0).select("sheet_id", idx.cast("int").alias("segment_idx"), F.size(ticked).alias("n_ticked"), known.alias("k"))
    return rows.select("sheet_id", "segment_idx", "n_ticked", F.when((F.col("n_ticked") == 1) & (F.size("k") == 1), F.col("k")[0]).alias("mark"))


def judge_marks(replies: DataFrame, marks: tuple[str, ...] = ("better", "worse", "neutral")) -> DataFrame:
    """(sheet_id, segment_idx, mark, rationale) of JSON replies keyed by segment; a mark out of the domain is null."""
    found = F.from_json("text", "map<string,struct<mark:string,rationale:string>>")
    rows = replies.select("sheet_id", F.explode(found).alias("key", "v")).select(
        "sheet_id", F.expr("try_cast(key AS INT)").alias("segment_idx"), F.lower("v.mark").alias("mark"), "v.rationale"
    )
    return rows.where("segment_idx IS NOT NULL").withColumn("mark", F.when(F.col("mark").isin(*marks), F.col("mark")))


def sweep(results: DataFrame, parameter: str, category: str, domain: list[str]) -> DataFrame:
    """One row for each value of a parameter: rows, counts by category (zeros kept) and the share that changed, in percent."""
    counts = [F.count_if(F.col(category) == d).alias(d) for d in domain]
    hit = F.count_if(F.col(category) != "unchanged")
    return results.groupBy(parameter).agg(F.count("*").alias("total"), *counts, F.bround(hit * 100.0 / F.count("*"), 1).alias("hit_pct"))


def language_cell(language: Column, top1: Column, p1: Column, top2: Column, p2: Column, agreement: Column) -> Column:
    """Language as the header shows it: given by the user, or detected, with the runner-up and how the attempts agreed."""
    second = F.when(top2.isNotNull(), F.format_string(", %s=%.2f", top2, p2)).otherwise("")
    how = F.when(agreement == "agree", ", 2/2 agree").when(agreement == "disagree", ", 2/2 disagree, picked higher prob").otherwise("")
    return F.when(top1.isNull(), F.concat(language, F.lit(" (user-specified)"))).otherwise(
        F.concat(top1, F.lit(" (auto-detected="), F.format_string("%.2f", p1), second, how, F.lit(")"))
    )
