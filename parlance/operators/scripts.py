"""Texts that models and people read: scripts, indexed lists, dialogues, context blocks, summary blocks.

Each is one aggregation (or one window) by recording; rows keep their order by ``seq``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timefmt as tf
from . import sequences as sq
from .intervals import containing

# What stands above the parts of a request for one corrected row.
BEFORE = "[CONTEXT BEFORE — your prior corrections, final form]"
CURRENT = "[CURRENT SEGMENT — fix this one only]"
AFTER = "[CONTEXT AFTER — raw ASR, not yet proofread]"


def who(df: DataFrame, fallback: str | None = "?") -> Column:
    """Name, else speaker, else ``fallback``; empty strings count as missing."""
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    named = [empty("name")] if "name" in df.columns else []
    return F.coalesce(*named, empty("speaker"), F.lit(fallback))


def joined(df: DataFrame, keys: list[str], line: str, order: str, sep: str = "\\n") -> DataFrame:
    """(keys, text): the non-null lines in order."""
    return df.groupBy(*keys).agg(F.expr(f"listagg({line}, '{sep}') WITHIN GROUP (ORDER BY {order})").alias("text"))


def script(u: DataFrame, key: str = "conv_id", pause_ms: int = sq.PAUSE_MS) -> DataFrame:
    """(key, text): ``[HH:MM:SS] who: text`` lines, with a line for each pause of at least ``pause_ms`` before its row."""
    pause = F.expr(f"start_ms - lag(end_ms) OVER (PARTITION BY {key} ORDER BY seq)")
    out = u.withColumn("_p", pause).withColumn("_e", F.expr(f"lag(end_ms) OVER (PARTITION BY {key} ORDER BY seq)"))
    seconds = F.bround(F.col("_p") / 1000, 0).cast("bigint").cast("string")
    gap = F.when(F.col("_p") >= pause_ms, F.concat(F.lit("["), tf.hms_truncated(F.col("_e") / 1000), F.lit(" — pause "), seconds, F.lit("s]")))
    said = F.concat(F.lit("["), tf.hms_truncated(F.col("start_ms") / 1000), F.lit("] "), who(u), F.lit(": "), F.col("content"))
    return joined(out.withColumn("_l", F.concat_ws("\n", gap, said)), [key], "_l", "seq")


def indexed(u: DataFrame, sections: DataFrame, key: str = "conv_id", bucket_ms: int = 3_600_000) -> DataFrame:
    """(key, section, text): ``index: who: text`` lines of each section's rows; rows belong to the section that holds their start."""
    rows = u.withColumn("_t", F.trim("content")).withColumn("_w", who(u))
    hit = containing(rows.select(key, "seq", "start_ms"), sections, key, "start_ms", "i", [key, "seq"], bucket_ms)
    placed = rows.join(hit.select(key, "seq", F.col("_hit.r_i").alias("section")), [key, "seq"])
    idx = F.expr(f"row_number() OVER (PARTITION BY {key}, section ORDER BY seq) - 1").cast("string")
    return joined(placed.withColumn("_l", F.concat(idx, F.lit(": "), F.col("_w"), F.lit(": "), F.col("_t"))), [key, "section"], "_l", "seq")


def dialogue(u: DataFrame, key: str = "conv_id", silence: bool = False) -> DataFrame:
    """(key, text): ``who: text`` lines of speakers' non-blank rows; with ``silence``, a line before the row that follows one."""
    rows = u.withColumn("_w", who(u, None)).withColumn("_t", F.trim("content"))
    line = F.when((F.length("_t") > 0) & F.col("speaker").isNotNull(), F.concat(F.col("_w"), F.lit(": "), F.col("_t")))
    if silence:
        anchors = sq.event_anchors(sq.silence_events(u, key), u, key)
        mark = F.regexp_replace(tf.silence_line(F.col("start_ms") / 1000, F.col("end_ms") / 1000, F.col("kind")), "^[> _]+|_+$", "")
        rows = rows.join(anchors.select(key, "seq", mark.alias("_s")), [key, "seq"], "left")
        line = F.nullif(F.concat_ws("\n", "_s", line), F.lit(""))
    return joined(rows.withColumn("_l", line).where("_l IS NOT NULL"), [key], "_l", "seq")


def blocks(parts: DataFrame, key: str = "conv_id", order: str = "seq") -> DataFrame:
    """(key, text) of titled parts (key, seq, title, content): ``### title`` and the text below it, a blank line between."""
    line = F.concat(F.lit("### "), F.col("title"), F.lit("\n"), F.trim("content"))
    return joined(parts.withColumn("_l", line), [key], "_l", order, "\\n\\n")


def context_line(u: DataFrame) -> Column:
    """``[SPEAKER] text``; without a speaker the text alone."""
    return F.concat(F.coalesce(F.concat(F.lit("["), F.nullif(F.col("speaker"), F.lit("")), F.lit("] ")), F.lit("")), F.col("content"))


def user_content(text: Column, before: Column, after: Column) -> Column:
    """The request for one row: the bare text, or labelled parts where there is context on either side."""
    some = lambda c: F.nullif(c, F.lit(""))
    head = F.concat(F.lit(BEFORE + "\n"), some(before), F.lit("\n"))
    tail = F.concat(F.lit("\n" + AFTER + "\n"), some(after))
    labelled = F.concat_ws("\n", head, F.concat(F.lit(CURRENT + "\n"), text), tail)
    return F.when(some(before).isNull() & some(after).isNull(), text).otherwise(labelled)


def requests(u: DataFrame, key: str = "conv_id", n: int = 3) -> DataFrame:
    """``u`` plus ``request``: each row with the ``n`` rows on either side as they are."""
    out = sq.neighbour_context(u, key, n)
    return out.withColumn("request", user_content(F.col("content"), F.col("before"), F.col("after"))).drop("before", "after")
