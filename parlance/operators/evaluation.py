"""Measurements of runs: grids of parameters scored against the truth, gates of device runs, sheets for people and judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timefmt as tf
from .intervals import BUCKET_MS, argmax_interval


def parse_grid(spec: str) -> list[int]:
    """Comma list of integers of at least 0; an empty list, or anything else in it, is an error."""
    parts = [p.strip() for p in spec.split(",")]
    values = [int(p) for p in parts if p]
    if not values or min(values) < 0:
        raise ValueError(f"a grid needs integers of at least 0: {spec!r}")
    return values


def grid_scores(words: DataFrame, turns: dict, keys: list[str], key: str, turn: str, owner: str, name: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(name, words, good): for each value of a parameter, how many words (with ``truth``) the turns found with it give to their owner.

    The values of a grid are few; each is joined on its own and counted before the counts come together."""
    out = None
    for value, found in turns.items():
        owned = argmax_interval(words, found, keys, key, turn, owner, bucket_ms)
        one = owned.agg(F.count("*").alias("words"), F.count_if(F.col("owner") == F.col("truth")).alias("good")).select(F.lit(value).alias(name), "words", "good")
        out = one if out is None else out.unionByName(one)
    return out


def gates(runs: DataFrame) -> DataFrame:
    """``runs`` plus ``failures``: what shows that a run on a device was none, joined by ``; `` in order of the text; null if all is well.

    Runs: config (``device``, ``device-trace`` or another), available, allocated, driver_before, driver_after, fallbacks."""
    on_device = F.col("config").isin("device", "device-trace")
    unused = (F.col("allocated") == 0) & (F.col("driver_after") <= F.col("driver_before"))
    found = F.array(
        F.when(on_device & ~F.col("available"), "device not available"),
        F.when(on_device & unused, "no device memory was used"),
        F.when((F.col("config") == "device") & (F.col("fallbacks") > 0), "operators fell back"),
    )
    return runs.withColumn("failures", F.nullif(F.array_join(F.array_sort(F.array_compact(found)), "; "), F.lit("")))


def finite(x: Column) -> Column:
    """Null for NaN, which JSON has no word for."""
    return F.when(~F.isnan(x), x)


def flat(text: Column) -> Column:
    """Text for a cell of a Markdown table."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def spot_check(rows: DataFrame, head: str, sheet: str = "sheet_id") -> DataFrame:
    """(sheet, text) for people to mark: rows (sheet, segment_idx, start_s, end_s, speaker, asr_text, proofread_text), three empty boxes each."""
    line = F.format_string(
        "## Segment %d — timestamp %s-%s (speaker: %s)\n\n**ASR (merge):** %s\n**Proofread:**  %s\n\n- [ ] better\n- [ ] worse\n- [ ] neutral\n",
        "segment_idx", tf.minutes_seconds(F.col("start_s")), tf.minutes_seconds(F.col("end_s")), F.coalesce(F.nullif("speaker", F.lit("")), F.lit("?")), "asr_text", "proofread_text",
    )
    text = F.concat(F.lit(head + "\n\n"), F.expr("listagg(_l, '\n') WITHIN GROUP (ORDER BY segment_idx)"))
    return rows.withColumn("_l", line).groupBy(sheet).agg(text.alias("text"))


def boundary_rows(rows: DataFrame) -> DataFrame:
    """``rows`` plus ``line``: a row of the table of judged boundaries; what was not measured is an empty cell."""
    number = lambda c, f: F.coalesce(F.format_string(f, finite(F.col(c))), F.lit(""))
    shown = lambda c, f: F.when(finite(F.col(c)).isNull(), F.lit("")).otherwise(number(c, f))
    cells = [
        F.col("boundary").cast("string"), tf.minutes_seconds(F.col("cutoff_s")), F.col("verdict"), shown("gap_s", "%.2f"), shown("jaccard", "%.3f"),
        shown("rms_before", "%.4f"), shown("rms_after", "%.4f"), flat(F.col("note")),
    ]
    return rows.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")))
