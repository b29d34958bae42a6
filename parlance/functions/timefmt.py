"""Column functions on times: thresholds, rounding and the formats of the rendered documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def auto_silence_ms(total_ms: Column) -> Column:
    """5 s up to 60 s of recording, 15 s from 300 s on, linear between."""
    return (5000 + F.greatest(F.lit(0), F.least(F.lit(240_000), total_ms - 60_000)) / 24).cast("bigint")


def to_ms(seconds: Column) -> Column:
    """Truncates toward zero."""
    return (seconds * 1000).cast("bigint")


def two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def hms(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds."""
    s = seconds.cast("bigint")
    hours = F.floor(s / 3600)
    return F.concat_ws(":", F.when(hours > 99, hours.cast("string")).otherwise(two(hours)), two(F.floor(s / 60) % 60), two(s % 60))


def hms_rounded(seconds: Column) -> Column:
    return hms(F.bround(seconds, 0))


def hms_truncated(seconds: Column) -> Column:
    return hms(seconds.cast("bigint"))


def clock(seconds: Column) -> Column:
    """H:MM:SS, or M:SS below an hour."""
    s = F.bround(seconds, 0).cast("bigint")
    return F.when(s >= 3600, F.concat_ws(":", F.floor(s / 3600).cast("string"), two(F.floor(s / 60) % 60), two(s % 60))).otherwise(
        F.concat_ws(":", F.floor(s / 60).cast("string"), two(s % 60))
    )


def compact(seconds: Column) -> Column:
    """1h3m20s, 3m20s or 20s."""
    s = F.bround(seconds, 0).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h"), m.cast("string"), F.lit("m"), r.cast("string"), F.lit("s"))).when(
        m > 0, F.concat(m.cast("string"), F.lit("m"), r.cast("string"), F.lit("s"))
    ).otherwise(F.concat(r.cast("string"), F.lit("s")))


def minutes_seconds(seconds: Column) -> Column:
    """MM:SS.ss"""
    return F.format_string("%02d:%05.2f", F.floor(seconds / 60), seconds - 60 * F.floor(seconds / 60))


def one_decimal(x: Column) -> Column:
    """One decimal, ties to even, without thousands separators."""
    return F.regexp_replace(F.format_number(F.bround(x, 1), 1), ",", "")


def percent(part: Column, whole: Column) -> Column:
    """Half-even whole percent; 0 without a whole."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0)).otherwise(F.bround(part / whole * 100, 0)).cast("int")


def utc_minute(text: Column) -> Column:
    """ISO time as ``YYYY-MM-DD HH:MM UTC``; a time without a zone counts as UTC, text that is no time stays. The session's zone plays no part."""
    t = F.trim(text)
    zoned = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit("T00:00:00Z"))).when(t.rlike(r"\d:\d{2}.*(?:Z|[+-]\d{2}(?::?\d{2})?)$"), t).otherwise(F.concat(t, F.lit("Z")))
    seconds = (F.unix_micros(F.try_to_timestamp(zoned)) / 1_000_000).cast("decimal(18,6)")
    since = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return F.coalesce(F.concat(F.substring(since.cast("string"), 1, 16), F.lit(" UTC")), text)


def silence_line(start_s: Column, end_s: Column, kind: Column) -> Column:
    return F.concat(F.lit("> _["), F.when(kind == "pause", "пауза").otherwise("muted"), F.lit(" "), hms_rounded(start_s), F.lit("–"), hms_rounded(end_s), F.lit("]_"))


def gain(rms: Column, target_db: float = -20.0, max_db: float = 16.0) -> Column:
    """Factor that brings a level to the target, bounded; 1 for silence."""
    return F.when(rms < 1e-6, F.lit(1.0)).otherwise(F.least(F.lit(10 ** (target_db / 20)) / rms, F.lit(10 ** (max_db / 20))))


def decibel(rms: Column) -> Column:
    return 20 * F.log10(rms + 1e-12)
