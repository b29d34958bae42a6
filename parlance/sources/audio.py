"""Audio files and their metadata."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_recordings(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """(recording_id, path, modified, content) of every audio file below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("recording_id"), "path", F.col("modificationTime").alias("modified"), "content")


def probe(recordings: DataFrame) -> DataFrame:
    """Adds ``duration_s``; null where the file can't be decoded."""

    @F.pandas_udf("double")
    def seconds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for contents in batches:
            out = []
            for c in contents:
                try:
                    with wave.open(io.BytesIO(bytes(c))) as w:
                        out.append(w.getnframes() / w.getframerate())
                except (wave.Error, EOFError):
                    out.append(None)
            yield pd.Series(out, dtype="float64")

    return recordings.withColumn("duration_s", seconds("content"))


def metadata(recordings: DataFrame, override: str | None = None, tag: str | None = None) -> DataFrame:
    """Adds started_at, ended_at and which source gave the start: an override column, a tag column, or the file's time."""
    first = F.try_to_timestamp(F.col(override)) if override else F.lit(None).cast("timestamp")
    second = F.try_to_timestamp(F.col(tag)) if tag else F.lit(None).cast("timestamp")
    started = F.coalesce(first, second, F.col("modified"))
    source = F.when(first.isNotNull(), "override").when(second.isNotNull(), "creation_time").otherwise("mtime")
    return (
        recordings.withColumn("started_at", started)
        .withColumn("source", source)
        .withColumn("ended_at", F.timestamp_micros(F.unix_micros("started_at") + (F.col("duration_s") * 1_000_000).cast("bigint")))
    )
