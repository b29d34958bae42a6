"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard scores a record with ``-ln(u) / weight`` where ``u`` in (0, 1) hashes the record's key and
the shard's number; the smallest score wins. Adding a shard adds one score to each record and changes no
other, so it only takes records, in proportion to its weight. The law is ``key``: the key and the shards
decide alone, in DataFrame functions, without a shuffle.

``slot`` numbers a shard's records without gaps. Records of a shard fall into ``PARTS`` parts by hash; parts are numbered
by a sum over their counts (a table of shards x ``PARTS`` rows at most) and records within their part by a window, so
no task holds a shard.

Defined results: a null key is a key like any other; equal rows share a shard and get slots of their
own; a null text has size 8 and the checksum of no bytes (0); an empty table gives an empty result; the input's columns
are kept by :func:`assign`, whose new columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load

NAME = "op3_sharding"
SHARDS, PARTS = 24, 1024


def shard_of(key: Column, weights: list[float]) -> Column:
    """Number of the shard with the smallest weighted score; ties go to the lower number."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    scores = []
    for k, w in enumerate(weights):
        # 52 bits of the hash, moved off zero: exact in a double
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(k)), 12).cast("double") + 0.5) / float(2**52)
        scores.append(F.struct((-F.ln(u) / F.lit(float(w))).alias("s"), F.lit(k).alias("k")))
    return (F.least(*scores) if len(scores) > 1 else scores[0])["k"]


def assign(df: DataFrame, key: str = "doc_id", weights: list[float] | None = None, grown: float | None = 1.0) -> DataFrame:
    """``df`` plus ``shard`` and, unless ``grown`` is None, ``grown_shard`` with one more shard of that weight."""
    weights = weights or [1.0] * SHARDS
    out = df.drop("shard", "grown_shard").withColumn("shard", shard_of(F.col(key), weights))
    more = F.lit(None).cast("int") if grown is None else shard_of(F.col(key), [*weights, grown])
    return out.withColumn("grown_shard", more)


def slots(df: DataFrame, order: list[str], parts: int = PARTS) -> DataFrame:
    """Adds ``slot``: 0, 1, 2 ... within each ``shard``, ordered by part and ``order`` within it."""
    df = df.drop("slot", "_part", "_before").withColumn("_part", F.pmod(F.xxhash64(*order, F.lit("part")), F.lit(parts)).cast("int"))
    counts = df.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = counts.select(
        "shard",
        "_part",
        (F.sum("_n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_n")).alias("_before"),
    )
    # at most shards x parts rows: a bound that does not depend on the data
    return (
        df.withColumn("_at", F.row_number().over(Window.partitionBy("shard", "_part").orderBy(*order)))
        .join(F.broadcast(before), ["shard", "_part"])
        .withColumn("slot", F.col("_before") + F.col("_at") - 1)
        .drop("_part", "_at", "_before")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b""))
    docs = load(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    out = slots(assign(docs), ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
