"""Shared helpers: scratch tables in the cluster's shared folder, and defensive reads."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every contract of this package.
SPACES = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a fresh temporary folder, but only
    where driver and executors are one process. On a cluster each executor would write to a disk of its own, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.gettempdir() + "/parlance-" + uuid.uuid4().hex)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/parlance/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back; ``options`` are the writer's.

    Lost executors cost nothing afterwards, and what follows can scan the result
    more than once without running what made it again."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def clean_scratch() -> None:
    """Remove every scratch table of this process; also runs when Python ends."""
    while _made:
        spark, path = _made.pop()
        with contextlib.suppress(Exception):
            remove(spark, path)


#: Stands for a null id inside Python functions, where pandas would turn a column with nulls into inexact floats.
NULL_ID = -(2**63)


def id_in(name: str):
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID)).alias(name)


def id_out(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.when(F.col(name) != NULL_ID, F.col(name)))


def trim() -> None:
    """Gives back memory that a Python worker has freed but holds: workers are reused, and each stage would add to what the last one left."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(col):
    """A-Z to a-z and nothing else, as the contracts ask for."""
    return F.translate(col, UPPER, LOWER)


def words(col):
    """Array of ``[^\\x20\\x09-\\x0D]+``; empty for null, empty and blank texts."""
    trimmed = F.regexp_replace(col, f"^[{SPACES}]+|[{SPACES}]+$", "")
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, f"[{SPACES}]+")
    )
