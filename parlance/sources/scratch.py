"""Tables that are written once and read again: model replies must not be asked for twice, and lineage is cut where a plan branches."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where it is unset, but only if driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.gettempdir() + "/parlance-" + uuid.uuid4().hex)
    return named.rstrip("/")


def held(df: DataFrame, label: str) -> DataFrame:
    """``df`` from a table in the shared folder: whatever made it runs once, and a lost executor costs nothing afterwards."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parlance-held/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def clean() -> None:
    """Remove every table of this process."""
    while _made:
        spark, path = _made.pop()
        with contextlib.suppress(Exception):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
