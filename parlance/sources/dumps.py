"""Stage results as files: one folder for each stage, JSON lines or Parquet, and Markdown documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES = ["meta", "turns", "asr", "merge", "proofread", "identify", "structure", "safe_speech", "summary", "render"]
SEGMENTS = "recording_id string, seq int, start double, end double, content string, speaker string, name string"


def stage_path(root: str, stage: str) -> str:
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage}")
    return f"{root}/stage={STAGES.index(stage) + 1:02d}-{stage}"


def write_stage(df: DataFrame, root: str | None, stage: str, form: str = "parquet") -> DataFrame:
    """Writes a stage's rows; without a root nothing happens. Returns what the next stage reads: the file, so nothing runs twice."""
    if root is None:
        return df
    path = stage_path(root, stage)
    df.write.mode("overwrite").format(form).save(path)
    return df.sparkSession.read.format(form).schema(df.schema).load(path)


def read_stage(spark: SparkSession, root: str | None, stage: str, form: str = "parquet") -> DataFrame | None:
    """A stage's rows that an earlier run wrote completely; null if there are none."""
    if root is None:
        return None
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{stage_path(root, stage)}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return None
    return spark.read.format(form).load(stage_path(root, stage))


def write_text(df: DataFrame, root: str | None, stage: str, key: str = "recording_id") -> None:
    """A stage's rows (key, one other column of any kind) as text, a folder for each recording; without a root nothing happens."""
    if root is not None:
        (value,) = [c for c in df.columns if c != key]
        rows = df.select(key, F.col(value).cast("string").alias("value"))
        rows.write.mode("overwrite").partitionBy(key).text(f"{stage_path(root, stage)}-text")


def write_binary(df: DataFrame, root: str | None, stage: str, key: str = "recording_id") -> DataFrame:
    """A stage's bytes (key, content) as they are, in Parquet, which keeps them apart whatever they hold."""
    return write_stage(df.select(key, F.col("content").cast("binary").alias("content")), root, stage)


# Between these lines machines find a report's numbers.
SUMMARY_START, SUMMARY_END = "===SUMMARY START===", "===SUMMARY END==="


def read_asr(spark: SparkSession, path: str) -> DataFrame:
    """Segments of JSON arrays (one file each), ordered by start, numbered."""
    rows = spark.read.option("multiLine", True).schema("start double, end double, text string, content string").json(path).select("*", F.col("_metadata.file_path").alias("path"))
    return spark.sql(
        """
SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY start, end) - 1 AS INT) AS seq, start, end, content FROM (
  SELECT regexp_extract(path, '([^/]+)[.][^./]+$', 1) AS recording_id, coalesce(start, 0.0D) AS start, coalesce(end, 0.0D) AS end, trim(coalesce(text, content)) AS content FROM {r})
WHERE length(content) > 0""",
        r=rows,
    )


def read_pair(left: DataFrame, right: DataFrame, key: str = "recording_id", tolerance: float = 1e-6) -> DataFrame:
    """Two stages row by row; raises if a recording's counts or times differ."""
    a = left.select(key, "seq", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("content").alias("asr_text"), "speaker")
    b = right.select(key, "seq", "start", "end", F.col("content").alias("proofread_text"))
    both = a.join(b, [key, "seq"], "full_outer")
    wrong = both.where(
        F.col("_s").isNull() | F.col("start").isNull() | (F.abs(F.col("_s") - F.col("start")) > tolerance) | (F.abs(F.col("_e") - F.col("end")) > tolerance)
    )
    if bad := wrong.limit(1).collect():
        raise ValueError(f"stages differ at {bad[0][key]} row {bad[0]['seq']}")
    return both.drop("_s", "_e")


def stage_value(meta: DataFrame, stage: str, field: str) -> DataFrame:
    """(recording_id, value) of a JSON column ``stages``; null where its shape is another."""
    return meta.select("recording_id", F.get_json_object("stages", f"$.{stage}.{field}").alias("value"))


def write_markdown(documents: DataFrame, path: str) -> None:
    """Documents (recording_id, markdown) as one text file a recording."""
    documents.select("recording_id", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("recording_id").option("lineSep", "\n").text(path)


def summary_block(df: DataFrame) -> DataFrame:
    """One row's fields as JSON with sorted keys, for machines to read."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("json"))
