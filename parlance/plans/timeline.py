"""Timelines derived from the driver's tables, in integers, so that any engine agrees on them.

``utterances``: one row per turn of a conversation with a start and an end; ``utterances_m`` mutes some of them; ``spans``: intervals
of events; ``words``: timed words of utterances; ``sections``: tiles of 60 s. ``SQL`` has the same relations for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import TOKEN

TABLES = "region nation customer supplier part orders lineitem events documents labels conversations benchmark".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        """
SELECT conv_id, turn AS seq, speaker, content, dur_ms, gap_ms, end_ms - dur_ms AS start_ms, end_ms FROM (
  SELECT *, sum(gap_ms + dur_ms) OVER (PARTITION BY conv_id ORDER BY turn) AS end_ms FROM (
    SELECT conv_id, turn, CASE WHEN role = 'system' THEN NULL ELSE role END AS speaker, text AS content,
      greatest(200, length(coalesce(text, '')) * 60L) AS dur_ms, (conv_id * 7919 + turn * 104729) % 15000 AS gap_ms
    FROM {c}))""",
        c=table(spark, sf_dir, "conversations"),
    )


def muted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        """
SELECT conv_id, seq, CASE WHEN (conv_id + seq) % 5 = 4 THEN NULL ELSE speaker END AS speaker,
  CASE WHEN (conv_id + seq) % 5 = 4 THEN '[muted, x]' ELSE content END AS content, start_ms, end_ms FROM {u}""",
        u=utterances(spark, sf_dir),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        """
SELECT user_id, event_id, start_ms, start_ms + CAST(round(value * 100) AS BIGINT) * 600 AS end_ms, label FROM (
  SELECT user_id, event_id, event_type AS label, value, unix_micros(CAST(ts AS TIMESTAMP)) DIV 1000 AS start_ms FROM {e})""",
        e=table(spark, sf_dir, "events"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        f"""
SELECT conv_id, seq, i, token, start_ms + i * 400L AS start_ms, start_ms + i * 400L + 350 AS end_ms,
  ((conv_id * 31 + seq * 17 + i * 7) % 100) / 100.0D AS probability
FROM {{u}} LATERAL VIEW posexplode(transform(regexp_extract_all(content, "{TOKEN}", 0), x -> lower(x))) AS i, token
WHERE speaker IS NOT NULL""",
        u=utterances(spark, sf_dir),
    )


def sections(spark: SparkSession, sf_dir: str, tile_ms: int = 60_000) -> DataFrame:
    return spark.sql(
        f"""
SELECT conv_id, i, concat('T', CAST(i DIV 2 % 3 AS STRING)) AS title, i * {tile_ms}L AS start_ms, (i + 1) * {tile_ms}L AS end_ms
FROM (SELECT conv_id, explode(sequence(0L, max(end_ms) DIV {tile_ms})) AS i FROM {{u}} GROUP BY conv_id)""",
        u=utterances(spark, sf_dir),
    )


_TOKEN_SQL = TOKEN.replace("'", "''")
SQL = f"""
utterances AS (
  SELECT conv_id, turn AS seq, speaker, content, dur_ms, gap_ms, (end_ms - dur_ms)::BIGINT AS start_ms, end_ms::BIGINT AS end_ms FROM (
    SELECT *, sum(gap_ms + dur_ms) OVER (PARTITION BY conv_id ORDER BY turn) AS end_ms FROM (
      SELECT conv_id, turn, CASE WHEN role = 'system' THEN NULL ELSE role END AS speaker, text AS content,
        greatest(200, length(coalesce(text, '')) * 60) AS dur_ms, (conv_id * 7919 + turn * 104729) % 15000 AS gap_ms
      FROM conversations))),
utterances_m AS (
  SELECT conv_id, seq, CASE WHEN (conv_id + seq) % 5 = 4 THEN NULL ELSE speaker END AS speaker,
    CASE WHEN (conv_id + seq) % 5 = 4 THEN '[muted, x]' ELSE content END AS content, start_ms, end_ms FROM utterances),
spans AS (
  SELECT user_id, event_id, epoch_us(ts) // 1000 AS start_ms,
    epoch_us(ts) // 1000 + CAST(round(value * 100) AS BIGINT) * 600 AS end_ms, event_type AS label FROM events),
words AS (
  SELECT conv_id, seq, i - 1 AS i, t[i] AS token, start_ms + (i - 1) * 400 AS start_ms, start_ms + (i - 1) * 400 + 350 AS end_ms,
    ((conv_id * 31 + seq * 17 + (i - 1) * 7) % 100) / 100.0::DOUBLE AS probability
  FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM (
    SELECT *, list_transform(regexp_extract_all(content, '{_TOKEN_SQL}'), lambda x: lower(x)) AS t
    FROM utterances WHERE speaker IS NOT NULL))),
sections AS (
  SELECT conv_id, i, 'T' || (i // 2 % 3) AS title, i * 60000 AS start_ms, (i + 1) * 60000 AS end_ms
  FROM (SELECT conv_id, unnest(range(0, max(end_ms) // 60000 + 1)) AS i FROM utterances GROUP BY conv_id)),
segs AS (SELECT user_id, event_id AS seg_id, start_ms, end_ms FROM spans WHERE label = 'view'),
turns AS (SELECT user_id, event_id AS turn_id, start_ms, end_ms, label FROM spans WHERE label <> 'view')"""


def segs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).where("label = 'view'").selectExpr("user_id", "event_id AS seg_id", "start_ms", "end_ms")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).where("label <> 'view'").selectExpr("user_id", "event_id AS turn_id", "start_ms", "end_ms", "label")
