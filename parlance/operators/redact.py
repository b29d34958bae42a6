"""Redaction of ranges of a section's rows: a placeholder instead of each range, or nothing at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import containing


def disjoint(r: DataFrame, key: str = "conv_id") -> DataFrame:
    """Ranges (key, section, start_idx, end_idx, topic) of a section with overlapping ones merged, under the first one's topic."""
    return r.sparkSession.sql(
        f"""
SELECT {key}, section, min(start_idx) AS start_idx, max(end_idx) AS end_idx, min_by(topic, struct(start_idx, end_idx, topic)) AS topic FROM (
  SELECT *, sum(CASE WHEN start_idx <= prior THEN 0 ELSE 1 END) OVER w AS grp FROM (
    SELECT *, max(end_idx) OVER (PARTITION BY {key}, section ORDER BY start_idx, end_idx, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM {{r}})
  WINDOW w AS (PARTITION BY {key}, section ORDER BY start_idx, end_idx, topic))
GROUP BY {key}, section, grp""",
        r=r,
    )


def _placed(u: DataFrame, sections: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Rows with the section that holds their start, their place in it, and the range that covers them.

    A row meets its section in a time bucket, and its range by place: both are equi-joins, however many sections a recording has."""
    hit = containing(u.select(key, "seq", "start_ms"), sections.select(key, "i", "start_ms", "end_ms"), key, "start_ms", "i", [key, "seq"])
    rows = u.join(hit.select(key, "seq", "_hit"), [key, "seq"], "left")
    rows = rows.withColumns({"section": F.col("_hit.r_i"), "sec_start": F.col("_hit.r_start_ms"), "sec_end": F.col("_hit.r_end_ms")}).drop("_hit")
    place = Window.partitionBy(key, "section")
    rows = rows.withColumn("idx", F.row_number().over(place.orderBy("seq")) - 1).withColumn("size", F.count("*").over(place))
    sizes = rows.where("section IS NOT NULL").groupBy(key, "section").agg(F.count("*").alias("_n"))
    # a range past its section's end is cut there, so it is unfolded over rows that exist
    inside = disjoint(ranges, key).join(sizes, [key, "section"]).withColumn("_last", F.least("end_idx", F.col("_n") - 1)).where("_last >= greatest(start_idx, 0)")
    covered = inside.select(key, "section", "topic", F.col("start_idx").alias("rid"), F.explode(F.sequence(F.greatest("start_idx", F.lit(0).cast("long")), F.col("_last"))).alias("idx"))
    return rows.join(covered, [key, "section", "idx"], "left")


def decisions(u: DataFrame, sections: DataFrame, ranges: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, section, start_idx, end_idx, topic, rows, total_ms): what each range covers; indices are clamped to the section.

    Rows belong to the section that holds their start. Ranges are merged where they overlap."""
    return u.sparkSession.sql(
        f"""
SELECT {key}, section, min(idx) AS start_idx, max(idx) AS end_idx, topic, count(*) AS n_rows, sum(end_ms - start_ms) AS total_ms
FROM {{j}} WHERE rid IS NOT NULL GROUP BY {key}, section, rid, topic""",
        j=_placed(u, sections, ranges, key),
    )


def redact(u: DataFrame, sections: DataFrame, ranges: DataFrame, policy: str = "placeholder", key: str = "conv_id") -> DataFrame:
    """(key, seq, start_ms, end_ms, speaker, content) after redaction.

    ``placeholder``: each range becomes one speakerless row from its first start to its last end, with the seconds of speech taken out.
    ``drop``: ranges vanish; a section that would be empty keeps one row over its whole span."""
    if policy not in ("placeholder", "drop"):
        raise ValueError(f"unknown policy {policy}")
    kept = f"SELECT {key}, seq, start_ms, end_ms, speaker, content FROM {{j}} WHERE rid IS NULL"
    if policy == "placeholder":
        # tenths, ties to even, in integers
        tenths = "(ms DIV 100 + CASE WHEN ms % 100 > 50 OR (ms % 100 = 50 AND ms DIV 100 % 2 = 1) THEN 1 ELSE 0 END)"
        more = f"""
SELECT {key}, seq, start_ms, end_ms, CAST(NULL AS STRING), concat('[muted, ', {tenths} DIV 10, '.', {tenths} % 10, 's]') FROM (
  SELECT {key}, min(seq) AS seq, min_by(start_ms, seq) AS start_ms, max_by(end_ms, seq) AS end_ms, sum(end_ms - start_ms) AS ms FROM {{j}} WHERE rid IS NOT NULL GROUP BY {key}, section, rid)"""
    else:
        more = f"""
SELECT {key}, min(seq), min(sec_start), min(sec_end), CAST(NULL AS STRING), '[muted, 0.0s]' FROM {{j}} WHERE section IS NOT NULL GROUP BY {key}, section HAVING count(*) = count(rid)"""
    return u.sparkSession.sql(f"{kept}\nUNION ALL {more}", j=_placed(u, sections, ranges, key))
