"""Joins of intervals and points in time. Every input has a key (a recording), so all are equi-joins.

``bucket_ms`` deals a key's rows over time buckets: a recording of any length, or a key with a third of all rows, is
joined in pieces, and no task compares all of its intervals with all others. A pair is kept in one bucket only, that of the later start.
Times are integers (milliseconds); half-open intervals; ties go to the smaller sequence number, as list order decides in a
sequential reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_MS = 3_600_000


def bucketed(df: DataFrame, start: str, end: str, bucket_ms: int) -> DataFrame:
    first = F.floor(F.col(start) / bucket_ms)  # DIV would cut towards zero, and times may lie before 1970
    return df.withColumn("_bucket", F.explode(F.sequence(first, F.greatest(F.floor((F.col(end) - 1) / bucket_ms), first))))


def overlap_join(left: DataFrame, right: DataFrame, key: str, bucket_ms: int = BUCKET_MS, start: str = "start_ms", end: str = "end_ms", empty: bool = False) -> DataFrame:
    """Pairs with a positive overlap; the right side's columns get ``r_`` in front; adds ``overlap_ms``.

    With ``empty``, also pairs of which one has no length and lies strictly inside the other: their overlap is 0."""
    renamed = right.select(F.col(key), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != key])
    pairs = bucketed(left, start, end, bucket_ms).join(
        bucketed(renamed, f"r_{start}", f"r_{end}", bucket_ms), [key, "_bucket"]
    )
    later = F.greatest(start, f"r_{start}")
    out = (
        pairs.where((F.col(start) < F.col(f"r_{end}")) & (F.col(end) > F.col(f"r_{start}")))
        .where(F.col("_bucket") == F.floor(later / bucket_ms))
        .withColumn("overlap_ms", F.least(end, f"r_{end}") - later)
        .drop("_bucket")
    )
    return out if empty else out.where("overlap_ms > 0")


def max_overlap_owner(segs: DataFrame, turns: DataFrame, key: str, seg: str, turn: str, owner: str, bucket_ms: int = BUCKET_MS, hint: str | None = None, empty: bool = False) -> DataFrame:
    """Every segment with the owner of the largest summed overlap (null if none); ties go to the owner whose turn came first.

    A non-null column ``hint`` of the segments wins outright. With ``empty``, turns without length count as :func:`overlap_join` says."""
    pairs = overlap_join(segs.select(key, seg, "start_ms", "end_ms"), turns, key, bucket_ms, empty=empty)
    sums = pairs.groupBy(key, seg, F.col(f"r_{owner}").alias("owner")).agg(
        F.sum("overlap_ms").alias("overlap_ms"), F.min(f"r_{turn}").alias("_first")
    )
    best = sums.groupBy(key, seg).agg(F.max(F.struct("overlap_ms", (-F.col("_first")).alias("_f"), "owner")).alias("_b"))
    out = segs.join(best, [key, seg], "left")
    chosen = F.col("_b.owner") if hint is None else F.coalesce(F.col(hint), F.col("_b.owner"))
    return out.withColumn("owner", chosen).withColumn("overlap_ms", F.coalesce("_b.overlap_ms", F.lit(0))).drop("_b")


def owners_above(segs: DataFrame, turns: DataFrame, key: str, seg: str, owner: str, thresholds: tuple[int, ...], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """For each segment the number of owners whose summed overlap is over each threshold (strictly)."""
    pairs = overlap_join(segs.select(key, seg, "start_ms", "end_ms"), turns, key, bucket_ms)
    sums = pairs.groupBy(key, seg, f"r_{owner}").agg(F.sum("overlap_ms").alias("ms"))
    return sums.groupBy(key, seg).agg(*[F.count_if(F.col("ms") > t).alias(f"over_{t}") for t in thresholds])


def argmax_interval(points: DataFrame, turns: DataFrame, keys: list[str], key: str, turn: str, owner: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Each row of ``points`` with the owner of the single turn it overlaps most; the earliest turn wins ties."""
    pairs = overlap_join(points.select(*keys, "start_ms", "end_ms"), turns, key, bucket_ms)
    best = pairs.groupBy(*keys).agg(
        F.max(F.struct("overlap_ms", (-F.col(f"r_{turn}")).alias("_t"), F.col(f"r_{owner}").alias("owner"))).alias("_b")
    )
    return points.join(best, keys, "left").withColumn("owner", F.col("_b.owner")).drop("_b")


def containing(points: DataFrame, intervals: DataFrame, key: str, at: str, order: str, keep: list[str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(``keep``, _hit): for each point the first interval by ``order`` with start <= at < end; points without one are left out."""
    renamed = intervals.select(F.col(key), *[F.col(c).alias(f"r_{c}") for c in intervals.columns if c != key])
    pairs = points.withColumn("_bucket", F.floor(F.col(at) / bucket_ms)).join(
        bucketed(renamed, "r_start_ms", "r_end_ms", bucket_ms), [key, "_bucket"]
    )
    hit = pairs.where((F.col("r_start_ms") <= F.col(at)) & (F.col(at) < F.col("r_end_ms")))
    rest = [c for c in renamed.columns if c not in (key, f"r_{order}")]
    return hit.groupBy(*keep).agg(F.min(F.struct(f"r_{order}", *rest)).alias("_hit"))


def asof(points: DataFrame, turns: DataFrame, key: str, at: str, start: str, turn: str, value: str, forward: bool = True) -> DataFrame:
    """Each point with the turn of the nearest start at or after it (``forward``) or at or before it.

    Points and turns are merged into one order and the last turn seen is carried along: no pair is ever formed. Adds
    ``asof_turn``, ``asof_start``, ``asof_value``; null without such a turn. Ties go to the smaller ``turn``."""
    cols = [c for c in points.columns if c != key]
    left = points.select(key, F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.struct(*cols).alias("_p"), F.lit(None).cast(turns.schema[turn].dataType).alias("_n"), F.lit(None).cast(turns.schema[value].dataType).alias("_v"))
    right = turns.select(key, F.col(start).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(left.schema["_p"].dataType).alias("_p"), F.col(turn).alias("_n"), F.col(value).alias("_v"))
    time = F.col("_t").desc() if forward else F.col("_t").asc()
    order = Window.partitionBy(key).orderBy(time, "_kind", F.col("_n").desc()).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_kind") == 0, F.struct(F.col("_n").alias("n"), F.col("_t").alias("t"), F.col("_v").alias("v"))), ignorenulls=True).over(order)
    return (
        left.unionByName(right)
        .withColumn("_s", seen)
        .where("_kind = 1")
        .select(key, "_p.*", F.col("_s.n").alias("asof_turn"), F.col("_s.t").alias("asof_start"), F.col("_s.v").alias("asof_value"))
    )


def nearest_start(points: DataFrame, turns: DataFrame, key: str, at: str, turn: str) -> DataFrame:
    """Each point with the nearest start of any turn but the key's first; ties go to the earlier one."""
    first = Window.partitionBy(key).orderBy("start_ms", turn)
    later = turns.withColumn("_n", F.row_number().over(first)).where("_n > 1").withColumn("_v", F.col("start_ms"))
    back = asof(points, later, key, at, "start_ms", turn, "_v", forward=False)
    back = back.withColumnsRenamed({"asof_turn": "_bt", "asof_start": "_bs"}).drop("asof_value")
    both = asof(back, later, key, at, "start_ms", turn, "_v", forward=True)
    closer = F.col("asof_start").isNotNull() & (F.col("_bs").isNull() | (F.col("asof_start") - F.col(at) < F.col(at) - F.col("_bs")))
    return both.withColumn("nearest_start", F.when(closer, F.col("asof_start")).otherwise(F.col("_bs"))).drop("_bt", "_bs", "asof_turn", "asof_start", "asof_value")


def start_within(points: DataFrame, turns: DataFrame, key: str, at: str, turn: str, value: str, keep: list[str], tolerance: int = 0) -> DataFrame:
    """(``keep``, value): each point with the first turn that starts within ``tolerance`` of it.

    Starts are dealt to cells of ``tolerance + 1``; a point looks into its own cell and both neighbours, so this is an equi-join."""
    cell = tolerance + 1
    near = points.withColumn("_c", F.explode(F.sequence(F.floor(F.col(at) / cell) - 1, F.floor(F.col(at) / cell) + 1)))
    starts = turns.select(key, F.col("start_ms").alias("_s"), F.floor(F.col("start_ms") / cell).alias("_c"), turn, value)
    return near.join(starts, [key, "_c"]).where(F.abs(F.col("_s") - F.col(at)) <= tolerance).groupBy(*keep).agg(F.min_by(value, turn).alias(value))
