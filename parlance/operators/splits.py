"""Splitting of segments at changes of speaker: by words, or by characters where there are no words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import filler_form, is_filler
from .intervals import BUCKET_MS, argmax_interval, asof, bucketed, containing, nearest_start, overlap_join, owners_above


def word_owners(words: DataFrame, turns: DataFrame, key: str, keys: list[str], turn: str, owner: str, filler_tie_ms: int = 0, deadband_ms: int = 0, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``words`` plus ``owner``: the turn overlapped most; then, if asked for, fillers go by their end and words near a turn's start downstream."""
    out = argmax_interval(words, turns, keys, key, turn, owner, bucket_ms)
    if deadband_ms > 0:
        centre = out.withColumn("_c", F.expr("(start_ms + end_ms) DIV 2"))
        near = nearest_start(centre.select(*keys, "_c"), turns, key, "_c", turn).where(F.abs(F.col("_c") - F.col("nearest_start")) <= deadband_ms)
        starts = turns.groupBy(key, F.col("start_ms").alias("nearest_start")).agg(F.min_by(owner, turn).alias("_down"))
        out = out.join(near.join(starts, [key, "nearest_start"]).select(*keys, "_down"), keys, "left").withColumn("owner", F.coalesce("_down", "owner")).drop("_down")
    if filler_tie_ms > 0:
        fill = words.where(is_filler(F.col("token")))
        sums = overlap_join(fill.select(*keys, "start_ms", "end_ms"), turns, key, bucket_ms).groupBy(*keys, f"r_{owner}").agg(F.sum("overlap_ms").alias("ms"))
        top = sums.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("ms"), asc=False), 1, 2).alias("_m")).where((F.size("_m") == 2) & (F.col("_m")[0] - F.col("_m")[1] < filler_tie_ms))
        tied = fill.join(top.select(*keys), keys).withColumn("_e", F.col("end_ms")).select(*keys, "_e")
        inside = containing(tied, turns.select(key, turn, "start_ms", "end_ms", owner), key, "_e", turn, keys, bucket_ms)
        nxt = asof(tied, turns, key, "_e", "start_ms", turn, owner).select(*keys, F.col("asof_value").alias("_next"))
        moved = nxt.join(inside, keys, "left").select(*keys, F.coalesce(f"_hit.r_{owner}", "_next").alias("_fill"))
        out = out.join(moved, keys, "left").withColumn("owner", F.coalesce("_fill", "owner")).drop("_fill")
    return out


def word_pieces(owned: DataFrame, keys: list[str]) -> DataFrame:
    """All runs of equal owner: keys, fragment, first_i, start_ms, end_ms, content, owner, top (the segment's last fragment).

    ``owned`` has keys, ``i``, ``token``, times and ``owner``."""
    k = ", ".join(keys)
    return owned.sparkSession.sql(
        f"""
WITH c AS (SELECT *, sum(CASE WHEN i > 0 AND NOT owner <=> prev THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY i) AS fragment
  FROM (SELECT *, lag(owner) OVER (PARTITION BY {k} ORDER BY i) AS prev FROM {{o}})),
f AS (SELECT {k}, fragment, min(i) AS first_i, min_by(start_ms, i) AS start_ms, max_by(end_ms, i) AS end_ms,
    trim(listagg(token, ' ') WITHIN GROUP (ORDER BY i)) AS content, max(owner) AS owner, max(fragment) OVER (PARTITION BY {k}) AS top
  FROM c GROUP BY {k}, fragment)
SELECT {k}, fragment, first_i, start_ms, end_ms, content, owner, top FROM f""",
        o=owned,
    )


def split_by_words(owned: DataFrame, keys: list[str], least_ms: int = 200) -> DataFrame:
    """Fragments of equal owner that are long enough and not blank. A segment with one owner yields nothing here; see :func:`split_segments`."""
    return word_pieces(owned, keys).where((F.col("top") > 0) & (F.col("end_ms") - F.col("start_ms") >= least_ms) & (F.length("content") > 0)).drop("top")


def split_by_words_snapped(owned: DataFrame, keys: dict[str, str], least_ms: int = 200, window_ms: int = 500, below: float = 0.7) -> DataFrame:
    """As :func:`split_by_words`, with each cut moved to the least probable word near it.

    A moved cut rewrites the owners that later cuts see, so grouped pandas, one segment at a time; only segments whose words have
    more than one owner are sent there."""
    names = list(keys)
    several = owned.groupBy(*names).agg(F.min(F.coalesce("owner", F.lit(""))).alias("_a"), F.max(F.coalesce("owner", F.lit(""))).alias("_b")).where("_a <> _b").select(*names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        start, end, prob, text, who = (pdf[c].tolist() for c in ("start_ms", "end_ms", "probability", "token", "owner"))
        naive = [i for i in range(1, len(who)) if who[i] != who[i - 1]]
        cuts = set()
        for at in naive:
            edge, best, low = (end[at - 1] + start[at]) / 2, at, below
            for i in range(1, len(who)):
                p = prob[i]
                if p is None or p != p or p >= low:
                    continue
                if start[i] <= edge <= end[i] or min(abs(start[i] - edge), abs(end[i] - edge)) <= window_ms:
                    best, low = i, p
            left, right = who[at - 1], who[at]
            who[best:at] = [right] * max(0, at - best)
            who[at:best] = [left] * max(0, best - at)
            cuts.add(best)
        bounds, rows = [0, *sorted(cuts), len(who)], []
        for n, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            content = " ".join(text[a:b]).strip()
            if end[b - 1] - start[a] < least_ms or not content:
                continue
            votes: dict[str, int] = {}
            for w in who[a:b]:
                if w is not None:
                    votes[w] = votes.get(w, 0) + 1
            rows.append((n, a, start[a], end[b - 1], content, max(votes, key=votes.get) if votes else None))
        out = pd.DataFrame(rows, columns=["fragment", "first_i", "start_ms", "end_ms", "content", "owner"])
        for c in reversed(names):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    schema = ", ".join(f"{c} {t}" for c, t in keys.items())
    return owned.join(several, names).groupBy(*names).applyInPandas(run, f"{schema}, fragment long, first_i long, start_ms long, end_ms long, content string, owner string")


def char_pieces(segs: DataFrame, turns: DataFrame, key: str, seg: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(key, seg, start_ms, end_ms, content) of all pieces of segments in which a turn starts, text in proportion to time.

    Character offsets truncate. A turn's start meets segments in its time bucket."""
    inside = bucketed(segs.select(key, seg, "start_ms", "end_ms"), "start_ms", "end_ms", bucket_ms)
    starts = turns.select(key, F.col("start_ms").alias("at"), F.floor(F.col("start_ms") / bucket_ms).alias("_bucket"))
    cuts = inside.join(starts, [key, "_bucket"]).where("at > start_ms AND at < end_ms").select(key, seg, "at").distinct()
    return segs.sparkSession.sql(
        f"""
WITH c AS (SELECT {key}, {seg}, array_sort(collect_list(at)) AS cuts FROM {{b}} GROUP BY {key}, {seg}),
p AS (SELECT s.{key}, s.{seg}, s.content, s.start_ms AS s0, s.end_ms AS s1, posexplode(concat(array(s.start_ms), c.cuts)) AS (i, at), c.cuts
  FROM {{s}} s JOIN c ON s.{key} = c.{key} AND s.{seg} = c.{seg}),
o AS (SELECT *, coalesce(get(cuts, i), s1) AS nxt FROM p)
SELECT {key}, {seg}, at AS start_ms, nxt AS end_ms, trim(substring(content, CAST(length(content) * (at - s0) DIV (s1 - s0) AS INT) + 1,
  CAST(length(content) * (nxt - s0) DIV (s1 - s0) - length(content) * (at - s0) DIV (s1 - s0) AS INT))) AS content FROM o""",
        b=cuts,
        s=segs,
    )


def split_by_chars(segs: DataFrame, turns: DataFrame, key: str, seg: str, least_ms: int = 200, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Fragments of segments without words: cut at every turn that starts inside. Fragments that are blank or too short go."""
    return char_pieces(segs, turns, key, seg, bucket_ms).where((F.col("end_ms") - F.col("start_ms") >= least_ms) & (F.length("content") > 0))


def split_segments(
    segs: DataFrame, words: DataFrame, turns: DataFrame, key: str, seg: str, turn: str, owner: str,
    least_ms: int = 200, threshold_ms: int = 300, bucket_ms: int = BUCKET_MS, **refine,
) -> tuple[DataFrame, DataFrame]:
    """Segments cut where the speaker changes, and what was done: (rows, one row of counts).

    Segments (key, seg, start_ms, end_ms, content) with two or more owners over ``threshold_ms`` are split: by their words (key, seg,
    i, token, start_ms, end_ms), those without any by characters. A segment of which less than two fragments are left stays as it was, but
    for a single fragment whose words have an owner, which becomes the segment's ``hint``. All others stay. ``refine``: see :func:`word_owners`.

    rows: key, seg, fragment (0 for what stays), start_ms, end_ms, content, hint, how (``kept``, ``words`` or ``chars``)."""
    n = owners_above(segs, turns, key, seg, owner, (threshold_ms,), bucket_ms)
    crossing = n.where(F.col(f"over_{threshold_ms}") >= 2).select(key, seg)
    timed = words.select(key, seg).distinct().withColumn("_w", F.lit(True))
    marked = segs.join(crossing.withColumn("_c", F.lit(True)), [key, seg], "left").join(timed, [key, seg], "left")
    marked = marked.withColumn("_how", F.when(F.col("_c").isNull(), "kept").when(F.col("_w"), "words").otherwise("chars")).drop("_c", "_w")
    sent = words.join(marked.where("_how = 'words'").select(key, seg), [key, seg], "left_semi")
    owned = word_owners(sent, turns, key, [key, seg, "i"], turn, owner, bucket_ms=bucket_ms, **refine)
    by_words = word_pieces(owned, [key, seg]).select(key, seg, "fragment", "start_ms", "end_ms", "content", F.col("owner").alias("hint"))
    chars = char_pieces(marked.where("_how = 'chars'").drop("_how"), turns, key, seg, bucket_ms)
    numbered = F.expr(f"row_number() OVER (PARTITION BY {key}, {seg} ORDER BY start_ms) - 1").cast("long")
    by_chars = chars.select(key, seg, numbered.alias("fragment"), "start_ms", "end_ms", "content", F.lit(None).cast("string").alias("hint"))
    pieces = by_words.unionByName(by_chars).withColumn("_fine", (F.col("end_ms") - F.col("start_ms") >= least_ms) & (F.length("content") > 0))
    counts = pieces.groupBy(key, seg).agg(F.count_if("_fine").alias("_n"), F.count_if(~F.col("_fine")).alias("_short"), F.max(F.when(F.col("_fine"), F.col("hint"))).alias("_hint"))
    settled = marked.join(counts, [key, seg], "left").withColumn("_cut", F.coalesce((F.col("_n") > 1) | ((F.col("_n") == 1) & F.col("_hint").isNotNull()), F.lit(False)))
    stay = settled.where("NOT _cut").select(key, seg, F.lit(0).cast("long").alias("fragment"), "start_ms", "end_ms", "content", F.lit(None).cast("string").alias("hint"), F.lit("kept").alias("how"))
    cut = settled.where("_cut").select(key, seg, F.col("_how").alias("how"))
    rows = stay.unionByName(pieces.where("_fine").drop("_fine").join(cut, [key, seg]))
    told = settled.agg(
        F.count("*").alias("input_segments"),
        F.sum(F.when(F.col("_cut"), F.col("_n")).otherwise(1)).alias("output_segments"),
        F.count_if(F.col("_cut") & (F.col("_n") > 1)).alias("segments_split"),
        F.coalesce(F.sum(F.when(F.col("_cut") & (F.col("_n") > 1), F.col("_n"))), F.lit(0)).alias("new_segments"),
        F.count_if((F.col("_how") == "chars") & F.col("_n").isNotNull()).alias("fallback_chars"),
        F.coalesce(F.sum("_short"), F.lit(0)).alias("fragments_below_least"),
    ).withColumns({"least_ms": F.lit(least_ms), "threshold_ms": F.lit(threshold_ms)} | {k: F.lit(v) for k, v in refine.items()})
    return rows, told


def refinements(plain: DataFrame, refined: DataFrame, keys: list[str]) -> DataFrame:
    """How many words another way of finding owners moved."""
    both = plain.select(*keys, F.col("owner").alias("_was")).join(refined.select(*keys, "owner"), keys)
    return both.agg(F.count("*").alias("n_words"), F.count_if(~F.col("_was").eqNullSafe(F.col("owner"))).alias("moved"))


__all__ = ["char_pieces", "filler_form", "refinements", "split_by_chars", "split_segments", "word_pieces", "split_by_words", "split_by_words_snapped", "word_owners"]
