"""Operators on a recording's rows in order: gaps, islands, paragraphs, chunks, sections.

Rows carry ``seq``; list order is never implied. All but the functions that say so are windows over the recording's key, so they
run in parallel over recordings without Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MUTED = "[muted"
PARAGRAPH_GAP_MS, PAUSE_MS, MIN_SILENCE_MS = 2000, 3000, 10_000


def is_muted(speaker: str = "speaker", content: str = "content"):
    """A speakerless row that stands for what was taken out; other speakerless rows are noise."""
    return F.col(speaker).isNull() & F.coalesce(F.col(content).startswith(MUTED), F.lit(False))


def pause_markers(u: DataFrame, key: str = "conv_id", least_ms: int = PAUSE_MS) -> DataFrame:
    """Rows whose gap to the row before, of any speaker, is at least ``least_ms``."""
    return u.sparkSession.sql(
        f"SELECT * FROM (SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY {key} ORDER BY seq) AS pause_ms FROM {{u}}) WHERE pause_ms >= {least_ms}", u=u
    )


def silence_events(u: DataFrame, key: str = "conv_id", least_ms: int = MIN_SILENCE_MS, thresholds: DataFrame | None = None) -> DataFrame:
    """(key, start_ms, end_ms, kind): pauses between speakers, and chains of muted rows with the silence around them.

    ``thresholds`` (key, least_ms) has a least length for each recording instead of one for all.

    Other speakerless rows are noise and ignored. A muted chain starts at the previous speaker's end where that is
    earlier; it takes in the gap to the next speaker if the gap alone is long enough. Nothing trails the last muted row."""
    if thresholds is None:
        kept = f"SELECT *, {least_ms} AS least FROM n"
    else:
        kept = f"SELECT n.*, h.least_ms AS least FROM n JOIN {{h}} h ON n.{key} = h.{key}"
    rows = u.withColumn("_m", is_muted()).where("_m OR speaker IS NOT NULL")
    return u.sparkSession.sql(
        f"""
WITH r AS (SELECT {key}, seq, start_ms, end_ms, _m AS m FROM {{u}}),
g AS (SELECT *, sum(CASE WHEN m THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY seq) AS grp FROM r),
s AS (SELECT {key}, grp, start_ms, end_ms FROM g WHERE NOT m),
c AS (SELECT {key}, grp, min_by(start_ms, seq) AS ms, max_by(end_ms, seq) AS me FROM g WHERE m GROUP BY {key}, grp),
a AS (SELECT coalesce(s.{key}, c.{key}) AS {key}, coalesce(s.grp, c.grp) AS grp, s.end_ms AS pe, c.ms, c.me
  FROM s FULL OUTER JOIN c ON s.{key} = c.{key} AND s.grp = c.grp),
n AS (SELECT a.*, t.start_ms AS ns FROM a LEFT JOIN (SELECT {key}, grp - 1 AS grp, start_ms FROM s) t ON a.{key} = t.{key} AND a.grp = t.grp),
k AS ({kept})
SELECT {key}, start_ms, end_ms, kind FROM (
  SELECT {key}, least, CASE WHEN ms IS NULL THEN pe ELSE least(coalesce(pe, ms), ms) END AS start_ms,
    CASE WHEN ms IS NULL THEN ns WHEN ns - me >= least THEN ns ELSE me END AS end_ms,
    CASE WHEN ms IS NULL THEN 'pause' ELSE 'muted' END AS kind FROM k)
WHERE end_ms - start_ms >= least""",
        u=rows,
        **({"h": thresholds} if thresholds is not None else {}),
    )


def event_anchors(events: DataFrame, u: DataFrame, key: str = "conv_id") -> DataFrame:
    """Each event with the first speaker row that starts at or after its end; a later event replaces one at the same row."""
    from .intervals import asof

    speakers = u.where("speaker IS NOT NULL").select(key, "seq", "start_ms", "speaker")
    found = asof(events, speakers, key, "end_ms", "start_ms", "seq", "speaker", forward=True)
    return found.groupBy(key, F.col("asof_turn").alias("seq")).agg(
        F.max_by(F.struct("start_ms", "end_ms", "kind"), F.struct("end_ms", "start_ms")).alias("_e")
    ).select(key, "seq", "_e.*")


def paragraphs(
    u: DataFrame, key: str = "conv_id", gap_ms: int = PARAGRAPH_GAP_MS, least_ms: int = MIN_SILENCE_MS, thresholds: DataFrame | None = None, marks: bool = False
) -> DataFrame:
    """(key, para, speaker, first_seq, start_ms, end_ms, n, content): runs of one label without a gap or a silence inside.

    Speakerless rows are skipped; the gap counts from the last speaker row. With ``marks``, ``silence`` says whether one precedes it."""
    label = "coalesce(nullif(name, ''), speaker)" if "name" in u.columns else "speaker"
    anchors = event_anchors(silence_events(u, key, least_ms, thresholds), u, key).select(key, F.col("seq").alias("_a"))
    return u.sparkSession.sql(
        f"""
WITH r AS (SELECT u.{key}, u.seq, {label} AS speaker, trim(content) AS content, start_ms, end_ms, a._a IS NOT NULL AS cut
  FROM {{u}} u LEFT JOIN {{a}} a ON u.{key} = a.{key} AND u.seq = a._a WHERE u.speaker IS NOT NULL),
b AS (SELECT *, CASE WHEN cut OR NOT speaker <=> lag(speaker) OVER w OR start_ms - lag(end_ms) OVER w >= {gap_ms} THEN 1 ELSE 0 END AS brk
  FROM r WINDOW w AS (PARTITION BY {key} ORDER BY seq)),
p AS (SELECT *, sum(brk) OVER (PARTITION BY {key} ORDER BY seq) AS para FROM b)
SELECT {key}, greatest(para, 1) AS para, speaker, min(seq) AS first_seq, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n,
  trim(listagg(content, ' ') WITHIN GROUP (ORDER BY seq)) AS content{", bool_or(cut) AS silence" if marks else ""}
FROM p GROUP BY {key}, greatest(para, 1), speaker""",
        u=u,
        a=anchors,
    )


def islands(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal ``value`` (null equals null): keys, run, first, last, n, value."""
    k = ", ".join(keys)
    return df.sparkSession.sql(
        f"""
SELECT {k}, run, min({order}) AS first, max({order}) AS last, count(*) AS n, max({value}) AS {value} FROM (
  SELECT *, sum(CASE WHEN {order} > lo AND NOT {value} <=> prev THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY {order}) AS run FROM (
    SELECT *, lag({value}) OVER (PARTITION BY {k} ORDER BY {order}) AS prev, min({order}) OVER (PARTITION BY {k}) AS lo FROM {{d}}))
GROUP BY {k}, run""",
        d=df,
    )


def audio_chunks(total: DataFrame, key: str, over_ms: int = 600_000, size_ms: int = 480_000, overlap_ms: int = 5000) -> DataFrame:
    """(key, chunk, start_ms, end_ms): one chunk up to ``over_ms`` in length, else overlapping ones."""
    step = size_ms - overlap_ms
    return total.sparkSession.sql(
        f"""
SELECT {key}, chunk, chunk * {step}L AS start_ms,
  CASE WHEN total_ms <= {over_ms} THEN total_ms ELSE least(chunk * {step}L + {size_ms}, total_ms) END AS end_ms
FROM (SELECT *, explode(sequence(0L, CASE WHEN total_ms <= {over_ms} THEN 0 ELSE (total_ms + {step - 1}) DIV {step} - 1 END)) AS chunk FROM {{t}})""",
        t=total,
    )


def cutoffs(total: DataFrame, key: str, over_ms: int = 600_000, size_ms: int = 480_000, overlap_ms: int = 5000) -> DataFrame:
    """(key, boundary, cutoff_ms) of every chunk but the first."""
    return audio_chunks(total, key, over_ms, size_ms, overlap_ms).where("chunk > 0").selectExpr(
        key, "chunk AS boundary", f"start_ms + {overlap_ms} AS cutoff_ms"
    )


def boundary_windows(u: DataFrame, cuts: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The last ``k`` rows that start before each cutoff and the first ``k`` at or after it.

    A cutoff's place among the numbered rows comes from one merged order, so each meets 2 ``k`` rows, however long the recording."""
    return u.sparkSession.sql(
        f"""
WITH r AS (SELECT {key}, seq, start_ms, row_number() OVER (PARTITION BY {key} ORDER BY start_ms, seq) AS rn FROM {{u}}),
m AS (SELECT {key}, boundary, n FROM (
  SELECT *, count(rn) OVER (PARTITION BY {key} ORDER BY t, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM (
    SELECT {key}, start_ms AS t, 1 AS kind, rn, CAST(NULL AS BIGINT) AS boundary FROM r
    UNION ALL SELECT {key}, cutoff_ms, 0, NULL, boundary FROM {{c}})) WHERE kind = 0),
p AS (SELECT *, explode(sequence({1 - k}, {k})) AS o FROM m)
SELECT p.{key}, p.boundary, CASE WHEN o <= 0 THEN 'tail' ELSE 'head' END AS side, CASE WHEN o <= 0 THEN 1 - o ELSE o END AS rank, r.seq
FROM p JOIN r ON p.{key} = r.{key} AND r.rn = p.n + p.o""",
        u=u,
        c=cuts,
    )


def merge_same_title(s: DataFrame, key: str = "conv_id") -> DataFrame:
    """Neighbours of equal title (trimmed, any case) become one section with the first one's title."""
    return s.sparkSession.sql(
        f"""
SELECT {key}, grp, min_by(title, start_ms) AS title, min(start_ms) AS start_ms, max_by(end_ms, start_ms) AS end_ms FROM (
  SELECT *, sum(CASE WHEN lower(trim(title)) <=> prev THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY start_ms) AS grp FROM (
    SELECT *, lag(lower(trim(title))) OVER (PARTITION BY {key} ORDER BY start_ms) AS prev FROM {{s}}))
GROUP BY {key}, grp""",
        s=s,
    )


def snap_sections(s: DataFrame, bounds: DataFrame, key: str = "conv_id") -> DataFrame:
    """Contained sections go; starts become the previous end (the first: total_start); the last covers total_end."""
    return s.sparkSession.sql(
        f"""
WITH k AS (
  SELECT s.{key}, s.title, s.end_ms, b.total_start_ms, b.total_end_ms, s.start_ms,
    greatest(b.total_start_ms, coalesce(max(s.end_ms) OVER (PARTITION BY s.{key} ORDER BY s.start_ms, s.end_ms
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b.total_start_ms)) AS prior
  FROM {{s}} s JOIN {{b}} b ON s.{key} = b.{key}),
f AS (SELECT *, lead(end_ms) OVER (PARTITION BY {key} ORDER BY start_ms, end_ms) AS nxt FROM k WHERE end_ms > prior)
SELECT {key}, title, prior AS start_ms, CASE WHEN nxt IS NULL THEN greatest(end_ms, total_end_ms) ELSE end_ms END AS end_ms FROM f""",
        s=s,
        b=bounds,
    )


def fuse_sections(s: DataFrame, key: str = "conv_id", most: int = 7) -> DataFrame:
    """Fuses the neighbours of the smallest combined span until ``most`` are left. Iterative, so grouped pandas: a recording has few sections."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("start_ms")[["title", "start_ms", "end_ms"]].values.tolist()
        while len(rows) > most:
            spans = [b[2] - b[1] + a[2] - a[1] for a, b in zip(rows, rows[1:], strict=False)]
            i = spans.index(min(spans))
            (t1, s1, e1), (t2, s2, e2) = rows[i], rows[i + 1]
            rows[i : i + 2] = [[t1 if e1 - s1 >= e2 - s2 else t2, s1, e2]]
        out = pd.DataFrame(rows, columns=["title", "start_ms", "end_ms"])
        out.insert(0, key, pdf[key].iloc[0])
        return out

    return s.select(key, "title", "start_ms", "end_ms").groupBy(key).applyInPandas(run, f"{key} long, title string, start_ms long, end_ms long")


def reconcile(s: DataFrame, bounds: DataFrame, key: str = "conv_id", most: int = 7) -> DataFrame:
    """Sections of overlapping chunks as one contiguous list of at most ``most``."""
    merged = merge_same_title(snap_sections(s, bounds, key), key)
    return fuse_sections(merged, key, most)


def speaker_chunks(u: DataFrame, key: str = "conv_id", size: int = 35, overlap: int = 2, extend: int = 5) -> DataFrame:
    """(key, chunk, first_seq, last_seq, n): chunks that don't cut a monologue short, within ``extend`` rows.

    Where a chunk starts depends on where the one before ended, so grouped pandas over two columns."""
    if size <= 0 or not 0 <= overlap < size or extend < 0:
        raise ValueError("size > 0, 0 <= overlap < size and extend >= 0 are required")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        who, seq, rows, at = pdf["speaker"].tolist(), pdf["seq"].tolist(), [], 0
        while at < len(seq):
            end = min(at + size, len(seq))
            last, limit = who[end - 1], min(len(seq), end + extend)
            while end < limit and who[end] == last:
                end += 1
            rows.append((len(rows), seq[at], seq[end - 1], end - at))
            if end >= len(seq):
                break
            at = end - overlap
        out = pd.DataFrame(rows, columns=["chunk", "first_seq", "last_seq", "n"])
        out.insert(0, key, pdf[key].iloc[0])
        return out

    return u.select(key, "seq", "speaker").groupBy(key).applyInPandas(run, f"{key} long, chunk long, first_seq long, last_seq long, n long")


def neighbour_context(u: DataFrame, key: str = "conv_id", n: int = 3) -> DataFrame:
    """Adds ``before`` and ``after``: lines of the ``n`` rows on either side, from the rows as they are."""
    line = "concat(coalesce(concat('[', nullif(speaker, ''), '] '), ''), content)"
    return u.sparkSession.sql(
        f"""
SELECT *, array_join(collect_list({line}) OVER (PARTITION BY {key} ORDER BY seq ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), '\\n') AS before,
  array_join(collect_list({line}) OVER (PARTITION BY {key} ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING), '\\n') AS after
FROM {{u}}""",
        u=u,
    )


def rank_attempts(t: DataFrame, key: str, least_ms: int = 2000) -> DataFrame:
    """The longest eligible turn and the longest of any other owner."""
    return t.sparkSession.sql(
        f"""
WITH e AS (SELECT *, end_ms - start_ms AS dur FROM {{t}} WHERE end_ms - start_ms >= {least_ms}),
f AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY dur DESC, turn_id) AS r FROM e),
o AS (SELECT *, max(CASE WHEN r = 1 THEN label END) OVER (PARTITION BY {key}) AS top FROM f),
q AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY CASE WHEN label = top THEN 1 ELSE 0 END, dur DESC, turn_id) AS r2 FROM o)
SELECT {key}, turn_id, label, dur, CASE WHEN r = 1 THEN 1 ELSE 2 END AS attempt FROM q WHERE r = 1 OR (r2 = 1 AND label <> top)""",
        t=t,
    )


def greedy_fill(t: DataFrame, key: str, owner: str = "label", target_ms: int = 30_000) -> DataFrame:
    """Per owner the longest turns, longest first, until ``target_ms`` is reached."""
    return t.sparkSession.sql(
        f"""
SELECT {key}, {owner}, turn_id, dur FROM (
  SELECT *, sum(dur) OVER (PARTITION BY {key}, {owner} ORDER BY dur DESC, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM (SELECT *, end_ms - start_ms AS dur FROM {{t}})) WHERE coalesce(before, 0) < {target_ms}""",
        t=t,
    )


def tile_regions(t: DataFrame, total: DataFrame, key: str) -> DataFrame:
    """Turns as tiles that don't overlap (``gain`` true), with the gaps between them and the tail (``gain`` false)."""
    return t.sparkSession.sql(
        f"""
WITH c AS (SELECT t.{key}, t.end_ms, greatest(t.start_ms, coalesce(max(t.end_ms) OVER w, 0)) AS start_ms, coalesce(max(t.end_ms) OVER w, 0) AS cursor
  FROM {{t}} t WINDOW w AS (PARTITION BY {key} ORDER BY start_ms, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT * FROM c WHERE end_ms > start_ms)
SELECT {key}, start_ms, end_ms, true AS gain FROM k
UNION ALL SELECT {key}, cursor, start_ms, false FROM k WHERE start_ms > cursor
UNION ALL SELECT a.{key}, coalesce(m, 0), total_ms, false FROM {{a}} a LEFT JOIN (SELECT {key}, max(end_ms) AS m FROM k GROUP BY {key}) b ON a.{key} <=> b.{key}
  WHERE total_ms > coalesce(m, 0)""",
        t=t,
        a=total,
    )


def first_rows(u: DataFrame, keys: list[str], n: int = 3, chars: int = 120) -> DataFrame:
    """The first ``n`` rows of each group, content cut at ``chars``: a preview, so the limit is the feature."""
    k = ", ".join(keys)
    return u.sparkSession.sql(
        f"SELECT {k}, seq, rank, substring(content, 1, {chars}) AS line FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY seq) AS rank FROM {{u}}) WHERE rank <= {n}",
        u=u,
    )


