"""De-duplication where transcript chunks overlap: what a chunk repeats of the one before it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import TOKEN

WINDOW_MS, PAIRWISE, SUPERSEDE, LEAST_TOKENS = 30_000, 0.5, 0.3, 3


def _similar(a: list[str], b: list[str]) -> float:
    x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def join_chunks(tail: list[dict], head: list[dict], window_ms: int = WINDOW_MS, pairwise: float = PAIRWISE, supersede: float = SUPERSEDE, least: int = LEAST_TOKENS) -> list[dict]:
    """Rows of two chunks, in order, without what the second repeats. Rows: start_ms, end_ms, tokens.

    The first long row that is no repetition ends the scan; if the rows that it overlaps in time resemble it together, it replaces them."""
    if not tail or not head:
        return [*tail, *head]
    since = tail[-1]["end_ms"] - window_ms
    near = [r for r in tail if r["end_ms"] >= since]
    kept: list[dict] = []
    for at, row in enumerate(head):
        if len(row["tokens"]) < least:
            kept.append(row)
            continue
        if near and max(_similar(row["tokens"], r["tokens"]) for r in near) >= pairwise:
            continue
        over = [r for r in near if row["start_ms"] < r["end_ms"] and row["end_ms"] > r["start_ms"]]
        if over and _similar(row["tokens"], [t for r in over for t in r["tokens"]]) >= supersede:
            gone = {id(r) for r in over}
            tail = [r for r in tail if id(r) not in gone]
        return [*tail, *kept, *head[at:]]
    return [*tail, *kept]


def dedup_chunks(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """All chunks of each recording joined one after another. Rows: key, chunk, seq, start_ms, end_ms, content.

    What is kept of a chunk decides what the next one meets, so grouped pandas, in parallel over recordings."""
    find = re.compile(TOKEN).findall

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chunk", "seq"])
        pdf["tokens"] = [[w.lower() for w in find(t or "")] for t in pdf["content"]]
        held: list[dict] = []
        for _, chunk in pdf.groupby("chunk", sort=True):
            held = join_chunks(held, chunk.to_dict("records"))
        return pd.DataFrame([{c: r[c] for c in (key, "chunk", "seq", "start_ms", "end_ms", "content")} for r in held], columns=[key, "chunk", "seq", "start_ms", "end_ms", "content"])

    return rows.select(key, "chunk", "seq", "start_ms", "end_ms", "content").groupBy(key).applyInPandas(
        run, f"{key} long, chunk long, seq long, start_ms long, end_ms long, content string"
    )


def dedup_boundary(tail: DataFrame, head: DataFrame, key: str = "conv_id") -> DataFrame:
    """One boundary for each key as relations: which rows of ``head`` and ``tail`` are dropped (key, side, seq).

    Inputs have key, seq, start_ms, end_ms and ``tok`` (array). The row that ends the scan is the first long one without a
    similar row in the tail; long rows before it go, and the tail rows it replaces go."""
    similar = "CASE WHEN size(array_union({0}, {1})) = 0 THEN 0 ELSE size(array_intersect({0}, {1})) / size(array_union({0}, {1})) END"
    return tail.sparkSession.sql(
        f"""
WITH l AS (SELECT {key}, max_by(end_ms, seq) AS last FROM {{t}} GROUP BY {key}),
n AS (SELECT t.* FROM {{t}} t JOIN l ON t.{key} = l.{key} AND t.end_ms >= l.last - {WINDOW_MS}),
m AS (SELECT h.{key}, h.seq, max({similar.format("h.tok", "n.tok")}) AS best FROM {{h}} h JOIN n ON h.{key} = n.{key}
  WHERE size(h.tok) >= {LEAST_TOKENS} GROUP BY h.{key}, h.seq),
s AS (SELECT {key}, min(CASE WHEN best < {PAIRWISE} THEN seq END) AS stop FROM m GROUP BY {key}),
o AS (SELECT n.{key}, n.seq, n.tok, h.tok AS htok FROM s JOIN {{h}} h ON h.{key} = s.{key} AND h.seq = s.stop
  JOIN n ON n.{key} = h.{key} AND h.start_ms < n.end_ms AND h.end_ms > n.start_ms),
u AS (SELECT {key} FROM (SELECT {key}, array_distinct(flatten(collect_list(tok))) AS tok, max(htok) AS htok FROM o GROUP BY {key})
  WHERE {similar.format("htok", "tok")} >= {SUPERSEDE})
SELECT m.{key}, 'head' AS side, m.seq FROM m JOIN s ON m.{key} = s.{key} WHERE s.stop IS NULL OR m.seq < s.stop
UNION ALL SELECT o.{key}, 'tail', o.seq FROM o JOIN u ON o.{key} = u.{key}""",
        t=tail,
        h=head,
    )
