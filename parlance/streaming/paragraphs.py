"""Paragraphs of live conversations: the batch operator's rule kept as state for each conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "conv_id long, speaker string, first_seq long, start_ms long, end_ms long, n long, content string"
STATE = "speaker string, first_seq long, start_ms long, end_ms long, n long, content string"


def live_paragraphs(u: DataFrame, gap_ms: int = 2000, idle_ms: int | None = 30_000) -> DataFrame:
    """Finished paragraphs of a stream of rows (conv_id, seq, speaker, content, start_ms, end_ms).

    Rows of a conversation arrive in order. A paragraph ends when the label changes, after a gap, or when nothing has come for
    ``idle_ms`` of processing time (never, if None). State: the open paragraph alone."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_row = list(state.get) if state.exists else None
        done = []
        if state.hasTimedOut:
            if open_row:
                done.append((key[0], *open_row))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("seq")
            for r in rows.itertuples(index=False):
                if r.speaker is None or r.speaker != r.speaker:
                    continue
                text = (r.content or "").strip()
                if open_row and r.speaker == open_row[0] and r.start_ms - open_row[3] < gap_ms:
                    open_row[3], open_row[4], open_row[5] = int(r.end_ms), open_row[4] + 1, f"{open_row[5]} {text}".strip()
                else:
                    if open_row:
                        done.append((key[0], *open_row))
                    open_row = [r.speaker, int(r.seq), int(r.start_ms), int(r.end_ms), 1, text]
            if open_row:
                state.update(tuple(open_row))
                if idle_ms is not None:
                    state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(done, columns=[c.split()[0] for c in OUT.split(", ")])

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return u.groupBy("conv_id").applyInPandasWithState(run, OUT, STATE, "append", timeout)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of events (ts timestamp, user_id) by a gap, for batch and streams; late rows beyond the watermark are dropped by Spark."""
    from pyspark.sql import functions as F

    return (
        events.withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )
