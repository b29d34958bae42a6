"""Harmonic packing of token sequences.

A document's ids (with its end id) fill whole sequences first. What is left falls into a reciprocal-capacity
class ``k``: lengths in (capacity/(k+1), capacity/k], of which ``k`` fill a sequence. A length that would waste over 3 %
of its share is cut (documents may be cut freely): a piece of exactly capacity/(k+1) goes to class k+1, the rest is classed
anew. Lengths up to capacity/32 form the last class, filled one after another until the next one does not fit.

Each task fills its own sequences, class by class, without a shuffle, and leaves fewer than ``k`` pieces of a class open. These are merged
in a tree: the open pieces of some neighbouring tasks (``GROUP_ROWS`` pieces of a class at most) fill sequences together and leave fewer
than ``k`` in turn, until each class has one group. What that leaves (fewer than ``k`` pieces for each of 32 classes, whatever the
input) is packed by first fit decreasing. Padding is below 4 % plus at most some sequences.

Defined results: a null or empty text is its end id alone; repeated rows are packed each; an empty table gives an
empty result; further columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_in, id_out, load, trim, written
from .tokens import encoder

NAME = "op6_packing"
CAPACITY, END_ID, CLASSES, WASTE, GROUP_ROWS = 2048, 1, 32, 0.03, 512
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bin_class int"
OPEN = COLUMNS + ", part int"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def pieces(length: int, capacity: int = CAPACITY, classes: int = CLASSES, waste: float = WASTE) -> list[tuple[int, int, int]]:
    """(start, length, class) of each piece of a document of ``length`` ids."""
    out, at = [], 0
    while length - at >= capacity:
        out.append((at, capacity, 1))
        at += capacity
    while (r := length - at) > 0:
        k = capacity // r
        if k >= classes:
            out.append((at, r, classes))
            return out
        if r >= (1 - waste) * (capacity // k):
            out.append((at, r, k))
            return out
        cut = capacity // (k + 1)
        out.append((at, cut, min(k + 1, classes)))
        at += cut
    return out


class Bins:
    """Open sequences of one task, one for each class; numbers sequences from ``first``."""

    def __init__(self, first: int, capacity: int = CAPACITY, classes: int = CLASSES):
        self.next, self.capacity, self.classes = first, capacity, classes
        self.open: dict[int, list[tuple]] = {}
        self.used: dict[int, int] = {}
        self.done: list[tuple] = []

    def close(self, k: int) -> None:
        at = 0
        for p in self.open.pop(k, []):
            self.done.append((*p, self.next, at, k))
            at += p[2]
        self.used.pop(k, None)
        self.next += 1

    def add(self, k: int, piece: tuple) -> None:
        """piece: (doc_id, start, length, ids_crc32, doc_tokens)"""
        if k >= self.classes and self.used.get(k, 0) + piece[2] > self.capacity:
            self.close(k)
        self.open.setdefault(k, []).append(piece)
        self.used[k] = self.used.get(k, 0) + piece[2]
        if self.used[k] == self.capacity or k < self.classes and len(self.open[k]) == k:
            self.close(k)

    def take(self) -> list[tuple]:
        out, self.done = self.done, []
        return out

    def left(self) -> list[tuple]:
        return [(*p, None, None, k) for k, ps in sorted(self.open.items()) for p in ps]


def frame(rows: list[tuple], part: int | None = None) -> pd.DataFrame:
    """Rows of pieces; ``part`` says where they were left open."""
    out = pd.DataFrame(rows, columns=NAMES, dtype=object).astype({c: "Int64" for c in NAMES})
    return out if part is None else out.assign(part=part)


def neighbours(bin_class: int, classes: int = CLASSES) -> int:
    """How many groups of a class are merged into one: each leaves fewer pieces than its class number (the last one a sequence's)."""
    return max(2, GROUP_ROWS // (bin_class if bin_class < classes else 4 * classes))


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text); see the module's docstring."""

    def first_round(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        bins = Bins(part << 36, capacity)
        end = int(end_id).to_bytes(4, "little")
        encode = encoder(tokenizer).encode
        for pdf in batches:
            for doc_id, ids in zip(pdf["doc_id"].tolist(), encode(pdf["text"]), strict=True):
                ids += end
                n = len(ids) // 4
                for start, length, k in pieces(n, capacity):
                    bins.add(k, (doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n))
                if len(bins.done) >= 20_000:
                    yield frame(bins.take(), part)
            yield frame(bins.take(), part)
        yield frame(bins.take() + bins.left(), part)
        trim()

    def merge(level: int):
        def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
            k, group = int(key[0]), int(key[1])
            bins = Bins((1 << 60) + (level << 56) + (k << 50) + (group << 24), capacity)
            for row in pdf.sort_values(["doc_id", "start", "length", "ids_crc32"])[NAMES[:5]].itertuples(index=False):
                bins.add(k, tuple(map(int, row)))
            return frame(bins.take() + bins.left(), group)

        return run

    def last_round(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used: list[int] = []
        rows = []
        pdf = pd.concat([frame([]), *batches])
        for row in pdf.sort_values(["length", "doc_id", "start"], ascending=False)[NAMES[:5] + ["bin_class"]].itertuples(index=False):
            *piece, k = map(int, row)
            at = next((i for i, u in enumerate(used) if u + piece[2] <= capacity), len(used))
            if at == len(used):
                used.append(0)
            rows.append((*piece, (2 << 60) + at, used[at], k))
            used[at] += piece[2]
        yield frame(rows)

    done = []
    left = written(docs.select(id_in("doc_id"), "text").mapInPandas(first_round, OPEN), "op6-first")
    fan = F.element_at(F.array(*[F.lit(neighbours(k)) for k in range(1, CLASSES + 1)]), F.col("bin_class"))
    level = 0
    while True:
        done.append(left.where("sequence_id IS NOT NULL").drop("part"))
        left = left.where("sequence_id IS NULL")
        # one group of each class is left in the end; a group shrinks by 4 or more a level
        if level and (left.agg(F.max("part").alias("part")).first()["part"] or 0) == 0:
            break
        grouped = left.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("bin_class", "part")
        left = written(grouped.applyInPandas(merge(level), OPEN), f"op6-level{level}")
        level += 1
    # at most k - 1 pieces for each class and one open sequence of small ones
    last = left.drop("part").coalesce(1).mapInPandas(last_round, COLUMNS)
    out = last
    for part in done:
        out = out.unionByName(part)
    return id_out(out, "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents that came this far."""
    return pack(docs.select("doc_id", "text"))
