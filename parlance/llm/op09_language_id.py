"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1/-1 (``DIMENSIONS`` long). An n-gram's vector binds (multiplies) the vectors of its
letters, each permuted (rotated) by its place; a text's vector bundles (adds) those of all its n-grams, known or not, and a language's
prototype bundles those of its training texts. A text gets the language whose prototype has the largest cosine.

As bundling is linear, a batch of texts enters as n-gram counts: one matrix product turns them into the texts' vectors. The
vectors of a batch's n-grams are made for the batch, ``BLOCK`` at a time, from a table of ``CODES`` letters, so memory does not follow
the number of n-grams. Prototypes are summed by task, language and place; the driver receives ``DIMENSIONS`` numbers a language.

Letters of the Latin alphabet below have a vector each; all others (Cyrillic, Greek, Arabic, CJK ...) share ``CODES - 64`` vectors by a hash.
``score`` is a softmax of the cosines (times ``SHARPNESS``), the probability given to the language chosen: 0 to 1; ``cosine`` is the
largest cosine itself, low for what is no language that was learnt.

Bounds of the fit: about ``PER_LANGUAGE`` texts of each language, chosen by a hash of their id, so that a rare language is learnt from all
of its texts; the ``LANGUAGES`` most frequent languages. Every document is judged.

Defined results: ``und`` with score 0 for null texts and texts without letters; equal texts get equal results; ties go to the language
first in order; a table without any training text gives ``und`` everywhere; an empty table gives an empty result; further columns are kept by
:func:`identify`, whose new columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, trim

NAME = "op9_language_id"
DIMENSIONS, N, SEED, SHARPNESS = 1024, 3, 7, 40.0
#: Letters with a vector of their own; 0 is the space between words.
ALPHABET = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßœš"
BITS = 12
CODES = 1 << BITS
BLOCK, TEXTS, CHARS = 4096, 256, 1 << 21
UNKNOWN = "und"
PER_LANGUAGE, LANGUAGES = 5_000, 2_000


def letter_code(point: int) -> int:
    """Code of a character; 0 for what is no letter."""
    ch = chr(point).lower()[:1]
    if ch in ALPHABET:
        return ALPHABET.index(ch) + 1
    return 64 + (ord(ch) * 2654435761 >> 7) % (CODES - 64) if ch.isalpha() else 0


def letter_table() -> np.ndarray:
    return np.array([letter_code(c) for c in range(0x250)], np.int64)


def codes(text: str, table: np.ndarray) -> np.ndarray:
    """n-gram codes of a text, with one space between words; empty without letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = table[np.minimum(points, 0x24F)]
    if len(points) and points.max() >= 0x250:
        far = np.flatnonzero(points >= 0x250)
        kinds, at = np.unique(points[far], return_inverse=True)
        low[far] = np.array([letter_code(int(c)) for c in kinds], np.int64)[at]
    low = low[(low > 0) | np.r_[False, low[:-1] > 0]] if len(low) else low  # runs of non-letters count once
    if not low.any():
        return np.empty(0, np.int64)
    low = np.r_[0, low, 0] if low[-1] else np.r_[0, low]
    return (low[:-2] << 2 * BITS) | (low[1:-1] << BITS) | low[2:]


class Space:
    """The letters' vectors, and bundles of texts."""

    def __init__(self):
        letters = np.random.default_rng(SEED).integers(0, 2, (CODES, DIMENSIONS), dtype=np.int8) * 2 - 1
        self.placed = [np.roll(letters, N - 1 - place, axis=1) for place in range(N)]
        self.table = letter_table()

    def grams(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones((len(grams), DIMENSIONS), np.int8)
        for place, letters in enumerate(self.placed):
            out *= letters[(grams >> BITS * (N - 1 - place)) & (CODES - 1)]
        return out.astype(np.float32)

    def bundles(self, texts: list) -> np.ndarray:
        """One row for each text; zeros for texts without letters."""
        found = [codes(t, self.table) if isinstance(t, str) else np.empty(0, np.int64) for t in texts]
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        grams, at = np.unique(np.concatenate([np.empty(0, np.int64), *found]), return_inverse=True)
        row = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        for a in range(0, len(grams), BLOCK):
            width = min(BLOCK, len(grams) - a)
            here = (at >= a) & (at < a + width) if len(grams) > BLOCK else slice(None)
            counts = np.bincount(row[here] * width + at[here] - a, minlength=len(texts) * width).reshape(len(texts), width)
            out += counts.astype(np.float32) @ self.grams(grams[a : a + width])
        return out

    def batches(self, texts: list) -> Iterator[tuple[int, np.ndarray]]:
        """(first place, bundles) of some texts at a time."""
        start, size = 0, 0
        for k, t in enumerate(texts):
            size += len(t) if isinstance(t, str) else 0
            if k + 1 == len(texts) or k + 1 - start == TEXTS or size >= CHARS:
                yield start, self.bundles(texts[start : k + 1])
                start, size = k + 1, 0


_space: list[Space] = []


def space() -> Space:
    """One for each worker process."""
    if not _space:
        _space.append(Space())
    return _space[0]


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


class Profiles:
    """Prototypes of languages; a language weighs the same, however many texts it was learnt from."""

    def __init__(self, sums: dict[str, np.ndarray]):
        self.languages = sorted(sums)
        self.prototypes = unit(np.array([sums[la] for la in self.languages]).reshape(-1, DIMENSIONS)).astype(np.float32)

    def score(self, texts: list) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(languages, scores, cosines)"""
        langs, scores, cosines = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        if not self.languages:
            return langs, scores, cosines
        for a, bundled in space().batches(texts):
            cosine = unit(bundled) @ self.prototypes.T
            p = np.exp(SHARPNESS * (cosine - cosine.max(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            for k in np.flatnonzero(bundled.any(1)):
                i = cosine[k].argmax()
                langs[a + k], scores[a + k], cosines[a + k] = self.languages[i], min(p[k, i], 1.0), cosine[k, i]
        return langs, scores, cosines


def learn(texts: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles from every row whose language is not null."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}

        def drained() -> Iterator[pd.DataFrame]:
            while sums:
                la, total = sums.popitem()
                yield pd.DataFrame({"lang": la, "place": np.arange(DIMENSIONS), "n": total.astype(np.int64)})

        for pdf in batches:
            own = pdf["lang"].tolist()
            for a, bundled in space().batches(pdf["text"].tolist()):
                for k, row in enumerate(bundled):
                    sums.setdefault(own[a + k], np.zeros(DIMENSIONS))
                    sums[own[a + k]] += row
            if len(sums) > 64:  # bounded however many languages there are
                yield from drained()
        yield from drained()
        trim()

    usable = texts.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    summed = usable.mapInPandas(add, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    sums = {la: own.sort_values("place")["n"].to_numpy(float) for la, own in summed.groupby("lang")}
    return Profiles({la: v for la, v in sums.items() if v.any()})


def identify(df: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """All rows and columns of ``df`` plus ``lang_pred``, ``score`` and ``cosine``."""
    kept = [c for c in df.columns if c not in ("lang_pred", "score", "cosine")]

    @F.pandas_udf("lang_pred string, score double, cosine double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores, cosines = profiles.score(texts.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": scores, "cosine": cosines})
        trim()

    judged = df.select(F.struct(*kept).alias("row"), predict(text).alias("p"))
    return judged.select(*[F.col(f"row.`{c}`") for c in kept], "p.lang_pred", "p.score", "p.cosine")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> DataFrame:
    """(text, lang) of rows that may be learnt from: about ``per_language`` of each language, chosen by a hash of their id."""
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    share = (F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n")) * (1 << 30)).cast("long")
    # a row for each language, ``languages`` at most
    shares = F.broadcast(counts.select("lang", share.alias("upto")))
    return usable.join(shares, "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) < F.col("upto")).select("text", "lang")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = learn(training_rows(docs))
    return identify(docs.select("doc_id", "text"), profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cosine")


#: A document whose largest cosine is lower is in no language that was learnt.
LEAST_COSINE = 0.25


def accepted(lang: str = "lang", least: float = LEAST_COSINE):
    """Whether a judged document stays: in a known language, and in the one that it is said to be in, if it is said."""
    agrees = F.col(lang).isNull() | (F.col(lang) == F.col("lang_pred"))
    return (F.col("lang_pred") != UNKNOWN) & (F.col("cosine") >= least) & agrees


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents recognised in a known language, in their stated ``lang`` where they have one."""
    found = identify(docs.select(F.struct(*docs.columns).alias("doc"), "text", F.col("lang").alias("stated")), learn(training_rows(docs)))
    return found.where(accepted("stated")).select(*[F.col(f"doc.`{c}`") for c in docs.columns])
