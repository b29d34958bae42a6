"""Quality classifier by co-training of two views.

*Text view*: the words of a document's whole text, counted in ``WORDS`` hashed buckets, and statistics of its characters, words and
lines. *Metadata view*: its source, language and stated length. Each has a logistic regression of its own, learnt from ``labels.quality``. For
``ROUNDS`` rounds each view labels the unlabelled documents of which it is surest (calibrated probability of at least ``SURE``, in the
proportion of its classes) and hands them to the other view, which learns from them as from labels. Both are then calibrated on labelled
rows that neither has learnt from, a logistic combination of their calibrated log-odds is fitted there, and all documents are scored.

Texts are read once: features of all documents (``TEXT_FEATURES`` half-precision numbers each) are written to the shared folder, and fitting
and scoring read those. The surest documents of a round are found among *all* unlabelled ones: each task keeps its own ``EACH`` surest
of either class and view, a distributed top-k takes the surest of these, and ``4 * EACH`` rows reach the driver.

Bounds: at most ``LABELLED`` labelled rows, chosen by a hash of their id, are used to fit, and ``EACH`` pseudo-labels a view and round. Rows
with crc32(doc_id as text) mod 4 = 2 are held out of all fitting.

Defined results: null and empty texts have zero statistics and are scored as such; null metadata are values of their own; of
repeated labels the largest counts, of repeated documents each row is scored; without labels of both classes every score is the share of good
labels (0.5 without any); an empty table gives an empty result; further columns are kept by :func:`score_documents`, whose new columns replace
columns of the same name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, id_in, id_out, load, written
from .op09_language_id import held_out

NAME = "op8_quality_classifier"
LABELLED, ROUNDS, SURE, EACH = 8_000, 4, 0.95, 200
SOURCES, LANGS, WORDS = 32, 8, 64
STATISTICS = 14
TEXT_FEATURES, META_FEATURES = STATISTICS + WORDS, SOURCES + LANGS + 3
CACHE_WORDS = 200_000
#: Words' features are spread by at least this much, so that the statistics, which are few, outweigh them where labels are few.
LEAST_SPREAD = np.r_[np.full(STATISTICS, 1e-6), np.full(WORDS, 0.2)]
KINDS = 9  # other, lower, upper, digit, space, newline, mark, symbol, exclamation


def kind_table() -> np.ndarray:
    table = np.zeros(0x250, np.uint8)
    for c in range(0x250):
        ch = chr(c)
        table[c] = 8 if ch == "!" else 7 if ch in "#*$%&|<>@^~=+\\" else 5 if ch == "\n" else 4 if ch.isspace() else 3 if ch.isdigit() else 2 if ch.isupper() else 1 if ch.isalpha() else 6 if ch.isprintable() else 0
    return table


class TextView:
    """Features of texts; a bounded cache holds the buckets of words."""

    def __init__(self):
        self.table = kind_table()
        self.buckets: dict[str, int] = {}

    def words(self, words: list[str]) -> np.ndarray:
        """Share of the text's words in each bucket, as square roots, which keep rare words visible."""
        known, kinds = self.buckets, set(words)
        new = kinds.difference(known)
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = kinds
        for w in new:
            known[w] = (zlib.crc32(w.strip(".,;:!?\"'()").encode("utf-8", "surrogatepass")) * 0x9E3779B1 & 0xFFFFFFFF) * WORDS >> 32
        counts = np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), minlength=WORDS)
        return np.sqrt(counts / max(len(words), 1))

    def __call__(self, text: str | None) -> bytes:
        """``TEXT_FEATURES`` numbers of half precision."""
        text = text if isinstance(text, str) else ""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = np.bincount(self.table[np.minimum(points, 0x24F)], minlength=KINDS) / max(len(points), 1)
        words = text.split()
        n = max(len(words), 1)
        lines = [x for x in text.split("\n") if x.strip()]
        more = [
            np.log1p(len(words)) / 10,
            min(len(text) / n / 20, 1e4),
            1 - len(set(words)) / n,
            1 - len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1),
            1 - len(set(lines)) / max(len(lines), 1),
        ]
        return np.r_[kinds, more, self.words([w.lower() for w in words])].astype("<f2").tobytes()


def meta_features(source: str | None, lang: str | None, n_chars: float | None) -> list[float]:
    out = [0.0] * META_FEATURES
    out[zlib.crc32(str(source).encode()) % SOURCES] = 1.0
    out[SOURCES + zlib.crc32(str(lang).encode()) % LANGS] = 1.0
    size = np.log1p(max(float(n_chars), 0.0)) / 10 if n_chars is not None and n_chars == n_chars else 0.0
    out[-3:] = [size, size * size, float(n_chars is None or n_chars != n_chars)]
    return out


def matrix(rows) -> np.ndarray:
    """Features of texts as numbers."""
    return np.frombuffer(b"".join(rows), "<f2").reshape(-1, TEXT_FEATURES).astype(float)


def meta_matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.array([meta_features(*x) for x in zip(pdf["source"], pdf["lang"], pdf["n_chars"], strict=True)]).reshape(-1, META_FEATURES)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights (bias last) by Newton's method; the bias is not shrunk."""
    x = np.c_[x, np.ones(len(x))]
    w, keep = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    keep[-1, -1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class View:
    """A standardised logistic regression with a calibration of its log-odds."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    calibration: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.centre) / self.spread, np.ones(len(x))] @ self.weights

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.calibration[0] * self.raw(x) + self.calibration[1]

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> View:
        centre, spread = x.mean(0), x.std(0) + 1e-6
        if x.shape[1] == TEXT_FEATURES:
            spread = np.maximum(spread, LEAST_SPREAD)
        view = View(centre, spread, logistic((x - centre) / spread, y), np.array([1.0, 0.0]))
        if 0 < cy.sum() < len(cy):
            view.calibration = logistic(view.raw(cx)[:, None], cy)
        return view


@dataclass
class Model:
    prior: float
    text: View | None = None
    meta: View | None = None
    mix: np.ndarray | None = None

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            flat = np.full(len(text), self.prior)
            return flat, flat, flat
        a, b = self.text.odds(text), self.meta.odds(meta)
        return sigmoid(a), sigmoid(b), sigmoid(np.c_[a, b, np.ones(len(a))] @ self.mix)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, surest, rounds: int = ROUNDS) -> Model:
    """Fits both views; rows at every fourth place calibrate, the others are learnt from.

    ``surest(views, good, bad)`` gives for each view (text, meta, label) of the unlabelled documents of which it is surest, ``good`` and
    ``bad`` ones at the most, never the same document twice."""
    if not len(y) or y.min() == y.max():
        return Model(float(y.mean()) if len(y) else 0.5)
    aside = np.arange(len(y)) % 4 == 3
    if y[aside].min(initial=1) == y[aside].max(initial=0) or y[~aside].min() == y[~aside].max():
        aside[:] = False
    cal = aside if aside.any() else ~aside
    own = [(text[~aside], y[~aside]), (meta[~aside], y[~aside])]
    good = min(max(1, round(EACH * y.mean())), EACH - 1)
    for turn in range(rounds + 1):
        fitted = [View.fit(*own[v], (text, meta)[v][cal], y[cal]) for v in (0, 1)]
        if turn == rounds:
            break
        handed = surest(fitted, good, EACH - good)
        if not any(len(h[2]) for h in handed):
            break
        for v in (0, 1):  # what a view is sure of goes to the other one
            x, z = own[1 - v]
            own[1 - v] = (np.vstack([x, handed[v][1 - v]]), np.r_[z, handed[v][2]])
    odds = np.c_[fitted[0].odds(text[cal]), fitted[1].odds(meta[cal])]
    return Model(float(y.mean()), fitted[0], fitted[1], logistic(odds, y[cal], ridge=0.1))


FEATURED = "doc_id long, source string, lang string, n_chars double, t binary"


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, n_chars, t) of every row, written: the only pass over the texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        view = TextView()
        for pdf in batches:
            yield pd.DataFrame({c: pdf[c] for c in ("doc_id", "source", "lang", "n_chars")} | {"t": [view(t) for t in pdf["text"]]})

    narrow = docs.select(id_in("doc_id"), "source", "lang", F.col("n_chars").cast("double").alias("n_chars"), "text")
    return written(narrow.mapInPandas(run, FEATURED), "op8-features")


TOP = FEATURED + ", view int, good int, p double"


def surest_of(pool: DataFrame):
    """The ``surest`` of :func:`co_train`: a distributed top-k over all rows of ``pool``."""
    taken: set[int] = set()  # at most 2 * EACH a round

    def surest(views: list[View], good: int, bad: int):
        gone = np.fromiter(taken, np.int64, len(taken))

        def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[tuple[int, int], pd.DataFrame] = {}
            for pdf in batches:
                pdf = pdf[~np.isin(pdf["doc_id"].to_numpy(np.int64), gone)]
                if not len(pdf):
                    continue
                for v, x in enumerate((matrix(pdf["t"]), meta_matrix(pdf))):
                    p = sigmoid(views[v].odds(x))
                    for kind, sure, most in ((1, p, good), (0, 1 - p, bad)):
                        part = pdf[sure >= SURE].assign(view=v, good=kind, p=sure[sure >= SURE])
                        both = pd.concat([held[v, kind], part]) if (v, kind) in held else part
                        held[v, kind] = both.sort_values(["p", "doc_id"], ascending=[False, True], kind="stable").head(2 * most)
            yield from held.values()

        tops = written(pool.mapInPandas(local, TOP), "op8-surest")
        best = None
        for v in (0, 1):
            for kind, most in ((1, good), (0, bad)):
                one = tops.where((F.col("view") == v) & (F.col("good") == kind)).dropDuplicates(["doc_id"]).orderBy(F.desc("p"), "doc_id").limit(most)
                best = one if best is None else best.unionByName(one)
        rows = best.toPandas().sort_values(["view", "good", "p", "doc_id"], ascending=[True, False, False, True])
        rows = rows.drop_duplicates("doc_id")  # a document that both are sure of goes to the second view alone
        taken.update(rows["doc_id"].tolist())
        parts = [rows[rows["view"] == v] for v in (0, 1)]
        return [(matrix(x["t"]), meta_matrix(x), x["good"].to_numpy(float)) for x in parts]

    return surest


def fit(features: DataFrame, labels: DataFrame) -> Model:
    """A model from the rows of :func:`featured` and from ``labels`` (doc_id, quality)."""
    usable = features.where((F.col("doc_id") != NULL_ID) & ~held_out())
    labels = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # at most LABELLED rows of two numbers: a bound that does not depend on the data
    few = written(labels.where(~held_out()).orderBy(F.xxhash64("doc_id", F.lit("labelled")), "doc_id").limit(LABELLED), "op8-labelled")
    rows = usable.join(F.broadcast(few), "doc_id").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id", kind="stable")
    pool = usable.join(F.broadcast(few.select("doc_id")), "doc_id", "left_anti")
    return co_train(matrix(rows["t"]), meta_matrix(rows), (rows["quality"].to_numpy(float) > 0).astype(float), surest_of(pool))


NEW = ["text_score", "meta_score", "quality_score", "kept"]


def score_features(features: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text_score, meta_score, quality_score, kept) of every row of :func:`featured`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b, c = model.score(matrix(pdf["t"]), meta_matrix(pdf))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_score": a, "meta_score": b, "quality_score": c, "kept": c >= threshold})

    scored = features.mapInPandas(run, "doc_id long, text_score double, meta_score double, quality_score double, kept boolean")
    return id_out(scored, "doc_id")


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """All rows and columns of ``docs`` plus ``text_score``, ``meta_score``, ``quality_score`` and ``kept``."""
    kept = [c for c in docs.columns if c not in NEW]

    @F.pandas_udf("text_score double, meta_score double, quality_score double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        view = TextView()
        for text, source, lang, n_chars in batches:
            meta = meta_matrix(pd.DataFrame({"source": source, "lang": lang, "n_chars": n_chars}))
            a, b, c = model.score(matrix([view(t) for t in text]), meta)
            yield pd.DataFrame({"text_score": a, "meta_score": b, "quality_score": c})

    judged = docs.select(F.struct(*kept).alias("row"), score("text", "source", "lang", F.col("n_chars").cast("double")).alias("s"))
    return judged.select(*[F.col(f"row.`{c}`") for c in kept], "s.*").withColumn("kept", F.col("quality_score") >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = featured(load(spark, sf_dir, "documents"))
    return score_features(features, fit(features, load(spark, sf_dir, "labels")))
