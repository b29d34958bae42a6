"""MinHash near-dedup with an LSH forest.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents of equal sets are one vertex from the
start, named by their smallest doc_id. ``TREES`` signature orders (``DEPTH`` minima each) are sorted globally; rows that
share their first ``LEAST`` minima form a region. Neighbours by longest common prefix are candidates:

* a region of up to ``SMALL`` rows gives all its pairs;
* a larger one, up to ``BLOCK`` rows, gives pairs with its centres only (the row that agrees best with the most
  frequent minima, then the best of those it does not explain, and so on), and is a block;
* one beyond ``BLOCK`` rows is split where the common prefix gets longer, minimum by minimum: the depth adapts to the region.
  Since rows whose next minimum is their own leave such a split alone, the whole region is also compared with its centres
  and split again in ``ORDERS`` other orders of the minima.

Rows of regions that a partition's edge cuts, or that exceed a block, leave the sorted partitions and are dealt anew by region: whole
ones up to a block to one task; larger ones to a task for each order, and beyond ``LOCAL`` rows by their next minimum, level by level, so
neither a partition's edge nor a region's size decides which rows meet. Rows that agree in all ``LEVELS`` minima of an order are dealt in
pieces that share a row.

Pairs whose signatures (``TREES * DEPTH`` minima, a byte each) agree in less than ``likely`` are left out: for a link at the
limit the default is four standard deviations away, and 0 turns this off. All others are confirmed on full sets. A second round then looks
at each block again and compares the rows outside its main component with all rows of other components, so that a group of near copies of any
size is connected by a number of confirmed pairs in proportion to its rows, never by all its pairs. Texts meet a hub (a row with
many partners) in salted pieces, and a block whose sets exceed ``BLOCK_BYTES`` is compared in pairs of chunks: memory
follows neither a hub's partners nor the texts' lengths.

Defined results: texts without words (null, empty, blank) have no shingles, link with nothing and stay; fewer words than
the width make one shingle; a doc_id that occurs more than once stands for all its rows; a null doc_id links with nothing and
stays; an empty table gives an empty result; further columns do not matter to the query and are kept by the stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_in, id_out, load, trim, written
from .graph import components

NAME = "op1_minhash_forest"
WIDTH, PERCENT = 5, 80
TREES, DEPTH, LEAST = 10, 12, 2
SMALL, BLOCK, CENTRES, LIKELY = 12, 2048, 16, 0.655
ORDERS, LEVELS = 8, 36
LOCAL, HUB, BLOCK_BYTES = 16 * BLOCK, 256, 64 << 20
PREFIX = 1 + 2 * LEAST

_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)


def column_orders(tree: int) -> list[np.ndarray]:
    """LEVELS minima in an order for each split of a tree's regions: first the tree's own beyond the region's prefix, then other orders."""
    own = np.arange(tree * DEPTH + LEAST, (tree + 1) * DEPTH)
    orders = [_rng.permutation(TREES * DEPTH)[:LEVELS] for _ in range(ORDERS)]
    return [np.r_[own, np.setdiff1d(orders[0], own, assume_unique=True)][:LEVELS], *orders]


COLUMN_ORDERS = [column_orders(tree) for tree in range(TREES)]


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts; a bounded cache holds the hashes of words."""

    def __init__(self, width: int, cache_words: int = 200_000):
        self.width, self.cache_words = width, cache_words
        self.cache: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        # bytes.lower() touches A-Z alone; bytes.split() splits at space and \t-\r alone
        ws = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
        if not ws:
            return np.empty(0, np.uint64)
        cache = self.cache
        new = set(ws).difference(cache)
        if len(cache) + len(new) > self.cache_words:
            cache.clear()
            new = set(ws)
        for w in new:
            cache[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(cache.__getitem__, ws), np.uint64, len(ws))
        width = min(self.width, len(h))
        out = mixed(h[: len(h) - width + 1] + np.uint64(len(h) if len(h) < self.width else self.width))
        for k in range(1, width):
            out = mixed(out ^ h[k : len(h) - width + 1 + k])
        return np.unique(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def minima(hashes: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima as 16-bit values; a long document is taken in pieces."""
    low = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 2048):
        np.minimum(low, (FACTORS[:, None] * hashes[None, a : a + 2048] + OFFSETS[:, None]).min(1), out=low)
    return (mixed(low) >> np.uint64(48)).astype(np.uint16)


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, digest, sig) of every row; digest and sig are null without shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        shingle = Shingler(width)
        for pdf in batches:
            n, digest, sig = [], [], []
            for text in pdf["text"]:
                s = shingle(text)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(minima(s).astype(">u2").tobytes() if len(s) else None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": n, "digest": digest, "sig": sig})
        del shingle
        trim()

    return id_out(docs.select(id_in("doc_id"), "text").mapInPandas(run, "doc_id long, n_shingles long, digest binary, sig binary"), "doc_id")


def agreement(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return (many == one).mean(1)


def all_pairs(ids: np.ndarray, sig: np.ndarray, likely: float) -> list[tuple[int, int]]:
    out = []
    for i in range(len(ids) - 1):
        out += [(ids[i], ids[i + 1 + j]) for j in np.flatnonzero(agreement(sig[i], sig[i + 1 :]) >= likely) if ids[i] != ids[i + 1 + j]]
    return out


def centre_pairs(ids: np.ndarray, sig: np.ndarray, likely: float) -> list[tuple[int, int]]:
    """Pairs of a region's centres with the rows that they explain; what is left at the end is small or left to round two."""
    out, left = [], np.arange(len(ids))
    for _ in range(CENTRES):
        if len(left) <= SMALL:
            return out + all_pairs(ids[left], sig[left], likely)
        part = sig[left]
        modes = np.array([np.bincount(c, minlength=256).argmax() for c in part.T], np.uint8)
        centre = left[agreement(modes, part).argmax()]
        near = agreement(sig[centre], sig) >= likely
        out += [(ids[centre], x) for x in ids[near] if x != ids[centre]]
        left = left[~near[left]]
    return out


class Regions:
    """Candidate pairs, blocks, and the rows that leave a sorted partition."""

    def __init__(self, name: str, likely: float = LIKELY):
        self.name, self.likely, self.blocks = name, likely, 0
        self.pairs: list[tuple[int, int]] = []
        self.rows: list[tuple[str, str, int, bytes, bytes]] = []  # (kind, block, doc, key, sig)

    def block(self, ids: np.ndarray, sig: np.ndarray) -> None:
        block = f"{self.name}-{self.blocks}"
        self.blocks += 1
        self.rows += [("block", block, int(i), b"", s.tobytes()) for i, s in zip(ids, sig, strict=True)]

    def region(self, ids: np.ndarray, sig: np.ndarray) -> None:
        """A whole region of up to BLOCK rows."""
        if len(ids) <= SMALL:
            self.pairs += all_pairs(ids, sig, self.likely)
        else:
            self.pairs += centre_pairs(ids, sig, self.likely)
            self.block(ids, sig)

    def split(self, ids: np.ndarray, sig: np.ndarray, order: np.ndarray) -> None:
        """Rows by their minima in an order, until BLOCK rows or fewer share them; round two compares those."""
        if len(ids) <= SMALL:
            self.pairs += all_pairs(ids, sig, self.likely)
        elif len(ids) <= BLOCK:
            self.block(ids, sig)
        elif len(order):
            by = np.argsort(sig[:, order[0]], kind="stable")
            for at in np.split(by, 1 + np.flatnonzero(np.diff(sig[by, order[0]]))):
                self.split(ids[at], sig[at], order[1:])
        else:  # as good as equal: pieces that share their first row
            for a in range(1, len(ids), BLOCK - 1):
                at = np.r_[0, np.arange(a, min(len(ids), a + BLOCK - 1))]
                self.pairs += centre_pairs(ids[at], sig[at], self.likely)
                self.block(ids[at], sig[at])

    def large(self, ids: np.ndarray, sig: np.ndarray, tree: int, order: int, level: int = 0) -> None:
        """Rows of a region beyond BLOCK, in one of its orders; ``level`` minima are the same in all of them already."""
        if order == 0:
            self.pairs += centre_pairs(ids, sig, self.likely)
        self.split(ids, sig, COLUMN_ORDERS[tree][order][level:])

    def leave(self, keys: list[bytes], ids: np.ndarray, sig: np.ndarray) -> None:
        self.rows += [("open", "", int(i), k, s.tobytes()) for k, i, s in zip(keys, ids, sig, strict=True)]


COLUMNS = "kind string, block string, a long, b long, key binary, sig binary"


def as_frame(regions: Regions) -> pd.DataFrame:
    """What the regions gave so far; takes it off them."""
    out = [("pair", "", int(min(p)), int(max(p)), None, None) for p in dict.fromkeys(regions.pairs)]
    out += [(kind, block, i, None, key, s) for kind, block, i, key, s in regions.rows]
    regions.pairs, regions.rows = [], []
    return pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")], dtype=object).astype({"a": "Int64", "b": "Int64"})


def signature_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def sorted_regions(likely: float = LIKELY):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One partition of the sorted forest. Memory: a batch and a block."""
        regions, keys, ids, sig = Regions(f"p{TaskContext.get().partitionId()}", likely), [], np.empty(0, np.int64), np.empty((0, TREES * DEPTH), np.uint8)
        leaving = None  # the first region, whose head may be elsewhere, then any that exceeds a block
        for pdf in batches:
            if not len(pdf):
                continue
            keys = keys + pdf["key"].tolist()
            ids = np.concatenate([ids, pdf["v"].to_numpy(np.int64)])
            sig = np.concatenate([sig, signature_rows(pdf["bytes"])])
            if leaving is None:
                leaving = keys[0][:PREFIX]
            starts = [0, *(i for i in range(1, len(keys)) if keys[i][:PREFIX] != keys[i - 1][:PREFIX]), len(keys)]
            for a, b in zip(starts, starts[1:], strict=False):
                prefix = keys[a][:PREFIX]
                if b - a > BLOCK:
                    leaving = prefix
                if prefix == leaving:
                    regions.leave(keys[a:b], ids[a:b], sig[a:b])
                elif b < len(keys):
                    regions.region(ids[a:b], sig[a:b])
            kept = starts[-2] if keys[-1][:PREFIX] != leaving else len(keys)
            keys, ids, sig = keys[kept:], ids[kept:], sig[kept:]
            yield as_frame(regions)
        regions.leave(keys, ids, sig)  # the last region's tail may be elsewhere
        yield as_frame(regions)

    return run


def dealt(likely: float = LIKELY):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """A whole region of up to BLOCK rows, or the rows of a larger one that meet in one of its orders."""
        region, order, group = bytes(key[0]), int(key[1]), int(key[2])
        pdf = pdf.sort_values("a").drop_duplicates("a")
        ids, sig = pdf["a"].to_numpy(np.int64), signature_rows(pdf["sig"])
        regions = Regions(f"r{region.hex()}-{order}-{group}", likely)
        if order < 0:
            regions.region(ids, sig)
        else:
            regions.large(ids, sig, region[0], order, int(pdf["level"].iloc[0]))
        return as_frame(regions)

    return run


def unlinked(ids: np.ndarray, sig: np.ndarray, comp: np.ndarray, likely: float) -> Iterator[tuple[int, np.ndarray]]:
    """Places of rows outside the main component, each with the likely places of other components."""
    main, at = np.bincount(comp).argmax(), np.arange(len(ids))
    for i in np.flatnonzero(comp != main):
        other = np.flatnonzero((comp != comp[i]) & ((comp == main) | (at > i)))
        other = other[agreement(sig[i], sig[other]) >= likely]
        if len(other):
            yield i, other


def block_arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pdf["a"].to_numpy(np.int64), signature_rows(pdf["sig"]), np.unique(pdf["c"].to_numpy(np.int64), return_inverse=True)[1]


def unsettled(likely: float = LIKELY):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Round two, first half: the rows of a block that still have a likely partner in another component."""
        pdf = pdf.sort_values("a").drop_duplicates("a")
        ids, sig, comp = block_arrays(pdf)
        keep = np.zeros(len(ids), bool)
        for i, other in unlinked(ids, sig, comp, likely):
            keep[i] = True
            keep[other] = True
        return pdf.loc[keep, ["block", "a", "c", "n", "sig"]]

    return run


def similar(x: np.ndarray, ys: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sorted sets have 100 * intersection >= percent * union with ``x``; an empty set has none."""
    sizes = np.array([len(y) for y in ys], np.int64)
    fit = np.flatnonzero((100 * np.minimum(sizes, len(x)) >= percent * np.maximum(sizes, len(x))) & (sizes > 0)) if len(x) else np.empty(0, np.int64)
    out = np.zeros(len(ys), bool)
    if len(fit):
        joined = np.concatenate([ys[j] for j in fit])
        found = x[np.minimum(np.searchsorted(x, joined), len(x) - 1)] == joined
        both = np.add.reduceat(found, np.r_[0, np.cumsum(sizes[fit])[:-1]], dtype=np.int64)
        out[fit] = 100 * both >= percent * (len(x) + sizes[fit] - both)
    return out


def settled_by(width: int, percent: int, likely: float = LIKELY):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Round two, second half: those rows' full sets are compared inside their block, or two chunks of it; only links leave it."""
        pdf = pdf.sort_values("a").drop_duplicates("a").reset_index(drop=True)
        ids, sig, comp = block_arrays(pdf)
        shingle, out = Shingler(width), []
        sets = [shingle(t) for t in pdf["text"]]
        for i, other in unlinked(ids, sig, comp, likely):
            for j in other[similar(sets[i], [sets[j] for j in other], percent)]:
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pd.DataFrame(sorted(set(out)), columns=["a", "b"]).astype("int64")

    return run


def counted(rows: DataFrame, keys: list[str], broadcast_rows: int = 1_000_000) -> DataFrame:
    """``rows`` plus ``n``, the rows of their key; keys of a single row go."""
    n = written(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "op1-counts")
    few = n.limit(broadcast_rows + 1).count() <= broadcast_rows
    return rows.join(F.broadcast(n) if few else n, keys)


def groups_of(opened: DataFrame) -> DataFrame:
    """(region, order, group, level, a, sig) of rows that left their partition: groups of up to about LOCAL rows.

    Regions up to BLOCK rows are one group of order -1. Each level of larger ones needs the rows that are still too many, no others."""
    rows = written(counted(opened, ["region"]), "op1-open")
    out = [rows.where(F.col("n") <= BLOCK).select("region", F.lit(-1).alias("order"), F.lit(0).cast("long").alias("group"), F.lit(0).alias("level"), "a", "sig")]
    big = rows.where(F.col("n") > BLOCK).withColumn("order", F.explode(F.sequence(F.lit(0), F.lit(ORDERS)))).withColumn("group", F.lit(0).cast("long"))
    # a table of 10 trees x 9 orders x 36 minima
    columns = F.array(*[F.lit(int(c)) for tree in COLUMN_ORDERS for order in tree for c in order])
    tree = F.conv(F.hex(F.expr("substring(region, 1, 1)")), 16, 10).cast("int")
    level = 0
    while True:
        done = big.where(F.col("n") <= LOCAL)
        out.append(done.select("region", "order", "group", F.lit(level).alias("level"), "a", "sig"))
        big = big.where(F.col("n") > LOCAL)
        if level == LEVELS or not big.limit(1).count():
            break
        place = F.element_at(columns, (tree * (ORDERS + 1) + F.col("order")) * LEVELS + level + 1)
        # a group's number is the hash of its minima so far
        big = big.drop("n").withColumn("group", F.xxhash64("group", F.substring("sig", place + 1, F.lit(1))))
        big = written(counted(big, ["region", "order", "group"]), "op1-level")
        level += 1
    # equal in all minima of an order: pieces, each with the group's first row
    first = big.groupBy("region", "order", "group").agg(F.min_by(F.struct("a", "sig"), "a").alias("first"), F.first("n").alias("n"))
    pieces = F.ceil(F.col("n") / LOCAL)
    more = first.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))).select("region", "order", "group", "piece", "first.*")
    rest = big.select("region", "order", "group", F.pmod(F.xxhash64("a"), pieces).alias("piece"), "a", "sig").unionByName(more)
    out.append(rest.select("region", "order", F.xxhash64("group", "piece").alias("group"), F.lit(LEVELS).alias("level"), "a", "sig"))
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found


def forest(vertices: DataFrame, likely: float = LIKELY) -> DataFrame:
    """Sorted signature orders of (v, sig, bytes): rows of candidate pairs and blocks, written to the shared folder."""
    spark = vertices.sparkSession
    trees = vertices.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).select(
        "v",
        F.concat(
            F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.expr(f"substring(sig, 1 + tree * {2 * DEPTH}, {2 * DEPTH})")
        ).alias("key"),
        "bytes",
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ordered = trees.repartitionByRange(parts, "key", "v").sortWithinPartitions("key", "v")
    found = written(ordered.mapInPandas(sorted_regions(likely), COLUMNS), "op1-forest")
    opened = found.where("kind = 'open'").select(F.expr(f"substring(key, 1, {PREFIX})").alias("region"), "a", "sig")
    more = written(groups_of(opened).groupBy("region", "order", "group").applyInPandas(dealt(likely), COLUMNS), "op1-dealt")
    return found.where("kind IN ('pair', 'block')").unionByName(more)


def texts_of(docs: DataFrame, ids: DataFrame, broadcast_ids: int = 1_000_000) -> DataFrame:
    """Rows of ``docs`` with one of the ``ids``, written; the ids are broadcast only if they are few."""
    wanted = written(ids.distinct(), "op1-wanted")
    few = wanted.limit(broadcast_ids + 1).count() <= broadcast_ids
    return written(docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi"), "op1-texts")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union on full sets, written to the shared folder.

    The end of a pair that has more partners is its hub. A hub's text goes once to each of its pieces of about HUB partners, ahead of their
    texts in the partition's order, so a pair carries one text and a task holds one hub's set."""
    pairs = written(pairs.select("a", "b").distinct(), "op1-pairs")
    texts = texts_of(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")))
    ends = written(pairs.select(F.col("a").alias("v")).union(pairs.select("b")).groupBy("v").agg(F.count("*").alias("n")), "op1-degrees")
    both = pairs.join(ends.select(F.col("v").alias("a"), F.col("n").alias("na")), "a").join(ends.select(F.col("v").alias("b"), F.col("n").alias("nb")), "b")
    swap = F.col("nb") > F.col("na")
    both = both.select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("hub"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("v"), F.ceil(F.greatest("na", "nb") / HUB).alias("pieces")
    )
    both = written(both.withColumn("piece", F.pmod(F.xxhash64("v"), F.col("pieces"))).drop("pieces"), "op1-hubs")
    named = texts.withColumnRenamed("doc_id", "v")
    partners = both.join(named, "v").select("hub", "piece", F.lit(1).alias("kind"), "v", "text")
    hubs = both.select(F.col("hub").alias("v"), "piece").distinct().join(named, "v").select(F.col("v").alias("hub"), "piece", F.lit(0).alias("kind"), "v", "text")
    rows = hubs.unionByName(partners).repartition("hub", "piece").sortWithinPartitions("hub", "piece", "kind", "v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, at, sets = Shingler(width), None, []
        for pdf in batches:
            links = []
            for hub, piece, kind, v, text in zip(pdf["hub"], pdf["piece"], pdf["kind"], pdf["v"], pdf["text"], strict=True):
                if (hub, piece) != at:
                    at, sets = (hub, piece), []
                own = shingle(text)
                if kind == 0:
                    sets.append(own)  # one for each row of the hub's doc_id
                elif similar(own, sets, percent).any():
                    links.append((min(hub, v), max(hub, v)))
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")
        del shingle, sets
        trim()

    return written(rows.mapInPandas(run, "a long, b long").distinct(), "op1-links")


def in_chunks(rows: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """``rows`` (block, a, n ...) plus ``i`` and ``j``: a block whose sets exceed ``most`` bytes is dealt to pairs of chunks, so that any two
    rows meet and no task holds more than two chunks."""
    size = rows.groupBy("block").agg(F.ceil(F.sum(F.col("n") * 16) / most).cast("int").alias("chunks"))
    large = written(size.where("chunks > 1"), "op1-large")
    few = large.limit(1_000_001).count() <= 1_000_000
    rows = rows.join(F.broadcast(large) if few else large, "block", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.withColumn("i", F.least("own", "with")).withColumn("j", F.greatest("own", "with")).drop("chunks", "own", "with")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, likely: float = LIKELY) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept. ``likely=0`` confirms every candidate."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sigs = written(signatures(docs, width), "op1-signatures")
    usable = sigs.where("doc_id IS NOT NULL AND n_shingles > 0")
    sets = usable.groupBy("digest").agg(F.min("doc_id").alias("v"), F.max("sig").alias("sig"), F.max("n_shingles").alias("n"), F.count("*").alias("copies"))
    sets = written(sets, "op1-sets")
    # one byte of each 16-bit minimum
    one_byte = F.unhex(F.regexp_replace(F.hex("sig"), "..(..)", "$1"))
    rows = forest(sets.select("v", "sig", one_byte.alias("bytes")), likely)
    links = confirmed(rows.where("kind = 'pair'"), docs, width, percent)
    first = components(links)
    blocks = rows.where("kind = 'block'").select("block", "a", "sig")
    known = sets.select(F.col("v").alias("a"), "n").join(first.select(F.col("v").alias("a"), "c"), "a", "left").groupBy("a").agg(F.max("n").alias("n"), F.min("c").alias("c"))
    blocks = blocks.join(known, "a").withColumn("c", F.coalesce("c", "a"))
    open_rows = written(blocks.groupBy("block").applyInPandas(unsettled(likely), "block string, a long, c long, n long, sig binary"), "op1-unsettled")
    if open_rows.limit(1).count():
        texts = texts_of(docs, open_rows.select(F.col("a").alias("doc_id"))).withColumnRenamed("doc_id", "a")
        more = in_chunks(open_rows).join(texts, "a").groupBy("block", "i", "j").applyInPandas(settled_by(width, percent, likely), "a long, b long")
        first = components(links.unionByName(written(more.distinct(), "op1-links")))
    named = sets.join(first, "v", "left").where("copies > 1 OR c IS NOT NULL").select("digest", F.coalesce("c", "v").alias("component_id"))
    out = sigs.drop("sig").join(named, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), width=4)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group (the smallest doc_id), five words and a similarity of 0.8."""
    gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
