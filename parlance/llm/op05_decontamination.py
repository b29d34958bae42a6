"""Benchmark decontamination: size-partitioned MinHash containment search, native.

Words are lower-cased runs of letters and digits; an item's set is its distinct 5-word shingles, or, with fewer words, all of its words
as one shingle of its own width. A document is read in shingles of each width that items have. Document ``d`` leaks item ``i`` if at
least 80 % of the item's shingles occur in ``d``.

*Search.* Items are partitioned by size (powers of two of their shingle count) and width. An item's sketch is its ``k`` smallest
shingle hashes (a bottom-k MinHash) with ``k = n - ceil(0.8 n) + 1`` for its own ``n``: of any ``k`` shingles at least one occurs
in each document that has 80 % of them, so the search loses nothing. A partition's threshold is the largest hash in its sketches. A document
is looked up only in partitions whose smallest item it is large enough to contain, and of its shingle hashes only those within the
threshold of such a partition (a scaled MinHash that grows with the document, so that a short item is found inside a document of any
length); hash and width are the join key.
*Verification.* Candidate pairs are confirmed on full sets: the distinct item shingles, as texts, that the document contains, counted
against 80 % of the item's. The texts of candidates alone are read again and meet their pairs in a shuffle.

Sketches and items are broadcast only up to ``broadcast_rows`` shingles, the ids of candidates up to ``broadcast_ids``; beyond that the
joins are shuffled, those with items salted by document, so one passage in a third of all documents is spread.

Defined results: null or wordless texts, on either side, leak nothing; an item that occurs twice is reported under each of its ids;
repeated document rows give one pair, rows of one doc_id with different texts the pair that contains most; a null doc_id or item_id gives
no pair (the stage goes by text, so it also drops leaking documents without an id); empty tables give an empty result; further columns
don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, written

NAME = "op5_decontamination"
WIDTH, PERCENT = 5, 80


def bound(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``value`` evaluated once, under a name. An array that is bound like this stays an array of objects; one that
    is read from a row would be unpacked as a whole for each shingle."""
    return f"transform(array({value}), {name} -> {body})[0]"


def word_array(text: str = "text") -> str:
    return f"filter(split(lower(`{text}`), '[^\\\\p{{L}}\\\\p{{N}}]+'), x -> x <> '')"


def grams(width: str, hashed: bool = False) -> str:
    """SQL for the array of the shingles of ``w`` in order, as texts or as 64-bit hashes; empty where ``w`` is shorter."""
    each = f"slice(w, i, {width})"
    each = f"xxhash64({each})" if hashed else f"array_join({each}, ' ')"
    kind = "bigint" if hashed else "string"
    return f"CASE WHEN size(w) >= {width} THEN transform(sequence(1, size(w) - {width} + 1), i -> {each}) ELSE cast(array() AS array<{kind}>) END"


def item_sets(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, width, n, size_class, hashes, item): distinct shingles of each item with words."""
    sets = bound("w", word_array(), f"struct(least({width}, size(w)) AS width, array_distinct({grams(f'least({width}, size(w))')}) AS item, array_sort(array_distinct({grams(f'least({width}, size(w))', True)})) AS hashes)")
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["item_id"]).select("item_id", F.expr(sets).alias("s")).select("item_id", "s.*")
    n = F.size("item").cast("long")
    return rows.where("width > 0").select("item_id", "width", n.alias("n"), F.floor(F.log2(n.cast("double"))).cast("int").alias("size_class"), "hashes", "item")


def sketches(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(item_id, n, width, size_class, h): the bottom-k hashes of each item; k leaves no miss."""
    size = F.size("hashes")
    k = size - F.expr(f"cast(ceil({percent} * size(hashes) / 100) AS int)") + 1
    return items.select("item_id", "n", "width", "size_class", F.explode(F.slice("hashes", F.lit(1), k)).alias("h"))


def candidates(docs: DataFrame, items: DataFrame, key: str, percent: int = PERCENT, broadcast_rows: int = 200_000, salts: int = 32) -> DataFrame:
    """Distinct (key, item_id) whose sketches meet; ``docs`` has key and text, ``items`` comes from :func:`item_sets`."""
    sketch = sketches(items, percent)
    # a row for each power of two and width: 64 x 5 at most
    parts = sketch.groupBy("width", "size_class").agg(F.max("h").alias("top"), F.min("n").alias("least"), F.count("*").alias("rows")).orderBy("width", "size_class").collect()
    if not parts:
        return docs.select(key, F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id")).limit(0)
    each = []
    for width in sorted({p["width"] for p in parts}):
        own = [p for p in parts if p["width"] == width]
        # the largest threshold of the partitions whose items the document can contain: a hash is sent once for all of them
        top = "greatest(" + ", ".join(f"IF(100 * size(w) >= {percent} * {p['least']}, {p['top']}L, NULL)" for p in own) + f", {-(2**63) + 1}L)"
        each.append(bound("t", top, f"transform(array_distinct(filter({grams(str(width), True)}, h -> h <= t)), h -> struct({width} AS width, h AS h))"))
    found = bound("w", word_array(), each[0] if len(each) == 1 else f"concat({', '.join(each)})")
    rows = docs.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(key, F.explode(F.expr(found)).alias("g")).select(key, "g.width", "g.h")
    sketch = sketch.select("item_id", "width", "h")
    if sum(p["rows"] for p in parts) <= broadcast_rows:
        met = rows.join(F.broadcast(sketch), ["width", "h"])
    else:
        sketch = sketch.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")).join(sketch, ["width", "h", "salt"])
    return met.select(key, "item_id").distinct()


def leaks(
    docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, broadcast_rows: int = 200_000, width: int = WIDTH, key: str = "doc_id", broadcast_ids: int = 1_000_000, salts: int = 32,
    same_text: bool = False,
) -> DataFrame:
    """Pairs (key, item_id, n_item, n_found, containment) with containment of at least ``percent``.

    ``same_text`` says that rows of one key have one text, so that a candidate's text is confirmed once."""
    docs, items = docs.select(key, "text"), written(item_sets(benchmark.select("item_id", "text"), width), "op5-items")
    # written, so that its size is known before the documents are read again
    pairs = written(candidates(docs, items, key, percent, broadcast_rows, salts), "op5-pairs")
    ids = written(pairs.select(key).distinct(), "op5-ids")
    few = ids.limit(broadcast_ids + 1).count() <= broadcast_ids
    texts = docs.join(F.broadcast(ids) if few else ids.hint("merge"), key, "left_semi")
    texts = written(texts.dropDuplicates([key]) if same_text else texts, "op5-texts")
    found = pairs.join(texts.hint("merge"), key)
    wanted = items.select("item_id", "width", "n", "item")
    if (items.agg(F.sum("n").alias("n")).first()["n"] or 0) <= broadcast_rows:
        found = found.join(F.broadcast(wanted), "item_id")
    else:
        wanted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        found = found.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")).join(wanted, ["item_id", "salt"])
    held = F.expr(bound("w", word_array(), f"size(array_intersect(item, {grams('width')}))")).cast("long")
    return (
        found.select(key, "item_id", F.col("n").alias("n_item"), held.alias("n_found"))
        .where(100 * F.col("n_found") >= percent * F.col("n_item"))
        .groupBy(key, "item_id")
        .agg(F.first("n_item").alias("n_item"), F.max("n_found").alias("n_found"))
        .withColumn("containment", F.col("n_found") / F.col("n_item"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that leak no benchmark item. Goes by the text's digest, so a text is confirmed once, however often it occurs,
    and a document without an id is judged too."""
    digest = F.md5(F.encode("text", "UTF-8")).alias("__digest")
    found = leaks(docs.select(digest, "text"), load(spark, sf_dir, "benchmark"), key="__digest", same_text=True).select("__digest").distinct()
    return docs.withColumn("__digest", digest).join(found, "__digest", "left_anti").select(*docs.columns)


def leaks_sql(docs: str, benchmark: str = "benchmark") -> str:
    def words(table: str, key: str) -> str:
        return rf"SELECT {key}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM {table} WHERE {key} IS NOT NULL"

    def shingles(rows: str, key: str) -> str:
        return f"""SELECT DISTINCT {key}, width, array_to_string(w[i : i + width - 1], ' ') AS s
      FROM (SELECT {key}, width, w, unnest(range(1, len(w) - width + 2)) AS i FROM ({rows}) WHERE len(w) >= width)"""

    items = f"SELECT item_id, w, least({WIDTH}, len(w)) AS width FROM ({words(benchmark, 'item_id')}) WHERE len(w) > 0"
    rows = f"SELECT doc_id, w, width FROM ({words(docs, 'doc_id')}), (SELECT DISTINCT width FROM ({items}))"
    return f"""
SELECT doc_id, item_id, n_item, n_found, n_found / n_item AS containment FROM (
  SELECT doc_id, item_id, any_value(n_item) AS n_item, count(*) AS n_found
  FROM ({shingles(rows, "doc_id")}) JOIN (
    SELECT item_id, width, s, count(*) OVER (PARTITION BY item_id) AS n_item FROM ({shingles(items, "item_id")})) USING (width, s)
  GROUP BY doc_id, item_id)
WHERE 100 * n_found >= {PERCENT} * n_item"""


ORACLE = leaks_sql("documents")
