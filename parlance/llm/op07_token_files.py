"""Token-id files: a shared zstandard dictionary, one frame for each document, and an offset index.

Layout of a folder: ``dictionary-<hash>.zdict`` (trained on the little-endian unsigned 32-bit ids of a bounded sample of
documents, ``DICTIONARY_DOCS`` of up to ``DICTIONARY_CHARS`` characters each), ``part-<number>.zids`` for each range of doc_id, and ``manifest.json``.
A part holds ``PZID0001``, the dictionary's SHA-256 (32 bytes), one zstandard frame for each document in ascending
doc_id order, then the index (doc_id, offset, frame length, number of ids: four little-endian int64 each), its
row count (int64) and ``PZIDEND1``. A reader fetches the index and any one frame; it needs no other document.

Parts are written by tasks to a name of their own and moved when complete, so a repeated or doubled attempt ends in the
same file. The driver sees one row per part. Paths are those of pyarrow's file systems (local, HDFS, S3).

Defined results: a null or empty text is its end id alone; rows of the same doc_id follow one another; a null doc_id is
kept as the smallest long and read back as null; an empty table gives no part; further columns do not matter.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_in, id_out, load, scratch_path
from .tokens import encoder

NAME = "op7_token_files"
END_ID, DICTIONARY_DOCS, DICTIONARY_CHARS, DICTIONARY_BYTES, LEVEL, DOCS_PER_PART = 2, 1000, 20_000, 32 * 1024, 3, 100_000
HEAD, TAIL = b"PZID0001", b"PZIDEND1"
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def file_system(uri: str):
    """(pyarrow file system, path) of a path with or without a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def train_dictionary(docs: DataFrame, end_id: int, tokenizer: str | None, n: int) -> bytes:
    """Dictionary from whole texts of up to ``DICTIONARY_CHARS`` characters, ``DICTIONARY_DOCS`` documents at most: those with the smallest
    hashes of their id, so that each run picks the same ones; empty if there are too few."""
    import zstandard

    share = min(1.0, 4.0 * DICTIONARY_DOCS / max(n, 1))
    order = F.xxhash64("doc_id", F.lit("dictionary"))
    chosen = docs.where(F.pmod(order, F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).where(F.length("text") <= DICTIONARY_CHARS)
    texts = [r["text"] for r in chosen.orderBy(order, "text").limit(DICTIONARY_DOCS).select("text").collect()]
    end = int(end_id).to_bytes(4, "little")
    samples = [x + end for x in encoder(tokenizer).encode(texts)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        return b""


def write_token_files(docs: DataFrame, path: str, end_id: int = END_ID, tokenizer: str | None = None) -> dict:
    """Write ``docs`` (doc_id, text) below ``path``; returns the manifest."""
    spark = docs.sparkSession
    docs = docs.select(id_in("doc_id"), "text")
    n = docs.count()
    dictionary = train_dictionary(docs, end_id, tokenizer, n)
    digest = hashlib.sha256(dictionary).hexdigest()
    where, folder = file_system(path)
    where.create_dir(folder, recursive=True)
    with where.open_output_stream(f"{folder}/dictionary-{digest}.zdict") as out:
        out.write(dictionary)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import zstandard

        task = TaskContext.get()
        fs, base = file_system(path)
        with fs.open_input_stream(f"{base}/dictionary-{digest}.zdict") as f:
            raw = f.read()
        shared = zstandard.ZstdCompressionDict(raw) if raw else None
        if shared:
            shared.precompute_compress(level=LEVEL)  # else each document digests the dictionary again
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        end, encode = int(end_id).to_bytes(4, "little"), encoder(tokenizer).encode
        name = f"part-{task.partitionId():08d}.zids"
        temporary = f"{base}/_{name}.{task.taskAttemptId()}"
        index, at, total = [], len(HEAD) + 32, 0
        with fs.open_output_stream(temporary) as out:
            out.write(HEAD + bytes.fromhex(digest))
            for pdf in batches:
                for doc_id, ids in zip(pdf["doc_id"].tolist(), encode(pdf["text"]), strict=True):
                    ids += end
                    frame = packer.compress(ids)
                    out.write(frame)
                    index.append((doc_id, at, len(frame), len(ids) // 4))
                    at, total = at + len(frame), total + len(ids) // 4
            out.write(np.array(index, "<i8").reshape(-1, 4).tobytes() + len(index).to_bytes(8, "little") + TAIL)
        final = f"{base}/{name}"
        if type(fs).__name__ != "LocalFileSystem" and fs.get_file_info(final).type.name != "NotFound":
            fs.delete_file(final)
        fs.move(temporary, final)
        yield pd.DataFrame({"part": [task.partitionId()], "file": [name], "docs": [len(index)], "tokens": [total]})

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-n // DOCS_PER_PART)) if n else 1
    ordered = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    made = ordered.mapInPandas(write, "part long, file string, docs long, tokens long").collect()  # a row for each part
    start, listed = 0, []
    for r in sorted(made, key=lambda r: r["part"]):
        listed.append({"file": r["file"], "docs": r["docs"], "tokens": r["tokens"], "start": start})
        start += r["tokens"]
    manifest = {"dictionary": digest, "end_id": end_id, "tokens": start, "parts": listed}
    with where.open_output_stream(f"{folder}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"], dtype="int64")


class TokenFile:
    """One part, opened for reading: its index, and any document's ids without the others."""

    def __init__(self, path: str, name: str, dictionary: bytes | None = None):
        import numpy as np
        import zstandard

        self.fs, base = file_system(path)
        self.file = self.fs.open_input_file(f"{base}/{name}")
        size = self.file.size()
        self.file.seek(0)
        head = self.file.read(len(HEAD) + 32)
        digest = head[len(HEAD) :].hex()
        if dictionary is None:
            with self.fs.open_input_stream(f"{base}/dictionary-{digest}.zdict") as f:
                dictionary = f.read()
        self.file.seek(size - 16)
        tail = self.file.read(16)
        if head[: len(HEAD)] != HEAD or tail[8:] != TAIL or hashlib.sha256(dictionary).hexdigest() != digest:
            raise ValueError(f"{name}: not a complete token file of this dictionary")
        n = int.from_bytes(tail[:8], "little")
        self.file.seek(size - 16 - 32 * n)
        self.index = np.frombuffer(self.file.read(32 * n), "<i8").reshape(-1, 4)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, k: int) -> bytes:
        """Ids of the k-th document of this part as bytes."""
        _, offset, length, n = self.index[k].tolist()
        self.file.seek(offset)
        return self.unpacker.decompress(self.file.read(length), max_output_size=4 * n)

    def all_ids(self, step: int = 1 << 22) -> Iterator[bytes]:
        """Ids of every document in order; the file is read once, some MB at a time."""
        import numpy as np

        k = 0
        while k < len(self.index):
            first = int(self.index[k, 1])
            last = max(k + 1, int(np.searchsorted(self.index[:, 1], first + step)))
            self.file.seek(first)
            raw = memoryview(self.file.read(int(self.index[last - 1, 1] + self.index[last - 1, 2]) - first))
            for _, offset, length, n in self.index[k:last].tolist():
                yield self.unpacker.decompress(raw[offset - first : offset - first + length], max_output_size=4 * n)
            k = last

    def close(self) -> None:
        self.file.close()


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, from the files alone."""
    where, folder = file_system(path)
    with where.open_input_stream(f"{folder}/manifest.json") as f:
        parts = json.loads(f.read())["parts"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, start in zip(pdf["file"], pdf["start"], strict=True):
                part, rows, at = TokenFile(path, name), [], int(start)
                for (doc_id, *_), ids in zip(part.index.tolist(), part.all_ids(), strict=True):
                    rows.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
                    at += len(ids) // 4
                    if len(rows) == 10_000:
                        yield frame(rows)
                        rows = []
                yield frame(rows)
                part.close()

    if not parts:
        return spark.createDataFrame([], SCHEMA)
    listed = spark.createDataFrame([(p["file"], p["start"]) for p in parts], "file string, start long")
    return id_out(listed.repartition(len(parts)).mapInPandas(read, SCHEMA), "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "op7")
    write_token_files(load(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return read_token_files(spark, path)
