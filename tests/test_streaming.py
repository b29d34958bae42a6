"""A stream of rows gives the paragraphs that a batch gives."""

from parlance.operators.sequences import paragraphs
from parlance.streaming.paragraphs import live_paragraphs

U = "conv_id long, seq long, speaker string, content string, start_ms long, end_ms long"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(c, i, "AB"[(i // 2) % 2], f"w{i}", i * 1000 + (5000 if i > 3 else 0), i * 1000 + 900 + (5000 if i > 3 else 0)) for c in (1, 2) for i in range(7)]
    batch = spark.createDataFrame(rows, U)
    for k, cut in enumerate(("seq < 3", "seq >= 3")):
        batch.where(cut).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
    want = [(r["conv_id"], r["first_seq"], r["content"]) for r in paragraphs(batch, least_ms=1_000_000).collect()]
    source = tmp_path / "source"
    source.mkdir()
    stream = spark.readStream.schema(U).parquet(str(source))
    q = live_paragraphs(stream, idle_ms=None).writeStream.format("memory").queryName("live").outputMode("append").start()
    try:
        for k in range(2):
            for f in sorted((tmp_path / f"in{k}").glob("*.parquet")):
                f.rename(source / f"{k}-{f.name}")
            q.processAllAvailable()
        got = [(r["conv_id"], r["first_seq"], r["content"]) for r in spark.table("live").collect()]
    finally:
        q.stop()
    last = {c: max(w for w in want if w[0] == c) for c in (1, 2)}  # still open in the stream
    assert sorted(got) == sorted(w for w in want if w not in last.values())
