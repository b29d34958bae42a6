"""Cases by hand: ties, thresholds, nulls, empty inputs, and set-based forms against plain loops on random rows."""

import io
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import dsp, timefmt
from parlance.functions import text as tx
from parlance.operators import aggregates as ag
from parlance.operators import dedup, evaluation, intervals, redact, segments, sequences, splits
from parlance.plans import options, providers, render, run
from parlance.sources import audio, dumps, prompts

U = "conv_id long, seq long, speaker string, content string, start_ms long, end_ms long"
T = "k long, turn_id long, start_ms long, end_ms long, label string"
S = "k long, seg_id long, start_ms long, end_ms long"


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_largest_overlap_wins_and_ties_go_to_the_first_turn(spark):
    segs = spark.createDataFrame([(1, 1, 0, 1000), (1, 2, 5000, 6000), (1, 3, 2000, 3000)], S)
    turns = spark.createDataFrame([(1, 0, 0, 400, "A"), (1, 1, 400, 1000, "B"), (1, 2, 2000, 2500, "B"), (1, 3, 2500, 3000, "A")], T)
    out = {r["seg_id"]: r["owner"] for r in intervals.max_overlap_owner(segs, turns, "k", "seg_id", "turn_id", "label", 300).collect()}
    assert out == {1: "B", 2: None, 3: "B"}


def test_hint_wins(spark):
    segs = spark.createDataFrame([(1, 1, 0, 1000)], S).withColumn("hint", F.lit("Z"))
    turns = spark.createDataFrame([(1, 0, 0, 400, "A")], T)
    assert intervals.max_overlap_owner(segs, turns, "k", "seg_id", "turn_id", "label", hint="hint").first()["owner"] == "Z"


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_overlap_join_finds_each_pair_once(spark, bucket):
    r = random.Random(bucket)
    a = [(k, i, s, s + r.randint(0, 40)) for k in (1, 2) for i, s in enumerate(r.choices(range(100), k=25))]
    b = [(k, i, s, s + r.randint(0, 40), "x") for k in (1, 2) for i, s in enumerate(r.choices(range(100), k=25))]
    got = intervals.overlap_join(spark.createDataFrame(a, S), spark.createDataFrame(b, T), "k", bucket).select("k", "seg_id", "r_turn_id").collect()
    want = [(x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and min(x[3], y[3]) > max(x[2], y[2])]
    assert sorted(map(tuple, got)) == sorted(want)


def loop_silence(rows, least):
    """A plain reading of the rule, one row after another."""
    out, prev, i = [], None, 0
    while i < len(rows):
        _, _, who, what, a, b = rows[i]
        if who is not None:
            if prev is not None and a - prev >= least:
                out.append((prev, a, "pause"))
            prev, i = b, i + 1
        elif not what.startswith("[muted"):
            i += 1
        else:
            start, end, j = a, b, i + 1
            while j < len(rows) and rows[j][2] is None:
                if rows[j][3].startswith("[muted"):
                    end = rows[j][5]
                j += 1
            if j < len(rows) and rows[j][4] - end >= least:
                end = rows[j][4]
            start = prev if prev is not None and prev < start else start
            if end - start >= least:
                out.append((start, end, "muted"))
            prev, i = end, j
    return out


def test_silence_matches_the_loop(spark):
    r = random.Random(3)
    rows, want = [], []
    for c in range(60):
        at, own = 0, []
        for k in range(r.randint(0, 9)):
            at += r.randint(0, 15)
            kind = r.choice(["s", "s", "m", "n"])
            own.append((c, k, "A" if kind == "s" else None, "[muted, 1s]" if kind == "m" else "[noise]", at, at + r.randint(1, 6)))
            at = own[-1][5]
        rows += own
        want += [(c, *e) for e in loop_silence(own, 8)]
    got = sequences.silence_events(spark.createDataFrame(rows, U), least_ms=8).collect()
    assert sorted((x["conv_id"], x["start_ms"], x["end_ms"], x["kind"]) for x in got) == sorted(want)


def test_silence_thresholds(spark):
    at = lambda gap: spark.createDataFrame([(1, 0, "A", "x", 0, 2000), (1, 1, "B", "y", 2000 + gap, 2000 + gap + 500)], U)
    assert sequences.silence_events(at(10_000)).count() == 1
    assert sequences.silence_events(at(9_900)).count() == 0


def test_paragraphs_skip_noise_and_break_at_gaps(spark):
    rows = [(1, 0, "A", "a", 0, 1000), (1, 1, None, "[noise]", 1000, 1200), (1, 2, "A", " b ", 1500, 2000), (1, 3, "A", "c", 4000, 4500), (1, 4, "B", "d", 4500, 5000)]
    got = [(r["speaker"], r["content"]) for r in sequences.paragraphs(spark.createDataFrame(rows, U)).orderBy("first_seq").collect()]
    assert got == [("A", "a b"), ("A", "c"), ("B", "d")]


def test_sections_reconcile_to_the_limit(spark):
    rows = [(1, f"t{i}", i * 10, i * 10 + 12) for i in range(12)]
    bounds = spark.createDataFrame([(1, 0, 130)], "conv_id long, total_start_ms long, total_end_ms long")
    out = sequences.reconcile(spark.createDataFrame(rows, "conv_id long, title string, start_ms long, end_ms long"), bounds).orderBy("start_ms").collect()
    assert len(out) == 7 and out[0]["start_ms"] == 0 and out[-1]["end_ms"] == 130
    assert all(a["end_ms"] == b["start_ms"] for a, b in zip(out, out[1:], strict=False))


def test_same_title_merges_in_any_case(spark):
    s = spark.createDataFrame([(1, "Plan", 0, 5), (1, " plan ", 5, 9), (1, "x", 9, 12)], "conv_id long, title string, start_ms long, end_ms long")
    assert [(r["title"], r["end_ms"]) for r in sequences.merge_same_title(s).orderBy("start_ms").collect()] == [("Plan", 9), ("x", 12)]


def test_speaker_chunks_extend_within_a_monologue(spark):
    u = spark.createDataFrame([(1, i, "A" if i < 5 else "B", "x", i, i + 1) for i in range(8)], U)
    got = [(r["first_seq"], r["last_seq"]) for r in sequences.speaker_chunks(u, size=4, overlap=1, extend=3).orderBy("chunk").collect()]
    assert got == [(0, 4), (4, 7)]
    with pytest.raises(ValueError):
        sequences.speaker_chunks(u, size=2, overlap=2)


def test_cutoffs_of_a_long_recording(spark):
    total = spark.createDataFrame([(1, 2_910_000)], "conv_id long, total_ms long")
    got = [r["cutoff_ms"] // 1000 for r in sequences.cutoffs(total, "conv_id").orderBy("boundary").collect()]
    assert got == [480, 955, 1430, 1905, 2380, 2855]


def row(a, b, text):
    return {"start_ms": a, "end_ms": b, "tokens": text.split()}


def test_chunk_join_cases():
    tail = [row(0, 5000, "we will meet on monday morning")]
    assert len(dedup.join_chunks(tail, [row(4000, 5000, "we will meet on monday morning")])) == 1
    assert len(dedup.join_chunks(tail, [row(5000, 6000, "and then something else happened")])) == 2
    assert len(dedup.join_chunks(tail, [row(4000, 5000, "on monday")])) == 2  # too short to judge
    longer = row(0, 9000, "we will meet on monday and talk about the plans for the rest of the summer")
    assert dedup.join_chunks(tail, [longer]) == [longer]  # replaces what it overlaps
    later = row(6000, 9000, "we will meet on monday and talk about the plans for the rest of the summer")
    assert len(dedup.join_chunks(tail, [later])) == 2  # no overlap in time
    old = [row(0, 1000, "one two three four"), row(50_000, 60_000, "five six seven")]
    assert len(dedup.join_chunks(old, [row(60_000, 61_000, "one two three four")])) == 3  # beyond the window
    assert dedup.join_chunks([], tail) == tail == dedup.join_chunks(tail, [])


def test_boundary_dedup_matches_the_loop(spark):
    r = random.Random(5)
    words = "a b c d e f g".split()
    tails, heads, want = [], [], []
    for c in range(80):
        mk = lambda base: [(c, i, (s := base + r.randint(0, 20) * 1000), s + r.randint(1, 9) * 1000, r.choices(words, k=r.randint(1, 5))) for i in range(r.randint(1, 5))]  # noqa: E731, B023
        t, h = mk(0), mk(10_000)
        tails += t
        heads += h
        as_rows = lambda side, rows: [{"id": (side, x[1]), "start_ms": x[2], "end_ms": x[3], "tokens": x[4]} for x in rows]
        kept = {x["id"] for x in dedup.join_chunks(as_rows("tail", t), as_rows("head", h))}
        want += [(c, side, x[1]) for side, rows in (("tail", t), ("head", h)) for x in rows if (side, x[1]) not in kept]
    schema = "conv_id long, seq long, start_ms long, end_ms long, tok array<string>"
    got = dedup.dedup_boundary(spark.createDataFrame(tails, schema), spark.createDataFrame(heads, schema)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


W = "conv_id long, seq long, i long, token string, start_ms long, end_ms long, probability double, owner string"


def test_word_split(spark):
    turns = spark.createDataFrame([(1, 0, 10_000, 11_500, "A"), (1, 1, 11_500, 15_000, "B")], "conv_id long, turn_id long, start_ms long, end_ms long, speaker string")
    text = ["hello", "there", "yeah", "sure", "okay"]
    words = [(1, 0, i, t, 10_000 + i * 800, 10_700 + i * 800, 0.9) for i, t in enumerate(text)]
    words = spark.createDataFrame(words, W.rsplit(",", 1)[0])
    owned = splits.word_owners(words, turns, "conv_id", ["conv_id", "seq", "i"], "turn_id", "speaker")
    got = [(r["content"], r["owner"]) for r in splits.split_by_words(owned, ["conv_id", "seq"]).orderBy("fragment").collect()]
    assert got == [("hello there", "A"), ("yeah sure okay", "B")]


def test_cut_snaps_to_the_least_probable_word(spark):
    rows = [(1, 0, i, f"w{i}", i * 500, i * 500 + 400, 0.4 if i == 2 else 0.9, "A" if i < 3 else "B") for i in range(6)]
    keys = {"conv_id": "long", "seq": "long"}
    got = splits.split_by_words_snapped(spark.createDataFrame(rows, W), keys).orderBy("fragment").collect()
    assert [(r["first_i"], r["owner"]) for r in got] == [(0, "A"), (2, "B")]
    same = splits.split_by_words_snapped(spark.createDataFrame(rows, W), keys, below=0.3).orderBy("fragment").collect()
    assert [r["first_i"] for r in same] == [0, 3]


def test_char_split_is_proportional(spark):
    segs = spark.createDataFrame([(1, 0, 0, 1000, "aaaaabbbbb")], S + ", content string")
    turns = spark.createDataFrame([(1, 0, 0, 500, "A"), (1, 1, 500, 1000, "B")], T)
    assert sorted(r["content"] for r in splits.split_by_chars(segs, turns, "k", "seg_id").collect()) == ["aaaaa", "bbbbb"]


def test_redaction(spark):
    u = spark.createDataFrame([(1, 0, "A", "a", 0, 1000), (1, 1, "B", "b", 1000, 3250), (1, 2, "A", "c", 5000, 6000)], U)
    s = spark.createDataFrame([(1, 0, "T", 0, 4000), (1, 1, "S", 4000, 8000)], "conv_id long, i long, title string, start_ms long, end_ms long")
    r = spark.createDataFrame([(1, 0, 0, 0, "x"), (1, 0, 0, 9, "y")], "conv_id long, section long, start_idx long, end_idx long, topic string")
    got = redact.redact(u, s, r).orderBy("seq").collect()
    assert [(x["content"], x["end_ms"]) for x in got] == [("[muted, 3.2s]", 3250), ("c", 6000)]
    got = redact.redact(u, s, r, "drop").orderBy("seq").collect()
    assert [(x["content"], x["start_ms"], x["end_ms"]) for x in got] == [("[muted, 0.0s]", 0, 4000), ("c", 5000, 6000)]
    with pytest.raises(ValueError):
        redact.redact(u, s, r, "other")


def test_text_functions(spark):
    v = lambda c: value(spark, c)
    assert v(tx.tokens(F.lit("Hi, Ґава і don't Ё"))) == ["hi", "ґава", "і", "don't"]
    assert v(tx.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0
    assert v(tx.edit_is_safe(F.lit("abcdef"), F.lit("abcdxx"))) and not v(tx.edit_is_safe(F.lit("ab"), F.lit("abcdef")))
    assert not v(tx.edit_is_safe(F.lit("abc"), F.lit(" "))) and not v(tx.edit_is_safe(F.lit(None).cast("string"), F.lit("x")))
    assert v(tx.strip_artifacts(F.lit(' "Text: hello" '))) == "hello"
    assert v(tx.normalize(F.lit(" A,  b. C! "))) == "a b c"
    assert v(tx.is_filler(F.lit("Yeah,"))) and v(tx.is_truncated(F.lit("ab-"))) and not v(tx.is_truncated(F.lit("to")))
    assert v(tx.is_name(F.lit(" Ілля "))) and not v(tx.is_name(F.lit("anna"))) and not v(tx.is_name(F.lit("A")))
    assert v(tx.label(F.lit(""), F.lit(None).cast("string"), "?")) == "?"
    assert v(tx.csv_list(F.lit(" a, ,b "))) == ["a", "b"] and v(tx.csv_list(F.lit(None).cast("string"))) is None
    assert v(tx.short_model_name(F.lit("org/model-1"))) == "model-1"
    assert v(tx.placeholders(F.lit("<<a>> <<b>> <<a>>"))) == ["a", "b"]


def test_edit_categories(spark):
    rows = [("a b", "a  b"), ("a b", "A, b."), ("то є слово", "то є Київ Word"), ("кіт сів", "пес сів")]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("d", tx.token_diff("a", "b"))
    got = [r[0] for r in df.select(tx.edit_category(F.col("a"), F.col("b"), F.col("d"))).collect()]
    assert got == ["unchanged", "cosmetic", "proper_noun_fix", "substantive_rewrite"]


def test_times(spark):
    v = lambda c: value(spark, c)
    assert [v(timefmt.auto_silence_ms(F.lit(x))) for x in (1000, 60_000, 180_000, 300_000, 900_000)] == [5000, 5000, 10_000, 15_000, 15_000]
    assert v(timefmt.hms_truncated(F.lit(3661.9))) == "01:01:01" and v(timefmt.hms_rounded(F.lit(3661.9))) == "01:01:02"
    assert v(timefmt.compact(F.lit(3800.0))) == "1h3m20s" and v(timefmt.clock(F.lit(65.0))) == "1:05"
    assert v(timefmt.one_decimal(F.lit(0.25))) == "0.2" and v(timefmt.one_decimal(F.lit(1234.56))) == "1234.6"
    assert v(timefmt.percent(F.lit(1), F.lit(0))) == 0 and v(timefmt.to_ms(F.lit(1.9999))) == 1999
    assert v(timefmt.utc_minute(F.lit("nonsense"))) == "nonsense"
    assert v(timefmt.utc_minute(F.lit("2024-01-02T03:04:05Z"))) == "2024-01-02 03:04 UTC"
    assert v(timefmt.silence_line(F.lit(2.0), F.lit(15.0), F.lit("pause"))) == "> _[пауза 00:00:02–00:00:15]_"


def test_majority_takes_the_first_on_ties(spark):
    df = spark.createDataFrame([(1, 0, "B"), (1, 1, "A"), (1, 2, "A"), (1, 3, "B"), (2, 0, None)], "k long, i long, v string")
    assert [(r["k"], r["v"]) for r in ag.majority(df, ["k"], "v", "i").collect()] == [(1, "B")]


def test_names(spark):
    c = [(1, "S1", "Ann", "medium", 0), (1, "S2", "Ann", "high", 9), (1, "S3", "bob", "high", 1), (1, "S4", "Eve", "low", 1)]
    got = ag.resolve_names(spark.createDataFrame(c, "conv_id long, speaker string, name string, confidence string, first_ms long")).collect()
    assert [(r["speaker"], r["name"]) for r in got] == [("S2", "Ann")]


def tone(levels, seconds=1.0, hz=440):
    t = np.arange(int(seconds * dsp.RATE)) / dsp.RATE
    return np.concatenate([a * np.sin(2 * np.pi * hz * t) for a in levels]).astype(np.float32)


def test_autogain_levels_turns():
    x = tone([0.02, 0.3])
    y, stats = dsp.autogain(x, [(0, 1), (1, 2)], dsp.AudioOptions())
    assert stats["turn_count"] == 2 and stats["post_rms_std_db"] < stats["pre_rms_std_db"]
    assert abs(dsp.level(y[dsp.RATE + 4000 :]) + 20) < 0.2


def test_filters_act_on_their_bands():
    low, mid = tone([0.3], hz=40), tone([0.3], hz=1000)
    o = dsp.AudioOptions()
    assert dsp.level(dsp.bandpass(low, [], o)[0]) < dsp.level(low) - 20
    assert abs(dsp.level(dsp.bandpass(mid, [], o)[0]) - dsp.level(mid)) < 1
    high = tone([0.1], hz=3000)
    assert 5 < dsp.level(dsp.presence(high, [], o)[0]) - dsp.level(high) < 7


def test_dereverb_keeps_length_and_lowers_tails():
    r = np.random.default_rng(0)
    x = (r.standard_normal(2 * dsp.RATE) * np.exp(-np.arange(2 * dsp.RATE) / dsp.RATE * 5) * 0.3).astype(np.float32)
    y, stats = dsp.dereverb(x, [(0, 2)], dsp.AudioOptions())
    assert len(y) == len(x) and stats["turn_count"] == 1 and dsp.rms(y[dsp.RATE // 2 :]) < dsp.rms(x[dsp.RATE // 2 :])


def test_levels_around_a_cut(spark):
    x = tone([0.1, 0.4])
    before, after = dsp.around(x, 1.0)
    assert abs(before - 0.1 / 2**0.5) < 1e-3 and abs(after - 0.4 / 2**0.5) < 1e-3 and dsp.around(x, 0.0)[0] == 0.0 and dsp.around(x, 9.0) == (0.0, 0.0)
    rec = spark.createDataFrame([("r", bytearray(dsp.write_wav(x)))], "recording_id string, content binary")
    got = dsp.levels_around(rec, spark.createDataFrame([("r", 1, 1000), ("r", 0, 0)], "recording_id string, boundary long, cutoff_ms long")).collect()
    assert [(r["boundary"], round(r["rms_before"], 3), round(r["rms_after"], 3)) for r in got] == [(0, 0.0, 0.071), (1, 0.071, 0.283)]
    assert len(dsp.slices(x, [(1.5, 2.0), (0.0, 0.25)])) == 12_000 and len(dsp.slices(x, [])) == 0


def test_audio_options():
    for bad in ({"chain": ("echo",)}, {"chain": ("autogain", "autogain")}, {"low_hz": 6000.0}, {"rt60_floor_ms": 0.0}, {"q": 0.0}):
        with pytest.raises(dsp.AudioError):
            dsp.AudioOptions(**bad)


def test_audio_through_spark(spark, tmp_path):
    (tmp_path / "r1.wav").write_bytes(dsp.write_wav(tone([0.02, 0.3])))
    (tmp_path / "bad.wav").write_bytes(b"no audio")
    rec = audio.metadata(audio.probe(audio.read_recordings(spark, str(tmp_path))))
    got = {r["recording_id"]: (r["duration_s"], r["source"]) for r in rec.collect()}
    assert got == {"r1": (2.0, "mtime"), "bad": (None, "mtime")}
    turns = spark.createDataFrame([("r1", 0, 1000), ("r1", 1000, 2000)], "recording_id string, start_ms long, end_ms long")
    out = dsp.clean_audio(rec.where("recording_id = 'r1'"), turns, dsp.AudioOptions(chain=("autogain",))).first()
    with wave.open(io.BytesIO(bytes(out["content"]))) as w:
        assert w.getnframes() == 2 * dsp.RATE
    assert '"turn_count": 2' in out["stats"]


def test_prompts():
    p = prompts.parse("p", "---\ntemperature: 0.2\nplaceholders: [a]\nname: x\n---\nHello <<a>> and << b >>\n")
    assert p.slots == ["a", "b"] and p.render(a=1, b=2, c=3) == "Hello 1 and 2" and p.call_kwargs() == {"temperature": 0.2}
    with pytest.raises(KeyError):
        p.render(a=1)
    assert [prompts.scalar(x) for x in ("null", "true", "3", "1.5", "'q'", "[1, 2]", "[a, b]", "word")] == [None, True, 3, 1.5, "q", [1, 2], ["a", "b"], "word"]
    assert prompts.with_context("p", " ", "uk") == "p" and prompts.with_context("p", "c", "en").startswith("The user described")


def test_dumps(spark, tmp_path):
    (tmp_path / "rec.json").write_text('[{"start": 2, "end": 3, "text": "b"}, {"start": 0, "end": 1, "text": " a "}, {"text": " "}]')
    rows = dumps.read_asr(spark, str(tmp_path / "rec.json")).orderBy("seq").collect()
    assert [(r["recording_id"], r["seq"], r["content"]) for r in rows] == [("rec", 0, "a"), ("rec", 1, "b")]
    df = spark.createDataFrame([("r", 0, 0.0, 1.0, "a", "A", None)], dumps.SEGMENTS)
    back = dumps.write_stage(df, str(tmp_path / "out"), "merge")
    assert back.collect() == df.collect() and dumps.write_stage(df, None, "merge") is df
    assert dumps.read_pair(df, back).count() == 1
    with pytest.raises(ValueError):
        dumps.read_pair(df, back.withColumn("start", F.col("start") + 1))
    with pytest.raises(ValueError):
        dumps.stage_path("x", "nope")


def test_providers(spark):
    u = spark.createDataFrame([(1, 0, "A", "teh long sentence", 0, 1000), (1, 1, "B", "short", 1000, 2000), (1, 2, "A", "boom goes the model", 2000, 3000)], U)

    def model():
        def run(t):
            if "boom" in t:
                raise RuntimeError("no")
            return t.replace("teh", "the")

        return run

    got = [(r["content"], r["sent"]) for r in providers.proofread(u, model).orderBy("seq").collect()]
    assert got == [("the long sentence", True), ("short", False), ("boom goes the model", True)]
    assert providers.structure(u, lambda: lambda t: "not json").collect()[0]["title"] == "Розмова"
    s = spark.createDataFrame([(1, 0, "T", 0, 9000)], "conv_id long, i long, title string, start_ms long, end_ms long")
    reply = lambda: lambda t: '{"redactions":[{"start_idx":1,"end_idx":1,"topic":"health"}]}'
    assert "[muted, 1.0s]" in [r["content"] for r in providers.redact_stage(u, s, reply).collect()]
    assert providers.redact_stage(u, s, reply, topics=[]).count() == 3
    named = providers.identify(u, lambda: lambda t: '{"name":"Ann","confidence":"high"}').collect()
    assert [(r["speaker"], r["name"]) for r in named] == [("A", "Ann")]
    many = spark.createDataFrame([(1, i, "T", f"s{i}") for i in range(9)] + [(2, 0, "T", "alone")], "conv_id long, seq long, title string, content string")
    # every call joins what it is given; blocks have a heading each
    plain = lambda: lambda t: "## TL;DR\n\n" + "+".join(x for x in t.split("\n") if x and not x.startswith("#"))
    got = {r["conv_id"]: r["summary"] for r in providers.summarise(many, plain).collect()}
    assert got == {1: "+".join(f"s{i}" for i in range(9)), 2: "alone"}

    def absent():
        return str

    absent.health_check = lambda: (_ for _ in ()).throw(FileNotFoundError("model"))
    with pytest.raises(providers.ProviderError):
        providers.proofread(u, absent)
    text = render.render(u, s).first()["markdown"]
    assert "## T" in text and "🔵 **A:** teh long sentence" in text


def test_options():
    o = options.from_args(["--no-structure", "--names", "A, B", "--proofread-context", "5"])
    assert o.names == ("A", "B") and not o.structure
    assert sorted(o.changed()) == ["--names A,B", "--no-structure", "--proofread-context 5"]
    assert options.names(None) is None and options.names(" ") == ()


def test_utc_minutes_in_any_session_zone(spark):
    v = lambda c: value(spark, c)
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            for text, want in (("2024-01-01T12:00:00Z", "2024-01-01 12:00 UTC"), ("2024-03-31T02:30:00", "2024-03-31 02:30 UTC"), ("2024-07-01T12:00:00+02:00", "2024-07-01 10:00 UTC"), ("2024-07-01", "2024-07-01 00:00 UTC"), ("soon", "soon")):
                assert v(timefmt.utc_minute(F.lit(text))) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_edits_of_one_row_are_judged_as_columns_are(spark):
    r = random.Random(4)
    pairs = [("".join(r.choices("ab ё", k=r.randint(0, 9))), "".join(r.choices("ab ё'\"`", k=r.randint(0, 9)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", tx.edit_is_safe(F.col("a"), F.col("b")).alias("safe"), tx.strip_artifacts(F.col("b")).alias("bare"))
    for x in df.collect():
        assert x["safe"] == tx.is_safe(x["a"], x["b"]) and x["bare"] == tx.without_artifacts(x["b"])


def test_topics_and_models(spark):
    assert tx.topic_labels(["health", "x"], "EN") == "health, x" and tx.topic_labels(["x"], "uk") == "- x"
    got = [value(spark, tx.short_model_name(F.lit(x))) for x in ("org/name", "org/a/b", "/models/org/name", "./x/", "~/y", "bare")]
    assert got == ["name", "a/b", "name", "x", "y", "bare"]
    assert options.Options(model="m", structure_model="s").model_of("structure") == "s" and options.Options(model="m").model_of("summary") == "m" and options.Options(model="m").model_of("merge") is None


def test_evaluation(spark):
    assert evaluation.parse_grid("0, 3,") == [0, 3]
    for bad in ("", " , ", "-1", "x"):
        with pytest.raises(ValueError):
            evaluation.parse_grid(bad)
    rows = spark.createDataFrame([(0, 480.0, "clean", 0.5, float("nan"), 0.1, None, "a|b\nc")], "boundary long, cutoff_s double, verdict string, gap_s double, jaccard double, rms_before double, rms_after double, note string")
    assert evaluation.boundary_rows(rows).first()["line"] == "| 0 | 08:00.00 | clean | 0.50 |  | 0.1000 |  | a\\|b c |"
    sheet = spark.createDataFrame([(1, 7, 0.0, 61.5, None, "a", "b"), (1, 9, 2.0, 3.0, "S", "c", "d")], "sheet_id long, segment_idx int, start_s double, end_s double, speaker string, asr_text string, proofread_text string")
    text = evaluation.spot_check(sheet, "# Spot-check").withColumn("text", F.regexp_replace("text", r"(?s)(Segment 9.*?)\[ \] worse", "$1[x] worse"))
    assert "timestamp 00:00.00-01:01.50 (speaker: ?)" in text.first()["text"]
    assert [(r["segment_idx"], r["mark"]) for r in segments.human_marks(text).orderBy("segment_idx").collect()] == [(7, None), (9, "worse")]


def test_structure_of_long_recordings(spark):
    rows = [(1, i, f"S{i % 2}", f"row {i}", 1000 * i, 1000 * i + 900) for i in range(70)] + [(2, 0, None, "noise", 0, 500), (2, 1, "A", "hi there", 500, 900), (2, 2, None, "end", 900, 5000), (3, 0, None, "x", 0, 1)]
    u = spark.createDataFrame(rows, U)

    def model():
        def run(text):
            at = [int(x[1:9].split(":")[0]) * 3600 + int(x[4:6]) * 60 + int(x[7:9]) for x in text.split("\n") if "pause" not in x]
            return '{"sections":[{"title":"T%d","start_ms":%d,"end_ms":%d}]}' % (at[0], at[0] * 1000, at[-1] * 1000 + 900) if len(at) > 2 else "{}"

        return run

    got = [(r["conv_id"], r["title"], r["start_ms"], r["end_ms"]) for r in providers.structure(u, model).orderBy("conv_id", "start_ms").collect()]
    assert got == [(1, "T0", 0, 34_900), (1, "T33", 34_900, 67_900), (1, "T66", 67_900, 69_900), (2, "Розмова", 0, 5000)]
    assert providers.structure(u, None, language="en").count() == 2


def test_a_whole_run(spark, tmp_path):
    rec = spark.createDataFrame([(1, "/in/a.wav", "2024-01-01T00:00:00Z", 30.0), (2, "/in/b.wav", "?", 10.0)], "conv_id long, path string, started_at string, duration_s double")
    turns = spark.createDataFrame([(1, 0, "A", 0, 4000), (1, 1, "B", 4000, 9000), (2, 0, "A", 0, 5000)], "conv_id long, turn_id long, label string, start_ms long, end_ms long")
    segs = spark.createDataFrame([(1, 0, 0, 8000, "one two three four"), (1, 1, 8200, 9000, "teh end of this"), (2, 0, 100, 4000, "my name is Eve")], "conv_id long, seq long, start_ms long, end_ms long, content string")
    words = spark.createDataFrame([(1, 0, i, w, 2000 * i, 2000 * i + 1900, 0.9) for i, w in enumerate("one two three four".split())], "conv_id long, seq long, i int, token string, start_ms long, end_ms long, probability double")
    inputs = run.Inputs(rec, turns, segs, words)
    opts = options.Options(proofread=True, names=("Ann", "Bob"), dump=str(tmp_path / "out"), redact_topics=("health",), model="org/m-1", user_context="a test")
    known = {
        "language": lambda: lambda t: '{"en": 0.9, "uk": 0.1}',
        "proofread": lambda: lambda t: (t.split("fix this one only]\n")[-1].split("\n\n[CONTEXT")[0]).replace("teh", "the"),
        "redact": lambda: lambda t: '{"redactions":[{"start_idx":0,"end_idx":0,"topic":"health"}]}' if "Eve" in t else "{}",
        "summary": lambda: lambda t: "TL of " + str(t.count(":")),
    }
    out = run.run(inputs, opts, known)
    assert [(r["conv_id"], r["seq"], r["speaker"], r["content"]) for r in out.tables["merge"].orderBy("conv_id", "seq").collect()] == [(1, 0, "A", "one two"), (1, 1, "B", "three four"), (1, 2, "B", "teh end of this"), (2, 0, "A", "my name is Eve")]
    docs = {r["conv_id"]: r["markdown"] for r in out.tables["render"].collect()}
    assert docs[1].startswith("# Transcript: a.wav\n\n> | | |\n> | --- | --- |\n> | 📅 **Started (duration):** | 2024-01-01 00:00 UTC (30s) |\n> | 🌐 **Language:** | en (auto-detected=0.90, uk=0.10")
    for part in ("> | 🔵 **Ann** | *user-specified* |", "| `m-1` | model loaded | 0s |", "| `--proofread` | — |", "💡 **Context:** | a test |", "## TL;DR\n\nTL of 3\n\n---\n\n## Розмова\n\n🔵 **Ann:** one two\n\n🟢 **Bob:** three four the end of this\n"):
        assert part in docs[1], part
    assert "Eve" not in docs[2]
    again = run.run(inputs, options.Options(**{**opts.__dict__, "resume": True}), {k: lambda: (lambda t: 1 / 0) for k in known})
    assert {r["conv_id"]: r["markdown"] for r in again.tables["render"].collect()} == docs
    plain = run.run(inputs, options.Options(split_on_turns=False, language="en"))
    assert [r["speaker"] for r in plain.tables["merge"].orderBy("conv_id", "seq").collect()] == ["A", "B", "A"] and plain.tables["structure"].count() == 2


def test_empty_tables(spark):
    u, t = spark.createDataFrame([], U), spark.createDataFrame([], T)
    assert sequences.paragraphs(u).count() == sequences.silence_events(u).count() == sequences.pause_markers(u).count() == 0
    assert intervals.overlap_join(spark.createDataFrame([], S), t, "k").count() == 0
    assert ag.first_appearance(u).count() == 0
