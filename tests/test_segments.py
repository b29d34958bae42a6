"""Cases of raw segments and marks."""

from pyspark.sql import functions as F

from parlance.operators import segments as sg


def test_segments_are_cleaned_and_moved(spark):
    raw = spark.createDataFrame(
        [(None, 1.0, " a ", [(0.0, 0.5, " x ", None, 0.9), (0.5, 0.6, None, " ", None)]), (1.0, 2.0, "  ", None), (2.0, 3.0, "b", [])],
        f"start double, end double, text string, words {sg.WORDS}",
    )
    got = sg.parse_segments(raw).collect()
    assert [(r["start"], r["content"], r["words"] and len(r["words"])) for r in got] == [(0.0, "a", 1), (2.0, "b", None)]
    moved = sg.shift(sg.parse_segments(raw).withColumn("speaker_hint", F.lit("S")), 5.0).first()
    assert (moved["start"], moved["words"][0]["start"], moved["speaker_hint"]) == (5.0, 5.0, None)
    same = sg.parse_segments(raw)
    assert sg.shift(same, 0) is same


def test_fallback_sections(spark):
    u = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 20), (2, 0, 5, 9)], "conv_id long, seq long, start_ms long, end_ms long")
    s = spark.createDataFrame([(1, "Розмова", 0, 20), (2, "Plans", 5, 9)], "conv_id long, title string, start_ms long, end_ms long")
    assert {r["conv_id"]: r["synthetic"] for r in sg.is_fallback(s, u).collect()} == {1: True, 2: False}


def test_marks(spark):
    sheet = "intro\n## Segment 3\n- [x] better\n- [ ] worse\n## Segment 4\n- [x] better\n- [X] worse\n## Segment 5\n- [ ] neutral\n"
    got = {r["segment_idx"]: (r["n_ticked"], r["mark"]) for r in sg.human_marks(spark.createDataFrame([(1, sheet)], "sheet_id long, text string")).collect()}
    assert got == {3: (1, "better"), 4: (2, None), 5: (0, None)}
    reply = '{"3": {"mark": "Worse", "rationale": "r"}, "4": {"mark": "odd"}, "x": {"mark": "better"}}'
    got = {r["segment_idx"]: r["mark"] for r in sg.judge_marks(spark.createDataFrame([(1, reply), (2, "no json")], "sheet_id long, text string")).collect()}
    assert got == {3: "worse", 4: None}


def test_sweep_and_language_cell(spark):
    df = spark.createDataFrame([(0, "unchanged"), (0, "cosmetic"), (3, "unchanged")], "n int, c string")
    got = {r["n"]: (r["total"], r["cosmetic"], r["hit_pct"]) for r in sg.sweep(df, "n", "c", ["unchanged", "cosmetic"]).collect()}
    assert got == {0: (2, 1, 50.0), 3: (1, 0, 0.0)}
    row = spark.createDataFrame([("uk", "uk", 0.7, "ru", 0.2, "agree"), ("en", None, None, None, None, None)], "l string, a string, p double, b string, q double, g string")
    cell = sg.language_cell(*[F.col(c) for c in "lapbqg"])
    assert [r[0] for r in row.select(cell).collect()] == ["uk (auto-detected=0.70, ru=0.20, 2/2 agree)", "en (user-specified)"]
