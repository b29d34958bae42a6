"""More registered queries: formats, names, marks, splits, language and structure stages, and the parts of rendered documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import timefmt as tf
from ..operators import aggregates as ag
from ..operators import intervals as iv
from ..operators import scripts as sc
from ..operators import segments as sg
from ..operators import sequences as sq
from ..operators import splits as sp
from . import providers as pv
from . import render as rn
from . import timeline as tl
from .queries import ANCHOR_SQL, ORACLES, OVER, PALETTE, PROBS, SILENCE_SQL, _owned, _probs, _u, _utt_turns, _with, query

HMS = "printf('%02d:%02d:%02d', ({0}) // 3600, ({0}) // 60 % 60, ({0}) % 60)"
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _conversations(spark, d, sql: str):
    return tl.table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{sql} AS r")


ARTIFACTS = """CASE (conv_id + turn) % 6 WHEN 0 THEN concat('"', text, '"') WHEN 1 THEN concat('Text: ', text) WHEN 2 THEN concat('`Text: ', text, '`')
 WHEN 3 THEN concat('  ', text, ' ') WHEN 4 THEN '""' ELSE concat('"', text) END"""


@query(f"""SELECT conv_id, turn, regexp_replace(CASE WHEN length(t) >= 2 AND t[1] = t[-1] AND t[1] IN ('"', '''', '`') THEN {TRIM.format("substr(t, 2, length(t) - 2)")} ELSE t END, '^Text: ', '') AS text
FROM (SELECT conv_id, turn, {TRIM.format(ARTIFACTS)} AS t FROM conversations)""")
def strip_artifacts(spark, d):
    return _conversations(spark, d, ARTIFACTS).select("conv_id", "turn", tx.strip_artifacts(F.col("r")).alias("text"))


HEADINGS = "CASE turn % 4 WHEN 0 THEN concat('## TL;DR{0}{0}', text) WHEN 1 THEN concat('**TLDR:**{0}', text) WHEN 2 THEN concat('{0}{0}# tl;dr {0}', text) ELSE concat('TL;DR ', text) END"


@query(rf"""SELECT conv_id, turn, regexp_replace(regexp_replace(r, '^\s*(?:#{{1,6}}\s*TL;?DR\s*\n+|\*\*TL;?DR:?\*\*\s*\n+)', '', 'i'), '^\n+', '') AS text
FROM (SELECT conv_id, turn, {HEADINGS.replace("'{0}{0}#", "chr(10) || chr(10) || '#").replace("{0}{0}'", "' || chr(10) || chr(10)").replace("{0}'", "' || chr(10)")} AS r FROM conversations)""")
def summary_heading(spark, d):
    return _conversations(spark, d, HEADINGS.replace("{0}", "\\n")).select("conv_id", "turn", tx.strip_summary_heading(F.col("r")).alias("text"))


SLOTS = "concat('<<', role, '>> and <<t', CAST(turn % 3 AS VARCHAR(9)), '>> <', text, '> <<', role, '>>')"


@query(rf"""SELECT conv_id, turn, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), ',') AS slots FROM (
  SELECT conv_id, turn, regexp_extract_all({SLOTS}, '<<(\w+)>>', 1) AS l FROM conversations)""")
def template_slots(spark, d):
    return _conversations(spark, d, SLOTS).select("conv_id", "turn", F.array_join(tx.placeholders(F.col("r")), ",").alias("slots"))


MODELS = "CASE doc_id % 4 WHEN 0 THEN concat('org/', source, '-4bit') WHEN 1 THEN concat('/models/x/', source) WHEN 2 THEN source ELSE concat('./', source, '/') END"


@query(f"""SELECT DISTINCT source, doc_id % 4 AS kind, CASE doc_id % 4 WHEN 0 THEN source || '-4bit' ELSE source END AS name FROM (SELECT doc_id, source, {MODELS} AS m FROM documents)""")
def model_names(spark, d):
    docs = tl.table(spark, d, "documents").selectExpr("doc_id % 4 AS kind", "source", f"{MODELS} AS m").distinct()
    return docs.select("source", "kind", tx.short_model_name(F.col("m")).alias("name"))


@query(rf"""SELECT conv_id, turn, len(l) AS n, array_to_string(l, '|') AS items FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(text || ', ,x', ','), lambda x: {TRIM.format("x")}), lambda x: x <> '') AS l FROM conversations)""")
def csv_lists(spark, d):
    parts = _conversations(spark, d, "concat(text, ', ,x')").withColumn("l", tx.csv_list(F.col("r")))
    return parts.select("conv_id", "turn", F.size("l").cast("long").alias("n"), F.array_join("l", "|").alias("items"))


@query("""SELECT doc_id // 50 AS sheet_id, doc_id::INT AS segment_idx, quality + toxic AS n_ticked, CASE WHEN quality + toxic = 1 THEN CASE WHEN quality = 1 THEN 'better' ELSE 'worse' END END AS mark FROM labels""")
def human_marks(spark, d):
    box = "concat('## Segment ', doc_id, ' at 0:01\\n\\n- [', IF(quality = 1, 'x', ' '), '] better\\n- [', IF(toxic = 1, 'X', ' '), '] worse\\n- [ ] neutral\\n')"
    one = tl.table(spark, d, "labels").selectExpr("doc_id DIV 50 AS sheet_id", "doc_id", f"{box} AS t")
    sheets = one.groupBy("sheet_id").agg(F.concat(F.lit("# Spot-check\n\n"), F.expr("listagg(t, '\n') WITHIN GROUP (ORDER BY doc_id)")).alias("text"))
    return sg.human_marks(sheets)


@query("""SELECT doc_id // 50 AS sheet_id, doc_id::INT AS segment_idx, CASE WHEN quality = 1 THEN 'better' WHEN toxic = 1 THEN 'worse' END AS mark, 'r' || quality AS rationale FROM labels""")
def judge_marks(spark, d):
    entry = F.struct(F.col("doc_id").cast("string"), F.struct(F.expr("CASE WHEN quality = 1 THEN 'Better' WHEN toxic = 1 THEN 'worse' ELSE 'fine' END").alias("mark"), F.concat(F.lit("r"), F.col("quality").cast("string")).alias("rationale")))
    replies = tl.table(spark, d, "labels").groupBy(F.expr("doc_id DIV 50").alias("sheet_id")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("text"))
    return sg.judge_marks(replies)


HUMAN, JUDGE = "SELECT doc_id, CASE WHEN quality = 1 THEN 'better' ELSE 'worse' END AS mark FROM {0} WHERE doc_id % 3 > 0", "SELECT doc_id, CASE WHEN toxic = 0 THEN 'better' ELSE 'neutral' END AS mark FROM {0} WHERE doc_id % 5 > 0"


def _marks(spark, d):
    labels = tl.table(spark, d, "labels")
    return spark.sql(HUMAN.format("{l}"), l=labels), spark.sql(JUDGE.format("{l}"), l=labels)


@query(f"SELECT h.doc_id, h.mark AS human, j.mark AS judge FROM ({HUMAN.format('labels')}) h JOIN ({JUDGE.format('labels')}) j USING (doc_id)")
def marks_in_common(spark, d):
    return ag.common_marks(*_marks(spark, d), "doc_id")[0]


@query(f"""SELECT doc_id, 'left' AS side FROM ({HUMAN.format('labels')}) WHERE doc_id NOT IN (SELECT doc_id FROM ({JUDGE.format('labels')}))
UNION ALL SELECT doc_id, 'right' FROM ({JUDGE.format('labels')}) WHERE doc_id NOT IN (SELECT doc_id FROM ({HUMAN.format('labels')}))""")
def marks_on_one_side(spark, d):
    return ag.common_marks(*_marks(spark, d), "doc_id")[1]


@query(f"SELECT doc_id FROM ({HUMAN.format('labels')}) UNION SELECT doc_id FROM ({JUDGE.format('labels')})")
def marked_keys(spark, d):
    return ag.all_keys(*_marks(spark, d), "doc_id")


@query(f"""SELECT m AS category, (SELECT count(*) FROM ({HUMAN.format('labels')}) WHERE mark = m) AS n,
  round_even((SELECT count(*) FROM ({HUMAN.format('labels')}) WHERE mark = m) * 100.0 / (SELECT count(*) FROM ({HUMAN.format('labels')})), 1)::DOUBLE AS pct FROM (SELECT unnest(['better', 'worse', 'neutral']) AS m)""")
def mark_counts(spark, d):
    return ag.histogram(_marks(spark, d)[0], "mark", ["better", "worse", "neutral"])


RAW = "SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '  ' ELSE concat('  ', text, ' ') END AS text, CASE WHEN turn % 3 = 0 THEN NULL ELSE turn * 1.5D END AS start, CASE WHEN turn % 5 = 0 THEN NULL ELSE turn * 1.5D + 1 END AS end_, text AS t FROM {c}"


def _parsed(spark, d):
    raw = spark.sql(RAW, c=tl.table(spark, d, "conversations")).withColumnRenamed("end_", "end")
    word = F.transform(F.split("t", " "), lambda w, i: F.struct((i * 0.25).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.when(i % 2 == 0, F.concat(w, F.lit(" "))).alias("word"), F.when(i % 3 > 0, w).alias("text"), F.lit(0.5).alias("probability")))
    return sg.parse_segments(raw.withColumn("words", F.when(F.col("turn") % 2 == 0, word)).withColumn("speaker_hint", F.lit("A")).drop("t"))


SEGS_SQL = """seg AS (SELECT conv_id, turn, trim(text) AS content, CASE WHEN turn % 3 = 0 THEN 0 ELSE turn * 1.5 END::DOUBLE AS start, CASE WHEN turn % 5 = 0 THEN 0 ELSE turn * 1.5 + 1 END::DOUBLE AS "end",
  CASE WHEN turn % 2 = 0 THEN string_split(text, ' ') END AS w FROM conversations WHERE turn % 4 <> 3 AND trim(text) <> ''),
kept AS (SELECT *, list_filter(list_transform(w, lambda x, i: {'c': CASE WHEN (i - 1) % 2 = 0 OR (i - 1) % 3 > 0 THEN trim(x) ELSE '' END, 's': (i - 1) * 0.25}), lambda s: s.c <> '') AS k FROM seg)"""


@query(f"WITH {SEGS_SQL} SELECT conv_id, turn, content, start, \"end\" FROM kept")
def parsed_segments(spark, d):
    return _parsed(spark, d).select("conv_id", "turn", "content", "start", "end")


@query(f"WITH {SEGS_SQL} SELECT conv_id, turn, len(k) AS n, k[1].c AS first, k[-1].s::DOUBLE AS last_start FROM kept WHERE len(k) > 0")
def parsed_words(spark, d):
    s = _parsed(spark, d).where("words IS NOT NULL")
    return s.select("conv_id", "turn", F.size("words").cast("long").alias("n"), F.col("words")[0]["content"].alias("first"), F.element_at("words", -1)["start"].alias("last_start"))


@query(f"WITH {SEGS_SQL} SELECT conv_id, turn, start + 7.5 AS start, \"end\" + 7.5 AS \"end\", CASE WHEN len(k) > 0 THEN k[-1].s::DOUBLE + 7.5 END AS last_start, NULL::VARCHAR AS speaker_hint FROM kept")
def shifted_segments(spark, d):
    s = sg.shift(_parsed(spark, d), 7.5)
    return s.select("conv_id", "turn", "start", "end", F.element_at("words", -1)["start"].alias("last_start"), "speaker_hint")


NAMED = "CASE conv_id % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('N', CAST(seq % 2 AS VARCHAR(9))) END"


@query(f"""SELECT conv_id, seq, coalesce(nullif({NAMED}, ''), nullif(speaker, ''), '?') AS label, speaker IS NULL AND starts_with(content, '[muted') AS muted, length(trim(content)) < 10 AS short, speaker IS NOT NULL AS speech FROM utterances_m""")
def row_predicates(spark, d):
    u = tl.muted(spark, d).withColumn("name", F.expr(NAMED))
    return u.select("conv_id", "seq", tx.label(F.col("name"), F.col("speaker"), "?").alias("label"), sq.is_muted().alias("muted"), (F.length(F.trim("content")) < 10).alias("short"), F.col("speaker").isNotNull().alias("speech"))


# quarters of a second are exact in a double, so ties are ties
SECONDS = "(o_orderkey * 37 % 500000) / 4.0"


def _half(x: str) -> str:
    return f"round_even({x}, 0)::BIGINT"


@query(f"""SELECT o_orderkey, CASE WHEN r >= 3600 THEN printf('%d:%02d:%02d', r // 3600, r // 60 % 60, r % 60) ELSE printf('%d:%02d', r // 60, r % 60) END AS clock,
  CASE WHEN r >= 3600 THEN printf('%dh%dm%ds', r // 3600, r // 60 % 60, r % 60) WHEN r >= 60 THEN printf('%dm%ds', r // 60, r % 60) ELSE printf('%ds', r) END AS compact,
  {HMS.format("r")} AS rounded, {HMS.format("t")} AS truncated, printf('%02d:%05.2f', floor(s / 60)::BIGINT, s - 60 * floor(s / 60)) AS fine, trunc(s * 1000)::BIGINT AS ms,
  printf('%.1f', round_even(s, 1)) AS tenth, {_half("s / 500 * 100")}::INT AS pct FROM (SELECT o_orderkey, s, {_half("s")} AS r, trunc(s)::BIGINT AS t FROM (SELECT o_orderkey, ({SECONDS})::DOUBLE AS s FROM orders))""")
def time_formats(spark, d):
    s = F.col("s")
    return tl.table(spark, d, "orders").selectExpr("o_orderkey", f"CAST({SECONDS} AS DOUBLE) AS s").select(
        "o_orderkey", tf.clock(s).alias("clock"), tf.compact(s).alias("compact"), tf.hms_rounded(s).alias("rounded"), tf.hms_truncated(s).alias("truncated"),
        tf.minutes_seconds(s).alias("fine"), tf.to_ms(s).alias("ms"), tf.one_decimal(s).alias("tenth"), tf.percent(s, F.lit(500.0)).alias("pct"),
    )


@query("""SELECT o_orderkey, round(CASE WHEN r < 1e-6 THEN 1.0 ELSE least(0.1 / r, pow(10, 0.8)) END, 9) AS gain, round(20 * log10(r + 1e-12), 9) AS db FROM (SELECT o_orderkey, (o_orderkey % 1000) / 1000.0::DOUBLE AS r FROM orders)""")
def levels(spark, d):
    r = tl.table(spark, d, "orders").selectExpr("o_orderkey", "o_orderkey % 1000 / 1000.0D AS r")
    return r.select("o_orderkey", F.round(tf.gain(F.col("r")), 9).alias("gain"), F.round(tf.decibel(F.col("r")), 9).alias("db"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN 'no time' WHEN 1 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M UTC') ELSE strftime(ts, '%Y-%m-%d %H:%M UTC') END AS at FROM events""")
def utc_minutes(spark, d):
    iso = "substring(replace(CAST(ts AS STRING), ' ', 'T'), 1, 19)"
    text = F.expr(f"CASE event_id % 4 WHEN 0 THEN concat({iso}, 'Z') WHEN 1 THEN concat({iso}, '+02:00') WHEN 2 THEN {iso} ELSE 'no time' END")
    return tl.table(spark, d, "events").select("event_id", tf.utc_minute(text).alias("at"))


def _rounded(ms: str) -> str:
    return HMS.format(f"round_even({ms} / 1000.0, 0)::BIGINT")


MARK = f"'[' || CASE kind WHEN 'pause' THEN 'пауза' ELSE 'muted' END || ' ' || {_rounded('{0}start_ms')} || '–' || {_rounded('{0}end_ms')} || ']'"


@query()
def silence_lines(spark, d):
    v = sq.silence_events(tl.muted(spark, d))
    return v.select("conv_id", "start_ms", tf.silence_line(F.col("start_ms") / 1000, F.col("end_ms") / 1000, F.col("kind")).alias("line"))


ORACLES["silence_lines"] = _with(SILENCE_SQL.format(t="utterances_m"), f"SELECT conv_id, start_ms, '> _' || {MARK.format('')} || '_' AS line FROM silence")

TOP2 = f"SELECT user_id, max(label) FILTER (WHERE r = 1) AS top1, max(prob) FILTER (WHERE r = 1) AS p1, max(label) FILTER (WHERE r = 2) AS top2, max(prob) FILTER (WHERE r = 2) AS p2 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY prob DESC, label) AS r FROM ({PROBS})) WHERE prob >= 0.05 GROUP BY user_id"


@query(f"""SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'uk (user-specified)' ELSE top1 || ' (auto-detected=' || c1 || coalesce(', ' || top2 || '=' || c2, '') || CASE user_id % 3 WHEN 1 THEN ', 2/2 agree' ELSE ', 2/2 disagree, picked higher prob' END || ')' END AS cell
FROM (SELECT *, printf('%.2f', round(p1, 2)) AS c1, printf('%.2f', round(p2, 2)) AS c2 FROM ({TOP2}))""")
def language_cells(spark, d):
    t = ag.top_two(_probs(spark, d), ["user_id"])
    top = F.when(F.col("user_id") % 3 > 0, F.col("top1"))
    how = F.when(F.col("user_id") % 3 == 1, "agree").otherwise("disagree")
    return t.select("user_id", sg.language_cell(F.lit("uk"), top, F.round("p1", 2), F.col("top2"), F.round("p2", 2), how).alias("cell"))


@query(f"""SELECT conv_id, string_agg(CASE WHEN p >= 3000 THEN '[' || {HMS.format("e // 1000")} || ' — pause ' || round_even(p / 1000.0, 0)::BIGINT || 's]' || chr(10) ELSE '' END || '[' || {HMS.format("start_ms // 1000")} || '] ' || coalesce(speaker, '?') || ': ' || content, chr(10) ORDER BY seq) AS text
FROM (SELECT *, start_ms - lag(end_ms) OVER w AS p, lag(end_ms) OVER w AS e FROM utterances WINDOW w AS (PARTITION BY conv_id ORDER BY seq)) GROUP BY conv_id""")
def script_lines(spark, d):
    return sc.script(_u(spark, d))


@query("""SELECT conv_id, section, string_agg(idx || ': ' || coalesce(speaker, '?') || ': ' || trim(content), chr(10) ORDER BY seq) AS text FROM (
  SELECT u.*, s.i AS section, row_number() OVER (PARTITION BY u.conv_id, s.i ORDER BY u.seq) - 1 AS idx FROM utterances u JOIN sections s ON s.conv_id = u.conv_id AND s.start_ms <= u.start_ms AND u.start_ms < s.end_ms) GROUP BY conv_id, section""")
def indexed_lines(spark, d):
    return sc.indexed(_u(spark, d), tl.sections(spark, d))


@query("SELECT conv_id, string_agg(speaker || ': ' || trim(content), chr(10) ORDER BY seq) AS text FROM utterances_m WHERE speaker IS NOT NULL AND trim(content) <> '' GROUP BY conv_id")
def dialogue_lines(spark, d):
    return sc.dialogue(tl.muted(spark, d))


@query()
def dialogue_with_silence(spark, d):
    return sc.dialogue(tl.muted(spark, d), silence=True)


ORACLES["dialogue_with_silence"] = _with(
    SILENCE_SQL.format(t="utterances_m") + "," + ANCHOR_SQL.format(t="utterances_m"),
    f"""SELECT conv_id, string_agg(line, chr(10) ORDER BY seq) AS text FROM (
  SELECT u.conv_id, u.seq, nullif(concat_ws(chr(10), {MARK.format('a.')}, CASE WHEN speaker IS NOT NULL AND trim(content) <> '' THEN speaker || ': ' || trim(content) END), '') AS line
  FROM utterances_m u LEFT JOIN anchor a ON a.conv_id = u.conv_id AND a.seq = u.seq) WHERE line IS NOT NULL GROUP BY conv_id""",
)


@query("SELECT conv_id, string_agg('### T' || seq % 3 || chr(10) || trim(content), chr(10) || chr(10) ORDER BY seq) AS text FROM utterances GROUP BY conv_id")
def summary_blocks(spark, d):
    return sc.blocks(_u(spark, d).withColumn("title", F.concat(F.lit("T"), (F.col("seq") % 3).cast("string"))))


@query(f"""SELECT conv_id, seq, CASE WHEN b IS NULL AND a IS NULL THEN content ELSE concat_ws(chr(10), '{sc.BEFORE}' || chr(10) || b || chr(10), '{sc.CURRENT}' || chr(10) || content, chr(10) || '{sc.AFTER}' || chr(10) || a) END AS request FROM (
  SELECT x.conv_id, x.seq, any_value(x.content) AS content, string_agg(l, chr(10) ORDER BY s) FILTER (WHERE s < x.seq) AS b, string_agg(l, chr(10) ORDER BY s) FILTER (WHERE s > x.seq) AS a FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS r FROM utterances) x JOIN (
    SELECT conv_id, seq AS s, coalesce('[' || speaker || '] ', '') || content AS l, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS r FROM utterances) y ON x.conv_id = y.conv_id AND abs(x.r - y.r) <= 3 GROUP BY x.conv_id, x.seq)""")
def context_requests(spark, d):
    return sc.requests(_u(spark, d)).select("conv_id", "seq", "request")


FIRST = "SELECT conv_id, speaker, row_number() OVER (PARTITION BY conv_id ORDER BY min(seq)) - 1 AS rank FROM utterances WHERE speaker IS NOT NULL GROUP BY conv_id, speaker"
GIVEN = "SELECT conv_id, i, concat('N', CAST(conv_id % 4 AS VARCHAR(9))) AS name FROM (SELECT DISTINCT conv_id, 0 AS i FROM {0} WHERE conv_id % 4 > 0)"
NAMES = f"SELECT f.conv_id, f.speaker, g.name FROM ({FIRST}) f JOIN ({GIVEN.format('conversations')}) g ON g.conv_id = f.conv_id AND g.i = f.rank"


def _given(spark, d):
    names = spark.sql(GIVEN.format("{c}"), c=tl.table(spark, d, "conversations"))
    return ag.given_names(_u(spark, d), names.withColumn("i", F.col("i").cast("long")))


@query(f"SELECT *, 'user-specified' AS source FROM ({NAMES})")
def given_names(spark, d):
    return _given(spark, d)


@query(f"SELECT u.conv_id, u.seq, u.speaker, n.name FROM utterances u LEFT JOIN ({NAMES}) n USING (conv_id, speaker)")
def named_rows(spark, d):
    return ag.apply_names(_u(spark, d), _given(spark, d)).select("conv_id", "seq", "speaker", "name")


@query(f"SELECT DISTINCT u.conv_id, u.speaker, CASE WHEN n.name IS NULL THEN 'unidentified' ELSE 'user-specified' END AS source FROM utterances u LEFT JOIN ({NAMES}) n USING (conv_id, speaker) WHERE u.speaker IS NOT NULL")
def name_sources(spark, d):
    return ag.name_sources(_u(spark, d), _given(spark, d))


# two speakers may go by one name, so the first of them counts
@query(f"""SELECT conv_id, label, arg_min(speaker, seq) AS speaker, min(seq) AS first_seq FROM (SELECT conv_id, seq, speaker, coalesce(nullif({NAMED}, ''), speaker) AS label FROM utterances WHERE speaker IS NOT NULL) GROUP BY conv_id, label""")
def label_owners(spark, d):
    return ag.label_owners(_u(spark, d).withColumn("name", F.expr(NAMED)))


@query("SELECT conv_id, count(DISTINCT speaker) AS speakers FROM utterances GROUP BY conv_id")
def speaker_count(spark, d):
    return _u(spark, d).groupBy("conv_id").agg(F.count_distinct("speaker").alias("speakers"))


@query(f"SELECT user_id, label, prob, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY prob DESC, label) AS r FROM ({PROBS})) WHERE r <= 3")
def top3_probs(spark, d):
    return ag.top_n(_probs(spark, d), ["user_id"])


TIMINGS = "SELECT o_orderkey % 50 AS recording_id, o_orderpriority AS stage, o_orderstatus AS model, CAST(o_orderkey % 97 AS BIGINT) AS elapsed FROM {0}"


@query(f"SELECT recording_id, stage, model, sum(elapsed)::BIGINT AS elapsed, count(*) AS parts FROM ({TIMINGS.format('orders')}) GROUP BY ALL")
def stage_timings(spark, d):
    return ag.stage_totals(spark.sql(TIMINGS.format("{o}"), o=tl.table(spark, d, "orders")), ["recording_id", "stage", "model"])


@query("SELECT CASE WHEN event_id % 5 = 0 THEN '<unparsed>' ELSE 'aten::' || event_type END AS op, count(*) AS n FROM events GROUP BY 1")
def fallback_ops(spark, d):
    said = F.when(F.col("event_id") % 5 == 0, "something fell back").otherwise(F.concat(F.lit("The operator 'aten::"), F.col("event_type"), F.lit("' is not supported")))
    return ag.pattern_counts(tl.table(spark, d, "events").select(said.alias("m")), "m", "operator '([^']+)'")


@query("""SELECT '{"agreed":' || a || ',"common":' || n || ',"pct":' || p || '}' AS json FROM (SELECT count(*) AS n, count(*) FILTER (WHERE quality = toxic) AS a, round_even(count(*) FILTER (WHERE quality = toxic) * 100.0 / count(*), 1)::DOUBLE AS p FROM labels)""")
def counters_json(spark, d):
    from ..sources.dumps import summary_block

    return summary_block(ag.agreement(tl.table(spark, d, "labels"), "quality", "toxic"))


@query("""SELECT user_id, seg_id, arg_min(label, turn_id) AS label FROM segs s JOIN turns t USING (user_id) WHERE abs(t.start_ms - s.start_ms) <= 60000 GROUP BY ALL""")
def starts_within(spark, d):
    return iv.start_within(tl.segs(spark, d).select("user_id", "seg_id", "start_ms"), tl.turns(spark, d), "user_id", "start_ms", "turn_id", "label", ["user_id", "seg_id"], 60_000)


@query("SELECT conv_id AS recording_id, seq::INT AS seq, speaker, content AS asr_text, upper(content) AS proofread_text FROM utterances WHERE regexp_matches(content, '^[ -~\\n]*$')")
def paired_rows(spark, d):
    from ..sources.dumps import read_pair

    u = _u(spark, d).where(F.col("content").rlike(r"^[ -~\n]*$"))
    u = u.select(F.col("conv_id").alias("recording_id"), F.col("seq").cast("int").alias("seq"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "content", "speaker")
    out = read_pair(u, u.withColumn("content", F.upper("content")).withColumn("start", F.col("start") + 1e-9))
    return out.select("recording_id", "seq", "speaker", "asr_text", "proofread_text")


@query("""SELECT user_id AS recording_id, CASE WHEN user_id % 3 > 0 THEN max(value)::VARCHAR END AS value FROM (SELECT user_id, event_id AS value FROM events) GROUP BY user_id""")
def stage_values(spark, d):
    from ..sources.dumps import stage_value

    n = tl.table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("n"))
    meta = n.select(F.col("user_id").alias("recording_id"), F.when(F.col("user_id") % 3 == 0, "[]").otherwise(F.format_string('{"proofread":{"llm_calls":%d}}', "n")).alias("stages"))
    return stage_value(meta, "proofread", "llm_calls")


def _split(spark, d):
    # segments of events have no words: cut by characters. What they say is the text of a document.
    docs = tl.table(spark, d, "documents").select(F.col("doc_id").alias("_d"), F.col("text").alias("content"))
    segs = tl.segs(spark, d).withColumn("_d", F.expr("seg_id % 100")).join(docs, "_d").drop("_d")
    words = spark.createDataFrame([], "user_id long, seg_id long, i int, token string, start_ms long, end_ms long, probability double")
    return sp.split_segments(segs, words, tl.turns(spark, d), "user_id", "seg_id", "turn_id", "label")


PIECES = f"""sx AS (SELECT s.*, d.text AS content FROM segs s JOIN documents d ON d.doc_id = s.seg_id % 100),
cr AS (SELECT user_id, seg_id FROM (SELECT user_id, seg_id, count(*) FILTER (WHERE ms > 300) AS n FROM ({OVER}) GROUP BY user_id, seg_id) WHERE n >= 2),
b AS (SELECT DISTINCT s.user_id, s.seg_id, t.start_ms AS p_at FROM sx s JOIN cr USING (user_id, seg_id) JOIN turns t ON t.user_id = s.user_id WHERE t.start_ms > s.start_ms AND t.start_ms < s.end_ms),
p AS (SELECT * FROM b UNION ALL SELECT user_id, seg_id, start_ms FROM sx WHERE (user_id, seg_id) IN (SELECT (user_id, seg_id) FROM b)),
c AS (SELECT p.*, content, start_ms AS s0, end_ms AS s1, coalesce(lead(p_at) OVER (PARTITION BY user_id, seg_id ORDER BY p_at), end_ms) AS nxt, row_number() OVER (PARTITION BY user_id, seg_id ORDER BY p_at) - 1 AS fragment FROM p JOIN sx USING (user_id, seg_id)),
o AS (SELECT *, trim(substr(content, length(content) * (p_at - s0) // (s1 - s0) + 1, length(content) * (nxt - s0) // (s1 - s0) - length(content) * (p_at - s0) // (s1 - s0))) AS piece FROM c),
f AS (SELECT *, nxt - p_at >= 200 AND piece <> '' AS fine FROM o),
cut AS (SELECT user_id, seg_id, count(*) FILTER (WHERE fine) AS n, count(*) FILTER (WHERE NOT fine) AS short FROM f GROUP BY user_id, seg_id)"""


@query(f"""WITH {PIECES}
SELECT user_id, seg_id, fragment, p_at AS start_ms, nxt AS end_ms, piece AS content, 'chars' AS how FROM f JOIN cut USING (user_id, seg_id) WHERE fine AND n > 1
UNION ALL SELECT user_id, seg_id, 0, start_ms, end_ms, content, 'kept' FROM sx WHERE (user_id, seg_id) NOT IN (SELECT (user_id, seg_id) FROM cut WHERE n > 1)""")
def split_segments(spark, d):
    return _split(spark, d)[0].select("user_id", "seg_id", "fragment", "start_ms", "end_ms", "content", "how")


@query(f"""WITH {PIECES}
SELECT (SELECT count(*) FROM sx) AS input_segments, ((SELECT count(*) FROM sx) + (SELECT sum(n - 1) FROM cut WHERE n > 1))::BIGINT AS output_segments, (SELECT count(*) FROM cut WHERE n > 1) AS segments_split,
  (SELECT sum(n) FROM cut WHERE n > 1)::BIGINT AS new_segments, (SELECT count(*) FROM cut) AS fallback_chars, (SELECT sum(short) FROM cut)::BIGINT AS fragments_below_least, 200 AS least_ms, 300 AS threshold_ms""")
def split_telemetry(spark, d):
    return _split(spark, d)[1]


# turns as a diarizer would hear them: 700 ms late, so that rows cross them
LATE = "SELECT conv_id, seq, start_ms + 700 AS start_ms, end_ms + 700 AS end_ms, speaker FROM utterances WHERE speaker IS NOT NULL"
WORD_PIECES = f"""late AS ({LATE}),
ov AS (SELECT u.conv_id, u.seq, t.speaker, sum(least(u.end_ms, t.end_ms) - greatest(u.start_ms, t.start_ms)) AS ms FROM utterances u JOIN late t ON t.conv_id = u.conv_id AND u.start_ms < t.end_ms AND u.end_ms > t.start_ms GROUP BY ALL),
cr AS (SELECT conv_id, seq FROM ov WHERE ms > 10 GROUP BY ALL HAVING count(*) >= 2),
ow AS (SELECT * FROM (SELECT w.*, t.speaker AS owner, row_number() OVER (PARTITION BY w.conv_id, w.seq, w.i ORDER BY least(w.end_ms, t.end_ms) - greatest(w.start_ms, t.start_ms) DESC, t.seq) AS r
  FROM words w JOIN cr USING (conv_id, seq) LEFT JOIN late t ON t.conv_id = w.conv_id AND w.start_ms < t.end_ms AND w.end_ms > t.start_ms) WHERE r = 1),
fr AS (SELECT *, sum(CASE WHEN i > 0 AND owner IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, seq ORDER BY i)::BIGINT AS fragment FROM (SELECT *, lag(owner) OVER (PARTITION BY conv_id, seq ORDER BY i) AS prev FROM ow)),
f AS (SELECT conv_id, seq, fragment, arg_min(start_ms, i) AS start_ms, arg_max(end_ms, i) AS end_ms, string_agg(token, ' ' ORDER BY i) AS content, max(owner) AS hint FROM fr GROUP BY conv_id, seq, fragment),
cut AS (SELECT conv_id, seq, count(*) AS n, max(hint) AS h FROM f WHERE end_ms - start_ms >= 200 AND content <> '' GROUP BY conv_id, seq)"""


@query(f"""WITH {WORD_PIECES},
worded AS (SELECT DISTINCT conv_id, seq FROM words), k AS (SELECT conv_id, seq FROM cut WHERE n > 1 OR h IS NOT NULL)
SELECT f.conv_id, f.seq, fragment, start_ms, end_ms, content, hint, 'words' AS how FROM f JOIN k USING (conv_id, seq) WHERE end_ms - start_ms >= 200 AND content <> ''
UNION ALL SELECT conv_id, seq, 0, start_ms, end_ms, content, NULL, 'kept' FROM utterances WHERE (conv_id, seq) IN (SELECT (conv_id, seq) FROM worded) AND (conv_id, seq) NOT IN (SELECT (conv_id, seq) FROM k)""")
def split_by_owner(spark, d):
    u, w = _u(spark, d), tl.words(spark, d)
    late = spark.sql(LATE.replace("utterances", "{u}").replace("seq,", "seq AS turn_id,"), u=u)
    segs = u.select("conv_id", "seq", "start_ms", "end_ms", "content").join(w.select("conv_id", "seq").distinct(), ["conv_id", "seq"], "left_semi")
    return sp.split_segments(segs, w, late, "conv_id", "seq", "turn_id", "speaker", threshold_ms=10, bucket_ms=600_000)[0]


@query()
def refinements(spark, d):
    return sp.refinements(_owned(spark, d), _owned(spark, d, filler_tie_ms=200, deadband_ms=150), ["conv_id", "seq", "i"])


# a grid of tolerances, each scored by how many words it gives to their own speaker
GRID = (0, 300, 700)


@query(f"""SELECT shift, count(*) AS words, count(*) FILTER (WHERE owner = truth) AS good FROM (
  SELECT shift, w.conv_id, w.seq, w.i, any_value(u.speaker) AS truth, arg_min(t.speaker, row(-(least(w.end_ms, t.end_ms + shift) - greatest(w.start_ms, t.start_ms + shift)), t.seq)) AS owner
  FROM words w JOIN utterances u ON u.conv_id = w.conv_id AND u.seq = w.seq CROSS JOIN (SELECT unnest([{', '.join(map(str, GRID))}]) AS shift)
  LEFT JOIN utterances t ON t.conv_id = w.conv_id AND t.speaker IS NOT NULL AND w.start_ms < t.end_ms + shift AND w.end_ms > t.start_ms + shift GROUP BY shift, w.conv_id, w.seq, w.i) GROUP BY shift""")
def grid_scores(spark, d):
    from ..operators.evaluation import grid_scores as scores

    turns = _utt_turns(spark, d)
    moved = {g: turns.withColumn("start_ms", F.col("start_ms") + g).withColumn("end_ms", F.col("end_ms") + g) for g in GRID}
    truth = _u(spark, d).select("conv_id", "seq", F.col("speaker").alias("truth"))
    return scores(tl.words(spark, d).join(truth, ["conv_id", "seq"]), moved, ["conv_id", "seq", "i"], "conv_id", "turn_id", "speaker", "shift", 600_000)


@query("""SELECT o_orderkey AS run, string_agg(f, '; ' ORDER BY f) AS failures FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'device not available' END AS f FROM orders
  UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 = 0 THEN 'no device memory was used' END FROM orders
  UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 7 > 0 THEN 'operators fell back' END FROM orders) GROUP BY o_orderkey""")
def device_gates(spark, d):
    from ..operators.evaluation import gates

    runs = tl.table(spark, d, "orders").selectExpr(
        "o_orderkey AS run", "CASE WHEN o_orderkey % 4 = 0 THEN 'device' WHEN o_orderkey % 2 = 0 THEN 'device-trace' ELSE 'cpu' END AS config", "o_orderkey % 3 > 0 AS available",
        "IF(o_orderkey % 5 = 0, 0L, 9L) AS allocated", "5L AS driver_before", "5L AS driver_after", "o_orderkey % 7 AS fallbacks",
    )
    return gates(runs).select("run", "failures")


@query("""SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'Conversation' ELSE 'Розмова' END AS title, arg_min(start_ms, seq) AS start_ms, arg_max(end_ms, seq) AS end_ms FROM utterances_m GROUP BY conv_id""")
def fallback_section(spark, d):
    u = tl.muted(spark, d)
    return pv.fallback_section(u.where("conv_id % 2 = 0"), language="EN").unionByName(pv.fallback_section(u.where("conv_id % 2 = 1")))


def _first_answer():
    """A provider without a model: its reply stands in the request's first row."""
    return lambda text: text.split("\x1f")[1]


@query("""WITH t AS (SELECT conv_id, count(*) AS n, arg_min(start_ms, seq) AS a, arg_max(end_ms, seq) AS b FROM utterances_m WHERE speaker IS NOT NULL GROUP BY conv_id),
w AS (SELECT conv_id, arg_min(start_ms, seq) AS a, arg_max(end_ms, seq) AS b FROM utterances_m GROUP BY conv_id)
SELECT conv_id, 'A' AS title, a AS start_ms, b AS end_ms FROM t WHERE n >= 4 AND conv_id % 3 > 0
UNION ALL SELECT t.conv_id, 'Розмова', w.a, w.b FROM t JOIN w USING (conv_id) WHERE n < 4 OR conv_id % 3 = 0""")
def structure_in_chunks(spark, d):
    u = tl.muted(spark, d)
    # each row carries a section over itself; the chunks' answers are those of their first rows, all titled A. Short recordings get too few.
    reply = F.when(F.col("conv_id") % 3 > 0, F.format_string('{"sections":[{"title":"A","start_ms":%d,"end_ms":%d}]}', "start_ms", "end_ms")).otherwise("no")
    told = u.withColumn("content", F.when(F.col("speaker").isNotNull(), F.concat(F.lit("\x1f"), reply, F.lit("\x1f"))).otherwise(F.col("content")))
    return pv.structure(told, _first_answer, chunk_from=4, size=3, overlap=1, extend=2)


@query(f"""WITH e AS (SELECT user_id, turn_id, label, end_ms - start_ms AS dur FROM turns WHERE end_ms - start_ms >= 2000),
f AS (SELECT user_id, arg_min(row(turn_id, label, dur), row(-dur, turn_id)) AS a FROM e GROUP BY user_id),
g AS (SELECT e.user_id, arg_min(row(turn_id, label, dur), row(-dur, turn_id)) AS a FROM e JOIN f USING (user_id) WHERE e.label <> f.a[2] GROUP BY e.user_id),
r AS (SELECT user_id, a[1] AS t, 1 AS attempt FROM f UNION ALL SELECT user_id, a[1], 2 FROM g),
p AS (SELECT user_id, attempt, CASE WHEN t % 2 = 0 THEN 'en' ELSE 'uk' END AS top1, (60 + t % 30) / 100.0::DOUBLE AS p1 FROM r WHERE t % 7 > 0),
o AS (SELECT * FROM p WHERE user_id IN (SELECT user_id FROM p WHERE attempt = 1)),
v AS (SELECT user_id, arg_max(top1, row(p1, -attempt)) AS top1, arg_max(p1, row(p1, -attempt)) AS p1, count(*) AS n_attempts, CASE WHEN count(*) = 1 THEN 'single' WHEN count(DISTINCT top1) = 1 THEN 'agree' ELSE 'disagree' END AS agreement FROM o GROUP BY user_id)
SELECT x.user_id, coalesce(top1, 'uk') AS language, p1, agreement, n_attempts FROM (SELECT DISTINCT user_id FROM events) x LEFT JOIN v USING (user_id)""")
def detect_language(spark, d):
    def load():
        def run(text: str) -> str:
            t = int(text)
            p = (60 + t % 30) / 100
            return "{}" if t % 7 == 0 else '{"%s": %s, "xx": 0.01}' % ("en" if t % 2 == 0 else "uk", p)

        return run

    out = pv.detect_language(tl.turns(spark, d), tl.table(spark, d, "events").select("user_id").distinct(), load, "user_id", F.col("turn_id").cast("string"))
    return out.select("user_id", "language", "p1", "agreement", "n_attempts")


@query("""SELECT conv_id, seq // 1 AS seq, start_ms, end_ms, content FROM (
  SELECT conv_id, seq, start_ms, end_ms, trim(content) AS content FROM utterances WHERE trim(content) <> '')""")
def transcribe(spark, d):
    """One chunk a recording, whose reply holds its rows; the times come back from seconds."""
    u = _u(spark, d)
    said = F.struct((F.col("seq")).alias("seq"), ((F.col("start_ms") - 500) / 1000).alias("start"), ((F.col("end_ms") - 500) / 1000).alias("end"), F.concat(F.lit(" "), F.col("content")).alias("text"))
    chunks = u.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(said))).alias("audio")).select("conv_id", F.lit(0).alias("chunk"), F.lit(500).cast("long").alias("start_ms"), "audio")
    out = pv.transcribe(chunks, lambda: lambda audio: audio, F.col("audio"))
    return out.select("conv_id", "seq", "start_ms", "end_ms", "content")


RECORDINGS = """SELECT conv_id, concat('/in/rec', CAST(conv_id AS VARCHAR(9)), '.wav') AS path, CASE WHEN conv_id % 5 = 0 THEN 'unknown' ELSE '2024-03-05T10:59:30+01:00' END AS started_at, max(end_ms) / 1000.0D0 AS duration_s FROM {0} GROUP BY conv_id"""


def _recordings(spark, d):
    r = spark.sql(RECORDINGS.format("{u}").replace("1000.0D0", "1000.0D"), u=_u(spark, d))
    auto = F.col("conv_id") % 2 == 0
    return r.withColumns({
        "language": F.lit("uk"), "top1": F.when(auto, "en"), "p1": F.when(auto, 0.75), "top2": F.when(auto, "uk"), "p2": F.when(auto, 0.25), "agreement": F.lit("single"),
        "user_context": F.when(F.col("conv_id") % 3 == 0, "a talk"), "topics": F.when(F.col("conv_id") % 3 == 1, F.array(F.lit("health"), F.lit("other"))).when(F.col("conv_id") % 3 == 2, F.array().cast("array<string>")),
    })


_COMPACT = "CASE WHEN {0} >= 3600 THEN printf('%dh%dm%ds', {0} // 3600, {0} // 60 % 60, {0} % 60) WHEN {0} >= 60 THEN printf('%dm%ds', {0} // 60, {0} % 60) ELSE printf('%ds', {0}) END"
_DURATION = _COMPACT.format("r")
_ALL_TOPICS = "<br>".join(f"- {v}" for v in tx.TOPIC_LABELS.values()).replace("'", "''")
META_SQL = f"""SELECT conv_id, '| | |' || chr(10) || '| --- | --- |' || chr(10) || '| {rn.STARTED} | ' || CASE WHEN conv_id % 5 = 0 THEN 'unknown' ELSE '2024-03-05 09:59 UTC' END || ' (' || {_DURATION} || ') |' || chr(10)
  || '| {rn.LANGUAGE} | ' || CASE WHEN conv_id % 2 = 0 THEN 'en (auto-detected=0.75, uk=0.25)' ELSE 'uk (user-specified)' END || ' |' || chr(10) || '| {rn.CONTEXT} | ' || CASE WHEN conv_id % 3 = 0 THEN 'a talk' ELSE '*not specified*' END || ' |' || chr(10)
  || '| {rn.TOPICS} | ' || CASE conv_id % 3 WHEN 0 THEN '{_ALL_TOPICS} *(default)*' WHEN 1 THEN '- {tx.TOPIC_LABELS["health"].replace("'", "''")}<br>- other' ELSE '*disabled*' END || ' |' AS text
FROM (SELECT conv_id, round_even(max(end_ms) / 1000.0, 0)::BIGINT AS r FROM utterances GROUP BY conv_id)"""


@query(META_SQL)
def meta_table(spark, d):
    return rn.meta_table(_recordings(spark, d))


@query(f"""SELECT conv_id, '| {rn.PARTICIPANTS} | |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || ({PALETTE!r})[rank % 9 + 1] || ' **' || coalesce(name, speaker) || '** | *' || CASE WHEN name IS NULL THEN 'unidentified' ELSE 'user-specified' END || '* |', chr(10) ORDER BY rank) AS text
FROM ({FIRST}) LEFT JOIN ({NAMES}) USING (conv_id, speaker) GROUP BY conv_id""")
def participants_table(spark, d):
    u, names = _u(spark, d), _given(spark, d)
    return rn.participants_table(ag.apply_names(u, names), ag.name_sources(u, names))


STAGE_ROWS = "SELECT o_orderkey % 50 AS recording_id, min(o_orderkey) AS seq, o_orderpriority AS stage, o_orderstatus AS model, sum(o_orderkey % 97)::BIGINT AS elapsed FROM orders GROUP BY 1, 3, 4"


@query(f"""WITH t AS ({STAGE_ROWS}), f AS (SELECT recording_id, model, min(seq) AS first, sum(elapsed) AS load FROM t GROUP BY ALL),
l AS (SELECT recording_id, first, -1 AS o, '| `' || model || '` | model loaded | ' || {_COMPACT.format("load::BIGINT")} || ' |' AS x FROM f
  UNION ALL SELECT t.recording_id, first, t.seq, '|  | ' || stage || ' | ' || {_COMPACT.format("elapsed")} || ' |' FROM t JOIN f USING (recording_id, model)),
s AS (SELECT recording_id, sum(elapsed)::BIGINT AS r FROM t GROUP BY recording_id)
SELECT recording_id, '| {rn.PROCESSING} |  | ' || {_DURATION} || ' (' || round_even(r / 1000.0 * 100, 0)::INT || '% of duration) |' || chr(10) || '| --- | --- | --: |' || chr(10) || b AS text
FROM s JOIN (SELECT recording_id, string_agg(x, chr(10) ORDER BY first, o) AS b FROM l GROUP BY recording_id) USING (recording_id)""")
def models_table(spark, d):
    o = tl.table(spark, d, "orders")
    t = o.groupBy(F.expr("o_orderkey % 50").alias("recording_id"), F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("model")).agg(F.min("o_orderkey").alias("seq"), F.sum(F.expr("o_orderkey % 97")).cast("double").alias("elapsed"))
    loads = ag.stage_totals(t, ["recording_id", "model"])
    totals = ag.stage_totals(t, ["recording_id"]).select("recording_id", F.col("elapsed").alias("total"), F.lit(1000.0).alias("duration_s"))
    return rn.models_table(t, loads, totals, "recording_id")


# sections are recordings of their own to the silence rules, so they get ids of their own
BODY_SQL = """
us AS (SELECT u.conv_id * 100000 + s.i AS conv_id, u.conv_id AS rec, s.i AS sec, s.title, s.end_ms - s.start_ms AS span, u.seq, u.speaker, u.content, u.start_ms, u.end_ms FROM utterances_m u JOIN sections s ON s.conv_id = u.conv_id
  AND s.start_ms <= (u.start_ms + u.end_ms) // 2 AND (u.start_ms + u.end_ms) // 2 < s.end_ms)"""


@query()
def section_bodies(spark, d):
    return rn.section_bodies(tl.muted(spark, d), tl.sections(spark, d), least_ms=None)


_EMOJI_M = f"SELECT conv_id AS rec, speaker, ({PALETTE!r})[(row_number() OVER (PARTITION BY conv_id ORDER BY min(seq)) - 1) % 9 + 1] AS emoji FROM utterances_m WHERE speaker IS NOT NULL GROUP BY conv_id, speaker"
# tiles of 60 s have the least threshold, 5 s
_BODIES = f"""SELECT h.rec AS conv_id, h.sec AS section, h.title, body FROM (SELECT DISTINCT rec, sec, title FROM us) h LEFT JOIN (
  SELECT rec, sec, string_agg(CASE WHEN cut AND para > 1 THEN '---' || chr(10) || chr(10) ELSE '' END || emoji || ' **' || speaker || ':** ' || content, chr(10) || chr(10) ORDER BY first_seq) AS body FROM (
    SELECT rec, sec, para, speaker, min(seq) AS first_seq, bool_or(cut) AS cut, trim(string_agg(content, ' ' ORDER BY seq)) AS content FROM (
      SELECT *, sum(brk) OVER (PARTITION BY conv_id ORDER BY seq) AS para FROM (
        SELECT u.conv_id, u.rec, u.sec, u.seq, u.speaker, trim(u.content) AS content, a.seq IS NOT NULL AS cut,
          CASE WHEN a.seq IS NOT NULL OR u.speaker IS DISTINCT FROM lag(u.speaker) OVER w OR u.start_ms - lag(u.end_ms) OVER w >= 2000 THEN 1 ELSE 0 END AS brk
        FROM us u LEFT JOIN anchor a ON a.conv_id = u.conv_id AND a.seq = u.seq WHERE u.speaker IS NOT NULL WINDOW w AS (PARTITION BY u.conv_id ORDER BY u.seq))) GROUP BY rec, sec, para, speaker)
    JOIN ({_EMOJI_M}) e USING (rec, speaker) GROUP BY rec, sec) b ON b.rec = h.rec AND b.sec = h.sec"""
_BODY_PARTS = BODY_SQL + "," + SILENCE_SQL.format(t="us").replace("10000", "5000") + "," + ANCHOR_SQL.format(t="us")
ORACLES["section_bodies"] = _with(_BODY_PARTS, _BODIES)


@query()
def render_markdown(spark, d):
    return rn.render(tl.muted(spark, d), tl.sections(spark, d), recordings=_recordings(spark, d), least_ms=None)


ORACLES["render_markdown"] = _with(
    _BODY_PARTS + f""",
bodies AS ({_BODIES}),
docs AS (SELECT conv_id, string_agg('## ' || title || coalesce(chr(10) || chr(10) || body, ''), chr(10) || chr(10) ORDER BY section) AS text FROM bodies GROUP BY conv_id),
meta AS ({META_SQL}),
people AS (SELECT conv_id, '| {rn.PARTICIPANTS} | |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || ({PALETTE!r})[rank % 9 + 1] || ' **' || speaker || '** |  |', chr(10) ORDER BY rank) AS text
  FROM (SELECT conv_id, speaker, row_number() OVER (PARTITION BY conv_id ORDER BY min(seq)) - 1 AS rank FROM utterances_m WHERE speaker IS NOT NULL GROUP BY conv_id, speaker) GROUP BY conv_id)""",
    """SELECT m.conv_id, concat_ws(chr(10) || chr(10), '# Transcript: rec' || m.conv_id || '.wav', concat_ws(chr(10) || '> ' || chr(10), '> ' || replace(m.text, chr(10), chr(10) || '> '), '> ' || replace(p.text, chr(10), chr(10) || '> ')), d.text) || chr(10) AS markdown
FROM meta m LEFT JOIN people p ON p.conv_id = m.conv_id LEFT JOIN docs d ON d.conv_id = m.conv_id""",
)


# the sequential operators as recursive SQL
ORACLES["speaker_chunks"] = f"""WITH RECURSIVE {tl.SQL}, n AS (SELECT conv_id, seq, speaker, row_number() OVER (PARTITION BY conv_id ORDER BY seq) - 1 AS r, count(*) OVER (PARTITION BY conv_id) AS size FROM utterances WHERE speaker IS NOT NULL),
e AS (SELECT a.conv_id, a.r AS lo, a.size, (SELECT min(x) FROM (SELECT unnest(range(least(a.r + 3, a.size), least(a.r + 3, a.size) + 3)) AS x) WHERE x >= least(a.size, least(a.r + 3, a.size) + 2)
    OR (SELECT y.speaker FROM n y WHERE y.conv_id = a.conv_id AND y.r = x) IS DISTINCT FROM (SELECT z.speaker FROM n z WHERE z.conv_id = a.conv_id AND z.r = least(a.r + 3, a.size) - 1)) AS hi FROM n a),
c AS (SELECT conv_id, 0::BIGINT AS chunk, lo, hi, size FROM e WHERE lo = 0 UNION ALL SELECT e.conv_id, c.chunk + 1, e.lo, e.hi, e.size FROM c JOIN e ON e.conv_id = c.conv_id AND e.lo = c.hi - 1 WHERE c.hi < c.size)
SELECT c.conv_id, c.chunk, f.seq AS first_seq, l.seq AS last_seq, c.hi - c.lo AS n FROM c JOIN n f ON f.conv_id = c.conv_id AND f.r = c.lo JOIN n l ON l.conv_id = c.conv_id AND l.r = c.hi - 1"""
_SNAPPED = ORACLES["containment_snap"].removeprefix(f"WITH {tl.SQL},").rpartition("SELECT conv_id, title, prior AS start_ms")
ORACLES["fuse_sections"] = f"""WITH RECURSIVE {tl.SQL},{_SNAPPED[0]}, snapped AS ({_SNAPPED[1]}{_SNAPPED[2]}),
merged AS (SELECT conv_id, grp, arg_min(title, start_ms) AS t, min(start_ms) AS s, max(end_ms) AS e FROM (SELECT *, sum(CASE WHEN title = prev THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY start_ms) AS grp FROM (
  SELECT *, lag(title) OVER (PARTITION BY conv_id ORDER BY start_ms) AS prev FROM snapped)) GROUP BY conv_id, grp),
rec AS (SELECT conv_id, list({{'t': t, 's': s, 'e': e}} ORDER BY s) AS l FROM merged GROUP BY conv_id
  UNION ALL SELECT conv_id, l[:i - 1] || [{{'t': CASE WHEN l[i].e - l[i].s >= l[i + 1].e - l[i + 1].s THEN l[i].t ELSE l[i + 1].t END, 's': l[i].s, 'e': l[i + 1].e}}] || l[i + 2:] FROM (
    SELECT conv_id, l, list_position(sp, list_min(sp)) AS i FROM (SELECT conv_id, l, list_transform(range(1, len(l)), lambda j: l[j + 1].e - l[j + 1].s + l[j].e - l[j].s) AS sp FROM rec WHERE len(l) > 3)))
SELECT conv_id, x.t AS title, x.s AS start_ms, x.e AS end_ms FROM (SELECT conv_id, unnest(l) AS x FROM rec WHERE len(l) <= 3)"""
ORACLES["dedup_all_chunks"] = f"""SELECT conv_id, chunk, seq, start_ms, end_ms, content FROM (WITH {tl.SQL} SELECT conv_id, 0 AS chunk, 'tail' AS side, seq, start_ms, end_ms, content FROM utterances WHERE seq <= 3
  UNION ALL SELECT conv_id, 1, 'head', seq, start_ms - 20000, end_ms - 20000, content FROM utterances WHERE seq >= 2) WHERE (conv_id, side, seq) NOT IN (SELECT (conv_id, side, seq) FROM ({ORACLES["boundary_dedup"]}))"""
ORACLES["proofread_feedback"] = f"""WITH {tl.SQL} SELECT conv_id, seq, CASE WHEN length({TRIM.format("content")}) >= 10 THEN {TRIM.format("replace(content, 'the ', 'The ')")} ELSE content END AS content,
  count(*) FILTER (WHERE length({TRIM.format("content")}) >= 10) OVER (PARTITION BY conv_id) AS llm_calls FROM utterances"""
