"""Markdown of recordings: a header of tables, a summary, and paragraphs by section.

Every part is a DataFrame of (key, text) of its own, made by recording; :func:`render` puts them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import timefmt as tf
from ..operators import aggregates as ag
from ..operators import scripts as sc
from ..operators import segments as sg
from ..operators import sequences as sq
from ..operators.intervals import containing

PALETTE = ag.PALETTE
# What the header's cells say.
STARTED, LANGUAGE, CONTEXT, TOPICS = "📅 **Started (duration):**", "🌐 **Language:**", "💡 **Context:**", "🚫 **Redacted topics:**"
PARTICIPANTS, PROCESSING = "👥 **Participants:**", "⚡ **Processing time:**"


def row(*cells) -> Column:
    """A table row of column cells and fixed texts."""
    parts = [F.lit("| ")]
    for k, c in enumerate(cells):
        parts += [F.lit(" | ")] * (k > 0) + [F.lit(c) if isinstance(c, str) else c]
    return F.concat(*parts, F.lit(" |"))


def labelled(u: DataFrame) -> DataFrame:
    """``u`` with the label that a reader sees (the name, else the speaker) as its speaker."""
    return u.withColumn("speaker", F.when(F.col("speaker").isNotNull(), sc.who(u, None))).drop("name")


def in_sections(u: DataFrame, sections: DataFrame, key: str = "conv_id", bucket_ms: int = 3_600_000) -> DataFrame:
    """Rows with the section (i, title) that holds their middle; others go."""
    middle = u.select(key, "seq", F.expr("(start_ms + end_ms) DIV 2").alias("_at"))
    hit = containing(middle, sections.select(key, "i", "title", "start_ms", "end_ms"), key, "_at", "i", [key, "seq"], bucket_ms)
    return u.join(hit.select(key, "seq", F.col("_hit.r_i").alias("section"), F.col("_hit.r_title").alias("title"), (F.col("_hit.r_end_ms") - F.col("_hit.r_start_ms")).alias("_span")), [key, "seq"])


def section_bodies(u: DataFrame, sections: DataFrame, key: str = "conv_id", least_ms: int | None = None) -> DataFrame:
    """(key, section, title, body) of every section that has rows; ``body`` is null if nobody speaks in it.

    A silence between two paragraphs is a rule (``---``); how long it must be follows the section's length unless ``least_ms`` says."""
    u = labelled(u)
    inside = in_sections(u, sections, key)
    # a section is a recording of its own to the paragraph operator
    keyed = inside.withColumn("_k", F.struct(key, "section"))
    least = tf.auto_silence_ms(F.col("_span")) if least_ms is None else F.lit(least_ms).cast("long")
    heads = keyed.groupBy("_k").agg(F.first("title").alias("title"), F.first(least).alias("least_ms"))
    para = sq.paragraphs(keyed.select("_k", "seq", "speaker", "content", "start_ms", "end_ms"), "_k", thresholds=heads.select("_k", "least_ms"), marks=True)
    emoji = ag.emoji_map(u, PALETTE, key).select(key, "speaker", "emoji")
    said = F.concat(F.col("emoji"), F.lit(" **"), F.col("speaker"), F.lit(":** "), F.col("content"))
    rule = F.when(F.col("silence") & (F.col("para") > 1), F.lit("---"))
    rows = para.withColumn(key, F.col(f"_k.{key}")).join(emoji, [key, "speaker"]).withColumn("_l", F.concat_ws("\n\n", rule, said))
    bodies = sc.joined(rows, ["_k"], "_l", "first_seq", "\\n\\n")
    return heads.join(bodies, "_k", "left").select(f"_k.{key}", "_k.section", "title", F.col("text").alias("body"))


def meta_table(recordings: DataFrame, key: str = "conv_id", language: str = "uk") -> DataFrame:
    """(key, text) from recordings (key, started_at, duration_s, language, top1, p1, top2, p2, agreement, and perhaps user_context and topics)."""
    started = F.concat(tf.utc_minute(F.col("started_at")), F.lit(" ("), tf.compact(F.col("duration_s")), F.lit(")"))
    spoken = sg.language_cell(F.col("language"), F.col("top1"), F.col("p1"), F.col("top2"), F.col("p2"), F.col("agreement"))
    lines = [F.lit("| | |"), F.lit("| --- | --- |"), row(STARTED, started), row(LANGUAGE, spoken)]
    if "user_context" in recordings.columns:
        lines.append(row(CONTEXT, F.coalesce(F.nullif("user_context", F.lit("")), F.lit("*not specified*"))))
    if "topics" in recordings.columns:
        default = F.lit(tx.topic_labels(list(tx.TOPIC_LABELS), language).replace("\n", "<br>") + " *(default)*")
        names = F.create_map(*[F.lit(x) for kv in tx.TOPIC_LABELS.items() for x in kv])
        if language.lower().startswith("en"):
            shown = F.array_join("topics", ", ")
        else:
            shown = F.array_join(F.transform("topics", lambda t: F.concat(F.lit("- "), F.coalesce(F.try_element_at(names, t), t))), "<br>")
        cell = F.when(F.col("topics").isNull(), default).when(F.size("topics") == 0, F.lit("*disabled*")).otherwise(shown)
        lines.append(row(TOPICS, cell))
    return recordings.select(key, F.concat_ws("\n", *lines).alias("text"))


def participants_table(u: DataFrame, sources: DataFrame | None = None, key: str = "conv_id") -> DataFrame:
    """(key, text): everybody in order of first appearance; ``sources`` (key, speaker, source) says where names came from."""
    who = ag.emoji_map(labelled(u), PALETTE, key)
    tag = F.lit("")
    if sources is not None:
        owners = ag.label_owners(u, key).select(key, F.col("label").alias("speaker"), F.col("speaker").alias("_c"))
        found = sources.select(key, F.col("speaker").alias("_c"), "source")
        who = who.join(owners, [key, "speaker"], "left").join(found, [key, "_c"], "left")
        tag = F.coalesce(F.concat(F.lit("*"), F.col("source"), F.lit("*")), F.lit(""))
    lines = who.withColumn("_l", row(F.concat(F.col("emoji"), F.lit(" **"), F.col("speaker"), F.lit("**")), tag))
    head = f"| {PARTICIPANTS} | |\n| --- | --- |\n"
    return sc.joined(lines, [key], "_l", "rank").withColumn("text", F.concat(F.lit(head), F.col("text")))


def models_table(timings: DataFrame, loads: DataFrame, totals: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, text) from timings (key, seq, stage, model, elapsed), loads (key, model, elapsed) and totals (key, total, duration_s).

    A model's rows stand together, in order of its first stage: its loading, then its stages."""
    first = timings.groupBy(key, "model").agg(F.min("seq").alias("first"))
    load = first.join(loads.select(key, "model", F.col("elapsed").alias("load")), [key, "model"], "left")
    top = load.select(key, "first", F.lit(-1).cast("long").alias("seq"), row(F.concat(F.lit("`"), F.col("model"), F.lit("`")), "model loaded", tf.compact(F.coalesce("load", F.lit(0.0)))).alias("_l"))
    rest = timings.where("elapsed IS NOT NULL").join(first, [key, "model"]).select(key, "first", F.col("seq").cast("long").alias("seq"), row("", F.col("stage"), tf.compact(F.col("elapsed"))).alias("_l"))
    body = top.unionByName(rest).withColumn("_o", F.struct("first", "seq"))
    body = sc.joined(body, [key], "_l", "_o")
    share = F.concat(tf.compact(F.col("total")), F.lit(" ("), tf.percent(F.col("total"), F.col("duration_s")).cast("string"), F.lit("% of duration)"))
    head = F.concat(row(PROCESSING, "", share), F.lit("\n| --- | --- | --: |"))
    return totals.join(body, key, "left").select(key, F.concat_ws("\n", head, "text").alias("text"))


def params_table(version: str, overrides: dict[str, str]) -> str:
    """The options of a run that differ from their defaults; the same for every recording."""
    lines = ["| | |", "| --- | --- |", f"| App version: | {version} |"]
    return "\n".join([*lines, *(f"| `{flag}` | {value or '—'} |" for flag, value in overrides.items())])


def quoted(text: Column) -> Column:
    return F.regexp_replace(text, "(?m)^", "> ")


def render(
    u: DataFrame, sections: DataFrame, key: str = "conv_id", summary: DataFrame | None = None, recordings: DataFrame | None = None, sources: DataFrame | None = None,
    models: DataFrame | None = None, params: str | None = None, least_ms: int | None = None, language: str = "uk",
) -> DataFrame:
    """(key, markdown) of every recording with rows or in ``recordings`` (see :func:`meta_table`; ``path`` is its title)."""
    bodies = section_bodies(u, sections, key, least_ms).withColumn("_t", F.concat_ws("\n\n", F.concat(F.lit("## "), F.col("title")), F.nullif("body", F.lit(""))))
    out = u.select(key).distinct() if recordings is None else recordings.select(key, "path")
    out = out.join(sc.joined(bodies, [key], "_t", "section", "\\n\\n").withColumnRenamed("text", "body"), key, "left")
    tables = []
    if recordings is not None:
        out = out.join(meta_table(recordings, key, language).withColumnRenamed("text", "meta"), key, "left")
        tables.append("meta")
    out = out.join(participants_table(u, sources, key).withColumnRenamed("text", "people"), key, "left")
    tables.append("people")
    if models is not None:
        out = out.join(models.withColumnRenamed("text", "models"), key, "left")
        tables.append("models")
    if params:
        out = out.withColumn("params", F.lit(params))
        tables.append("params")
    title = F.concat(F.lit("# Transcript: "), F.regexp_extract("path", "([^/]*)/*$", 1)) if recordings is not None else F.lit(None)
    tldr = F.lit(None).cast("string")
    if summary is not None:
        out = out.join(summary.select(key, "summary"), key, "left")
        tldr = F.when(F.length(F.trim("summary")) > 0, F.concat(F.lit("## TL;DR\n\n"), F.trim("summary"), F.lit("\n\n---")))
    head = F.nullif(F.concat_ws("\n> \n", *[quoted(F.col(t)) for t in tables]), F.lit(""))
    return out.select(key, F.concat(F.concat_ws("\n\n", title, head, tldr, F.nullif("body", F.lit(""))), F.lit("\n")).alias("markdown"))
