"""A whole run over many recordings: language, split and merge, proofreading, names, sections, redaction, summary, Markdown.

Stages follow :class:`parlance.plans.options.Options`; each is a DataFrame over all recordings and is held as a table (in ``options.dump``
under its name, or in the shared folder), so nothing runs twice and a run can go on from the stages it has. A stage without a provider falls
back to what needs no model."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates as ag
from ..operators import intervals as iv
from ..operators import scripts as sc
from ..operators import splits as sp
from ..sources import dumps
from ..sources.scratch import held
from . import providers as pv
from . import render as rn
from .options import Options

VERSION = "2"


@dataclass(frozen=True)
class Inputs:
    """recordings (key, path, started_at, duration_s), turns (key, turn_id, label, start_ms, end_ms), segments (key, seq, start_ms, end_ms,
    content) and words (key, seq, i, token, start_ms, end_ms, probability)."""

    recordings: DataFrame
    turns: DataFrame
    segments: DataFrame
    words: DataFrame


@dataclass
class Run:
    """The stages' tables by name, and the seconds each took."""

    options: Options
    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    elapsed: dict[str, float] = field(default_factory=dict)

    def keep(self, stage: str, make) -> DataFrame:
        """The stage's table: the dumped one if the run is resumed and has it, else what ``make`` gives, written."""
        began = time.perf_counter()
        table = dumps.read_stage(self.spark, self.options.dump, stage) if self.options.resume else None
        if table is None:
            table = dumps.write_stage(make(), self.options.dump, stage) if self.options.dump else held(make(), stage)
        self.tables[stage] = table
        self.elapsed[stage] = time.perf_counter() - began
        return table


def numbered(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long") - 1)


def merge(inputs: Inputs, options: Options, key: str) -> DataFrame:
    """(key, seq, start_ms, end_ms, content, speaker): segments cut where the speaker changes, each with the speaker it overlaps most."""
    segs = inputs.segments.select(key, "seq", "start_ms", "end_ms", "content").withColumn("fragment", F.lit(0).cast("long")).withColumn("hint", F.lit(None).cast("string"))
    if options.split_on_turns:
        refine = {"filler_tie_ms": options.filler_tie_ms, "deadband_ms": options.deadband_ms}
        segs = sp.split_segments(
            inputs.segments.select(key, "seq", "start_ms", "end_ms", "content"), inputs.words, inputs.turns, key, "seq", "turn_id", "label", options.least_fragment_ms, options.split_threshold_ms, **refine
        )[0].drop("how")
    segs = numbered(segs.withColumnRenamed("seq", "_s"), key, ["start_ms", "_s", "fragment"], "seq").drop("_s", "fragment")
    owned = iv.max_overlap_owner(segs, inputs.turns, key, "seq", "turn_id", "label", hint="hint")
    return owned.select(key, "seq", "start_ms", "end_ms", "content", F.col("owner").alias("speaker"))


def run(inputs: Inputs, options: Options, providers: dict[str, pv.Provider] | None = None, key: str = "conv_id") -> Run:
    """Runs every stage; ``providers`` may have language, proofread, identify, structure, redact and summary."""
    known, out = providers or {}, Run(options, inputs.recordings.sparkSession)
    language = options.language or pv.FALLBACK_LANGUAGE

    def spoken() -> DataFrame:
        if options.language is None and "language" in known:
            found = pv.detect_language(inputs.turns, inputs.recordings, known["language"], key, F.to_json(F.struct(key, "turn_id", "start_ms", "end_ms")))
        else:
            blank = {c: F.lit(None).cast(t) for c, t in (("top1", "string"), ("p1", "double"), ("top2", "string"), ("p2", "double"), ("agreement", "string"))}
            found = inputs.recordings.select(key, F.lit(language).alias("language")).withColumns(blank).withColumn("n_attempts", F.lit(0).cast("long"))
        return inputs.recordings.drop("language").join(found, key)

    recordings = out.keep("meta", spoken)
    u = out.keep("merge", lambda: merge(inputs, options, key))

    def proofread() -> DataFrame:
        if options.proofread_context:
            done = pv.proofread_in_order(u, known["proofread"], key, options.proofread_context)
            return u.drop("content").join(done.select(key, "seq", "content"), [key, "seq"])
        return pv.proofread(u, known["proofread"]).drop("sent")

    if options.proofread and "proofread" in known:
        u = out.keep("proofread", proofread)

    def names() -> DataFrame:
        if options.names:
            given = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(n).alias("name")) for i, n in enumerate(options.names)]))
            return ag.given_names(u, recordings.select(key, given.alias("_n")).select(key, "_n.*"), key)
        if "identify" in known:
            return pv.identify(u, known["identify"], key)
        return u.select(key, "speaker", F.lit("").alias("name"), F.lit("").alias("source")).limit(0)

    found = out.keep("identify", names)
    named = ag.apply_names(u, found, key)

    def sections() -> DataFrame:
        made = pv.structure(named, known.get("structure"), key, language) if options.structure else pv.fallback_section(named, key, language)
        return numbered(made, key, ["start_ms", "end_ms"], "i")

    parts = out.keep("structure", sections)
    if options.redact_topics != () and "redact" in known:
        # a muted row has no name; those of the others come back by speaker
        u = out.keep("safe_speech", lambda: pv.redact_stage(named, parts, known["redact"], options.redact_policy, None if options.redact_topics is None else list(options.redact_topics), key))
        named = ag.apply_names(u, found, key)
    summary = None
    if options.summary and "summary" in known:

        def summarised() -> DataFrame:
            inside = rn.in_sections(named, parts, key).withColumn("_k", F.struct(key, "section", "title"))
            texts = sc.dialogue(inside.select("_k", "seq", "start_ms", "end_ms", "speaker", "name", "content"), "_k", silence=True)
            return pv.summarise(texts.select(f"_k.{key}", F.col("_k.section").alias("seq"), "_k.title", F.col("text").alias("content")), known["summary"], key)

        summary = out.keep("summary", summarised)

    def document() -> DataFrame:
        meta = recordings.withColumn("user_context", F.lit(options.user_context).cast("string"))
        topics = F.lit(None).cast("array<string>") if options.redact_topics is None else F.array(*map(F.lit, options.redact_topics)).cast("array<string>")
        overrides = dict((x.split(" ", 1) + [""])[:2] for x in options.changed())
        sources = ag.name_sources(u, found, key)
        return rn.render(
            named, parts, key, summary, meta.withColumn("topics", topics), sources, stage_table(out, recordings, key), rn.params_table(VERSION, overrides), options.least_silence_ms, language
        )

    out.keep("render", document)
    return out


def stage_table(out: Run, recordings: DataFrame, key: str) -> DataFrame:
    """(key, text): the run's stages with the models that ran in them and the seconds they took, for every recording of the run."""
    rows = [(i, s, model_name(out.options, s), float(t)) for i, (s, t) in enumerate(out.elapsed.items())]
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("seq"), F.lit(s).alias("stage"), F.lit(m).alias("model"), F.lit(t).alias("elapsed")) for i, s, m, t in rows]))
    timings = recordings.select(key, each.alias("_t")).select(key, "_t.*")
    totals = recordings.select(key, F.lit(sum(r[3] for r in rows)).alias("total"), "duration_s")
    return rn.models_table(timings, timings.select(key, "model").distinct().withColumn("elapsed", F.lit(0.0)), totals, key)


def model_name(options: Options, stage: str) -> str:
    """Short name of the model that a stage runs with: its own, else the run's, else ``none``."""
    spec = options.model_of(stage)
    if not spec:
        return "none"
    return spec.split("/", 1)[1] if "/" in spec and spec[0] not in "./~" else spec.rstrip("/").rsplit("/", 1)[-1]


__all__ = ["Inputs", "Run", "merge", "model_name", "run", "stage_table"]
