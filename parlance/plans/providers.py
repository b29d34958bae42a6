"""Model calls behind one interface, and the stages around them.

A provider is a function from a batch of requests (pandas Series of text) to replies; it runs in Arrow batches, loads its model
once for each worker, and never fails a task: every reply is ``STRUCT<value STRING, error STRING>``. Stages hold replies in a written table
before they use them twice, since a lazy plan would call the model again. A provider's loader may have ``health_check``, which a stage
runs on the driver before any task starts: a model that is missing fails there, at once, and is never fetched on the way."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import aggregates as ag
from ..operators import dedup as dd
from ..operators import redact as rd
from ..operators import scripts as sc
from ..operators import segments as sg
from ..operators import sequences as sq
from ..sources.scratch import held

REPLY = "value string, error string"
Provider = Callable[[], Callable[[str], str]]


class ProviderError(RuntimeError):
    """A model that can't be used: not installed, not cached, or not answering."""


def ready(provider: Provider) -> Provider:
    """The provider, after its ``health_check`` if it has one; what that raises is a :class:`ProviderError`."""
    try:
        getattr(provider, "health_check", lambda: None)()
    except Exception as e:
        raise ProviderError(f"{getattr(provider, '__name__', provider)}: {e}") from e
    return provider


def call(provider: Provider, request: Column) -> Column:
    """Replies to a column of requests; null requests get null replies without a call."""
    ready(provider)

    @F.pandas_udf(REPLY)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = provider()
        for requests in batches:
            rows = []
            for r in requests:
                try:
                    rows.append((None, None) if r is None else (model(r), None))
                except Exception as e:  # one bad reply must not cost a task of good ones
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["value", "error"])

    return run(request)


def recorded(replies: dict[str, str]) -> Provider:
    """Replies from a table of requests; unknown requests are errors."""
    return lambda: replies.__getitem__


def rules(*pairs: tuple[str, str]) -> Provider:
    """Rewrites by regular expressions, in order: a stand-in for a proofreading model."""

    def load():
        import re

        compiled = [(re.compile(a), b) for a, b in pairs]

        def run(text: str) -> str:
            for a, b in compiled:
                text = a.sub(b, text)
            return text

        return run

    return load


def proofread(u: DataFrame, provider: Provider, least: int = 10) -> DataFrame:
    """``u`` with corrected ``content`` where the reply is a safe edit; short rows are not sent. Adds ``sent``."""
    out = u.withColumn("sent", F.length(F.trim("content")) >= least)
    out = out.withColumn("_r", call(provider, F.when(F.col("sent"), F.col("content"))))
    reply = tx.strip_artifacts(F.col("_r.value"))
    return out.withColumn("content", F.when(tx.edit_is_safe(F.col("content"), reply), reply).otherwise(F.col("content"))).drop("_r")


def proofread_in_order(u: DataFrame, provider: Provider, key: str = "conv_id", context: int = 3, least: int = 10) -> DataFrame:
    """As :func:`proofread`, with corrected rows before and raw rows after each row as its context: sequential in a recording.

    Grouped pandas asks for one row after another; whether a reply may replace its row is judged there by the same rules, as the next row's
    context depends on it. (key, seq, content, llm_calls): what a recording's calls number is on each of its rows."""
    ready(provider)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model, pdf = provider(), pdf.sort_values("seq")
        texts, speakers, done, calls = pdf["content"].fillna("").tolist(), pdf["speaker"].tolist(), [], 0
        lines = lambda a, b, of: "\n".join((f"[{w}] " if isinstance(w, str) and w else "") + t for w, t in zip(speakers[a:b], of[a:b], strict=False))
        for i, t in enumerate(texts):
            reply = None
            if len(t.strip()) >= least:
                calls += 1
                before, after = (lines(max(0, i - context), i, done), lines(i + 1, i + 1 + context, texts)) if context else ("", "")
                with contextlib.suppress(Exception):  # one bad reply leaves its row as it was
                    reply = model(tx.request_text(t, before, after))
            reply = tx.without_artifacts(reply)
            done.append(reply if tx.is_safe(t, reply) else t)
        return pd.DataFrame({key: pdf[key], "seq": pdf["seq"], "content": done, "llm_calls": calls})

    return u.select(key, "seq", "speaker", "content").groupBy(key).applyInPandas(run, f"{key} long, seq long, content string, llm_calls long")


SECTION_REPLY = "struct<sections:array<struct<title:string,start_ms:bigint,end_ms:bigint>>>"


def valid_sections(reply: Column, first_ms: Column, last_ms: Column, least: int = 2, most: int = 7, exact: bool = True) -> Column:
    """Sections of a JSON reply in time order, or null: counts, titles, times and, if ``exact``, bounds without gaps."""
    s = F.array_sort(F.from_json(reply, SECTION_REPLY)["sections"], lambda a, b: F.when(a["start_ms"] < b["start_ms"], -1).when(a["start_ms"] > b["start_ms"], 1).otherwise(0))
    good = F.size(s).between(least, most) & F.forall(s, lambda x: (F.length(F.trim(x["title"])) > 0) & (x["end_ms"] > x["start_ms"]))
    if exact:
        joined = F.forall(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.element_at(s, i)["end_ms"] == F.element_at(s, i + 1)["start_ms"])
        good = good & (F.element_at(s, 1)["start_ms"] == first_ms) & (F.element_at(s, -1)["end_ms"] == last_ms) & ((F.size(s) == 1) | joined)
    return F.when(F.coalesce(good, F.lit(False)), s)


def fallback_section(u: DataFrame, key: str = "conv_id", language: str = "uk") -> DataFrame:
    """(key, title, start_ms, end_ms): one section over all rows of a recording, speakers or not, from its first start to its last end."""
    title = F.lit("Conversation" if language.lower().startswith("en") else "Розмова")
    return u.groupBy(key).agg(F.min_by("start_ms", "seq").alias("start_ms"), F.max_by("end_ms", "seq").alias("end_ms")).select(key, title.alias("title"), "start_ms", "end_ms")


CHUNK_FROM, CHUNK_ROWS, CHUNK_OVERLAP, CHUNK_EXTEND, CHUNK_SECTIONS = 60, 35, 2, 5, 4


def structure(
    u: DataFrame, provider: Provider | None, key: str = "conv_id", language: str = "uk", chunk_from: int = CHUNK_FROM, size: int = CHUNK_ROWS, overlap: int = CHUNK_OVERLAP,
    extend: int = CHUNK_EXTEND, most: int = 7,
) -> DataFrame:
    """(key, title, start_ms, end_ms): the provider's sections of each recording, or one section over all of it.

    Recordings of fewer than ``chunk_from`` speakers' rows are asked for at once, and a reply counts only if its sections cover them without
    gaps. Longer ones are asked for in overlapping chunks; replies of 1 to ``CHUNK_SECTIONS`` sections count, and are reconciled into
    at most ``most``. A recording without speakers has no sections."""
    talk = u.where("speaker IS NOT NULL")
    bounds = talk.groupBy(key).agg(F.min_by("start_ms", "seq").alias("a"), F.max_by("end_ms", "seq").alias("b"), F.count("*").alias("n"))
    whole = fallback_section(u, key, language).join(bounds.select(key), key, "left_semi")
    if provider is None:
        return whole
    long = talk.join(bounds.where(F.col("n") >= chunk_from).select(key), key, "left_semi")
    chunks = sq.speaker_chunks(long, key, size, overlap, extend).select(key, "chunk", "first_seq", "last_seq")
    # a row lies in one chunk, or two where they overlap
    dealt = talk.join(bounds.where(F.col("n") < chunk_from).select(key), key, "left_semi").withColumn("chunk", F.lit(-1).cast("long"))
    dealt = dealt.unionByName(long.join(chunks, key).where("seq BETWEEN first_seq AND last_seq").drop("first_seq", "last_seq"))
    asked = sc.script(dealt.withColumn("_k", F.struct(key, "chunk")), "_k").select(f"_k.{key}", "_k.chunk", "text")
    replies = held(asked.withColumn("_r", call(provider, F.col("text"))["value"]).join(bounds, key), "structure")
    exact = replies.where("chunk < 0").select(key, F.explode(valid_sections(F.col("_r"), F.col("a"), F.col("b"), most=most)).alias("_s")).select(key, "_s.*")
    loose = replies.where("chunk >= 0").select(key, F.explode(valid_sections(F.col("_r"), F.col("a"), F.col("b"), 1, CHUNK_SECTIONS, exact=False)).alias("_s")).select(key, "_s.*")
    fused = sq.reconcile(loose, bounds.select(key, F.col("a").alias("total_start_ms"), F.col("b").alias("total_end_ms")), key, most)
    found = held(exact.unionByName(fused.select(exact.columns)), "sections")
    return found.unionByName(whole.join(found.select(key).distinct(), key, "left_anti"))


def redact_stage(u: DataFrame, sections: DataFrame, provider: Provider, policy: str = "placeholder", topics: list[str] | None = None, key: str = "conv_id") -> DataFrame:
    """Asks for ranges to redact in every section and applies them; an empty list of topics turns the stage off."""
    if topics == []:
        return u.select(key, "seq", "start_ms", "end_ms", "speaker", "content")
    script = sc.indexed(u, sections, key).withColumnRenamed("text", "script")
    kind = "struct<redactions:array<struct<start_idx:bigint,end_idx:bigint,topic:string,rationale:string>>>"
    found = script.select(key, "section", F.explode(F.from_json(call(provider, F.col("script"))["value"], kind)["redactions"]).alias("_r"))
    ranges = found.select(key, "section", "_r.start_idx", "_r.end_idx", "_r.topic").where("start_idx IS NOT NULL AND end_idx >= start_idx AND topic IS NOT NULL")
    return rd.redact(u, sections, ranges, policy, key)


def identify(u: DataFrame, provider: Provider, key: str = "conv_id", prompt: str = "") -> DataFrame:
    """(key, speaker, name, source) from what speakers say at first; conflicts go to the surest. A reply that is no object counts as unsure."""
    said = ag.snippets(u, key).join(ag.first_appearance(u, key).select(key, "speaker", "first_ms"), [key, "speaker"])
    request = F.concat(F.lit(prompt), F.col("snippet"))
    reply = said.withColumn("_r", F.from_json(call(provider, request)["value"], "struct<name:string,confidence:string>"))
    confidence = F.coalesce(F.col("_r.confidence"), F.lit("low"))
    named = ag.resolve_names(reply.select(key, "speaker", "first_ms", F.col("_r.name").alias("name"), confidence.alias("confidence")), key)
    return named.withColumn("source", F.lit("identified"))


FALLBACK_LANGUAGE = "uk"


def detect_language(turns: DataFrame, recordings: DataFrame, provider: Provider, key: str, request: Column, least_ms: int = 2000, least_second: float = 0.05) -> DataFrame:
    """(key, language, top1, p1, top2, p2, agreement, n_attempts) of every recording (key).

    The provider is asked about the longest turn and the longest one of another speaker (turns: key, turn_id, label, start_ms, end_ms);
    its reply is a JSON object of probabilities. The surer attempt wins. ``language`` is the fallback, and the rest null, where no turn is
    long enough or the first attempt has no probabilities; a second one without is left out."""
    attempts = sq.rank_attempts(turns, key, least_ms)
    asked = attempts.join(turns.drop("label"), [key, "turn_id"]).withColumn("_r", call(provider, request)["value"])
    probs = held(asked.select(key, "attempt", F.explode(F.from_json("_r", "map<string,double>")).alias("label", "prob")), "language")
    first = probs.where("attempt = 1").select(key).distinct()
    top = ag.top_two(probs.join(first, key, "left_semi"), [key, "attempt"], least=least_second)
    won = ag.vote(top.select(key, "attempt", F.col("top1").alias("label"), F.col("p1").alias("prob")), key)
    best = top.groupBy(key).agg(F.max(F.struct("p1", (-F.col("attempt")).alias("_a"), "top1", "top2", "p2")).alias("_b"), F.count("*").alias("n_attempts"))
    told = best.join(won.select(key, "agreement"), key).select(key, "_b.top1", "_b.p1", "_b.top2", "_b.p2", "agreement", "n_attempts")
    return recordings.select(key).join(told, key, "left").select(
        key, F.coalesce("top1", F.lit(FALLBACK_LANGUAGE)).alias("language"), "top1", "p1", "top2", "p2", "agreement", "n_attempts"
    )


def transcribe(chunks: DataFrame, provider: Provider, request: Column, key: str = "conv_id") -> DataFrame:
    """(key, chunk, seq, start_ms, end_ms, content): segments of overlapping chunks (key, chunk, start_ms, end_ms ...) as one transcript.

    The provider's reply to a chunk is a JSON array of segments with seconds from the chunk's start; blank ones go, times are shifted by
    the chunk's start, and what a chunk repeats of the one before it is dropped."""
    kind = "array<struct<start:double,end:double,text:string>>"
    replies = held(chunks.select(key, "chunk", F.col("start_ms").alias("_from"), call(provider, request)["value"].alias("_r")), "transcribe")
    raw = replies.select(key, "chunk", "_from", F.posexplode(F.from_json("_r", kind)).alias("seq", "_s")).select(key, "chunk", "_from", "seq", "_s.*")
    segs = sg.parse_segments(raw)
    ms = lambda c: F.bround(F.col(c) * 1000, 0).cast("long") + F.col("_from")
    return dd.dedup_chunks(segs.select(key, "chunk", F.col("seq").cast("long").alias("seq"), ms("start").alias("start_ms"), ms("end").alias("end_ms"), "content"), key)


def summarise(sections: DataFrame, provider: Provider, key: str = "conv_id", width: int = 7) -> DataFrame:
    """(key, summary): section texts (key, seq, title, content) to one each, then groups of ``width`` to one, until ``width`` or fewer are left, and a
    final call over those. A single section's summary is the recording's. Each level is held, so no request is sent twice."""
    level = held(sections.select(key, "seq", "title", tx.strip_summary_heading(call(provider, F.col("content"))["value"]).alias("content")).where("content IS NOT NULL"), "summary")
    while level.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > width).limit(1).count():
        many = level.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > width).select(key)
        rest = level.join(many, key, "left_anti")
        grp = F.floor((F.expr(f"row_number() OVER (PARTITION BY {key} ORDER BY seq)") - 1) / width)
        cut = level.join(many, key, "left_semi").withColumn("_g", grp)
        sizes = cut.groupBy(key, "_g").agg(F.count("*").alias("n"), F.min("title").alias("title"), F.min("content").alias("one"))
        texts = sc.blocks(cut.withColumn("_k", F.struct(key, "_g")), "_k").select(f"_k.{key}", "_k._g", "text").join(sizes, [key, "_g"])
        asked = texts.withColumn("_r", call(provider, F.when(F.col("n") > 1, F.col("text")))["value"])
        one = asked.select(key, F.col("_g").alias("seq"), "title", F.when(F.col("n") > 1, tx.strip_summary_heading(F.coalesce("_r", "text"))).otherwise(F.col("one")).alias("content"))
        level = held(rest.unionByName(one), "summary")
    sizes = level.groupBy(key).agg(F.count("*").alias("n"), F.min("content").alias("one"))
    last = sc.blocks(level, key).join(sizes, key)
    asked = last.withColumn("_r", call(provider, F.when(F.col("n") > 1, F.col("text")))["value"])
    return asked.select(key, F.when(F.col("n") > 1, tx.strip_summary_heading(F.coalesce("_r", "text"))).otherwise(F.col("one")).alias("summary"))


__all__ = ["ProviderError", "call", "detect_language", "fallback_section", "identify", "proofread", "proofread_in_order", "ready", "recorded", "redact_stage", "rules", "sq", "structure", "summarise", "transcribe", "valid_sections"]
