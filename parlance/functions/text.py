"""Column functions on text: tokens, similarity, guards, normal forms. All are built-in expressions except :func:`token_diff`."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed value: a token of a transcript.
TOKEN = r"[A-Za-zА-Яа-яҐґЄєІіЇї0-9']+"
# Fixed value: a heading that repeats the summary's own.
SUMMARY_HEADING = r"\A\s*(?:#{1,6}\s*TL;?DR\s*\n+|\*\*TL;?DR:?\*\*\s*\n+)"
# Short English back-channel words.
FILLERS = ["yes", "yeah", "yep", "yup", "okay", "ok", "sure", "right", "mhm", "uh-huh", "mm", "hmm", "uh", "um"]
FILLER_MARKS = ".,!?…"
# One- and two-letter words that are not cut ones.
SHORT_WORDS = [
    "і", "у", "в", "з", "до", "на", "не", "це", "та", "як",
    "i", "a", "is", "it", "of", "to", "in", "on", "no", "ok", "um",
    "so", "we", "he", "be", "by", "an", "or", "as", "at", "if", "do",
]
# What the redaction topics are called in prompts.
TOPIC_LABELS = {
    "health": "здоров'я (діагнози, симптоми, медичні процедури, психічне здоров'я)",
    "drugs": "наркотики (вживання, придбання)",
    "alcohol": "алкоголь (звички пиття, анекдоти про сп'яніння)",
    "legal": "правові проблеми",
    "finance": "фінансові деталі (зарплати, борги)",
    "sexual": "сексуальний контент",
}
# Fixed value: the marks that a comparison of wordings leaves out.
MARKS = r"[.,!?;:\"'()—–\-«»…]"


EDGES = r"(?U)^\s+|\s+$"


def tokens(text: Column) -> Column:
    """Array of lower-cased tokens of Latin, Cyrillic, digits and apostrophes; empty for null."""
    return F.coalesce(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda x: F.lower(x)), F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def collapse(text: Column) -> Column:
    """White space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    """Lower case, punctuation dropped, white space collapsed."""
    return collapse(F.regexp_replace(F.lower(text), MARKS, ""))


def strip_artifacts(text: Column) -> Column:
    """Trimmed; without one pair of matching quotes; without a label ``Text: `` in front."""
    t = F.regexp_replace(text, EDGES, "")
    first, last = F.substring(t, 1, 1), F.substring(t, -1, 1)
    quoted = (F.length(t) >= 2) & (first == last) & first.isin('"', "'", "`")
    t = F.when(quoted, F.regexp_replace(F.substring(t, F.lit(2), F.length(t) - 2), EDGES, "")).otherwise(t)
    return F.regexp_replace(t, "^Text: ", "")


def edit_is_safe(original: Column, edited: Column, max_edit: float = 0.5, max_ratio: float = 2.0) -> Column:
    """Whether an edit may replace its original: not empty, at most ``max_ratio`` in length either way, and at most ``max_edit`` of the longer text changed."""
    a, b = F.length(original), F.length(edited)
    longer = F.greatest(a, b)
    return F.coalesce(
        (F.length(F.trim(edited)) > 0)
        & (b <= max_ratio * a)
        & (a <= max_ratio * b)
        & (F.levenshtein(original, edited) <= max_edit * longer),
        F.lit(False),
    )


def without_artifacts(text: str | None) -> str | None:
    """:func:`strip_artifacts` of one text, for stages that go row by row."""
    if text is None:
        return None
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'`":
        text = text[1:-1].strip()
    return text.removeprefix("Text: ")


def is_safe(original: str, edited: str | None, max_edit: float = 0.5, max_ratio: float = 2.0) -> bool:
    """:func:`edit_is_safe` of one pair."""
    import numpy as np

    if not edited or not edited.strip() or len(edited) > max_ratio * len(original) or len(original) > max_ratio * len(edited):
        return False
    a, b = (np.array([ord(c) for c in t]) for t in (original, edited))
    place = np.arange(len(b) + 1)
    row = place.copy()
    for i, x in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        # what an insertion costs runs along the row: a running minimum of cost minus place
        row = np.minimum.accumulate(np.r_[i, best] - place) + place
    return bool(row[-1] <= max_edit * max(len(a), len(b)))


def request_text(text: str, before: str, after: str) -> str:
    """The request for one row, as :func:`parlance.operators.scripts.user_content` has it."""
    from ..operators.scripts import AFTER, BEFORE, CURRENT

    parts = [f"{BEFORE}\n{before}\n"] * bool(before) + [f"{CURRENT}\n{text}"] + [f"\n{AFTER}\n{after}"] * bool(after)
    return "\n".join(parts) if before or after else text


def filler_form(text: Column) -> Column:
    return F.lower(F.btrim(text, F.lit(FILLER_MARKS)))


def is_filler(text: Column) -> Column:
    return filler_form(text).isin(FILLERS)


def is_truncated(token: Column) -> Column:
    """Empty, a hyphen at either end, or at most two letters that are no word. Tokens are lower-cased already."""
    t = token
    return (F.length(t) == 0) | t.startswith("-") | t.endswith("-") | ((F.length(t) <= 2) & ~t.isin(SHORT_WORDS))


def is_name(text: Column) -> Column:
    """At least two characters, the first an upper-case letter."""
    return F.coalesce(F.trim(text).rlike(r"(?s)^\p{Lu}."), F.lit(False))


def label(name: Column, speaker: Column, fallback: str | None = None) -> Column:
    """Name, else speaker, else ``fallback``; empty strings count as missing."""
    empty = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(empty(name), empty(speaker), F.lit(fallback))


def strip_summary_heading(text: Column) -> Column:
    """Without a heading that repeats the summary's own: ``# TL;DR`` or ``**TL;DR**`` on a line by itself."""
    bare = F.regexp_replace(text, "(?i)" + SUMMARY_HEADING, "")
    return F.regexp_replace(bare, r"\A\n+", "")


def topic_labels(topics: list[str], language: str) -> str:
    """Topics as a prompt names them: a comma list in English, else one line each; unknown ones stay."""
    if language.lower().startswith("en"):
        return ", ".join(topics)
    return "\n".join(f"- {TOPIC_LABELS.get(t, t)}" for t in topics)


def short_model_name(name: Column) -> Column:
    """Of ``org/name`` what follows the first slash; of a path its last part."""
    path = F.substring(name, 1, 1).isin(".", "/", "~") | ~F.contains(name, F.lit("/"))
    return F.when(path, F.regexp_extract(name, "([^/]*)/*$", 1)).otherwise(F.regexp_extract(name, "(?s)/(.*)$", 1))


def csv_list(text: Column) -> Column:
    """Trimmed non-blank parts; null stays null."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.regexp_replace(x, EDGES, "")), lambda x: F.length(x) > 0)


def placeholders(text: Column) -> Column:
    """Distinct ``<<name>>`` in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("<<(\\w+)>>"), F.lit(1)))


@F.pandas_udf(ArrayType(StringType()))
def token_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Tokens of either text outside the matching blocks of a sequence matcher; no built-in does this."""
    from difflib import SequenceMatcher

    def one(x: str | None, y: str | None) -> list[str]:
        x, y = (x or "").split(), (y or "").split()
        out: list[str] = []
        for kind, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            if kind != "equal":
                out += x[i:j] + y[k:m]
        return out

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def edit_category(a: Column, b: Column, diff: Column) -> Column:
    """unchanged, cosmetic, proper_noun_fix or substantive_rewrite."""
    proper = F.exists(diff, lambda t: t.rlike("[A-Za-z]"))
    return (
        F.when(collapse(a) == collapse(b), "unchanged")
        .when((normalize(a) == normalize(b)) | (F.size(diff) == 0), "cosmetic")
        .when(proper, "proper_noun_fix")
        .otherwise("substantive_rewrite")
    )
