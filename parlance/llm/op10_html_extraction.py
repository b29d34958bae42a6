"""Main text of web pages: a host suffix array over page token streams judges every block, and the markup's own word checks its verdicts.

Each page becomes blocks of text in page order, and these two token streams: what a plain ``article`` or ``main`` holds (the core), and the rest;
without a plain core all is one stream. The suffix arrays of a host (one over its cores, one over the rest), cut at ``RUN`` tokens, find the runs of
``RUN`` tokens or more that occur in ``PAGES`` distinct streams or more. Streams that are equal count once. A block that such runs cover at
least by half is boilerplate by the array. The markup is the exact check that follows:

* Elements whose content is no text (scripts, styles ...) and elements that the standard sets apart from the main content (``nav``,
  ``footer``, ``aside``, controls of forms, roles such as ``navigation``) give ``chrome``, which goes whatever the array says.
* A core is plainly the page's main content if it has an ``h1``, or at least as many tokens as the paragraphs outside. What lies outside of it goes.
  Inside, a block that the array leaves is kept. One that it calls boilerplate goes only if no paragraph, heading, list, quotation or table
  holds it (``HOLDERS``) and less than half of the core is repeated: articles that a host repeats, and passages that its articles share, are
  text, while a notice in a bare ``div`` of every article is none.
* Without a plain core, what the array calls boilerplate goes.

If all of a page's blocks would go, all that are not chrome stay. The suffix array alone cannot give right results: an article
that a host repeats would vanish, and an advert that occurs once would stay. The README has figures. ``extract(pages, core=False)`` takes no page to have a core.

A form or a ``header`` is chrome unless it wraps the core. Class names decide nothing, but for ``COMMENTS`` and ``ADVERTS``, which
no element names; they too do not count on an element that wraps the core, nor does an ``article`` inside an ``article`` (the standard's
element for reader comments) belong to the outer one.

A suffix travels as ``BITS`` bits of a hash of its host and first ``RUN`` tokens, in sorted order, many pages at a time, with the number of streams
that have it (``PAGES`` at most, which settles the question); streams are counted by suffix over the whole host, whatever its size,
and no task holds a host. The runs found go back to all pages. A page is read in time linear in its length.

Defined results: null, empty and text-free pages give an empty text; broken markup (elements never closed, end tags without a start, a
page cut off, quotes that never end) is read as far as it goes; repeated rows each get a row; a null URL is a host of its own; an empty table
gives an empty result; further columns, whatever their names, do not matter.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_in, id_out, load, written
from .op01_minhash_forest import mixed
from .op04_url_filters import host_path

NAME = "op10_html_extraction"
RUN, PAGES = 8, 3
SALTS = 16
#: Bits of a suffix's hash; suffixes that a task sorts at once and that a bucket of them holds; rows of a table that Spark broadcasts.
BITS, SORTED, NEAR = 48, 4_000_000, 1_000_000
#: Bits of the filter that drops suffixes which are no run found, where those are too many to broadcast.
FILTER = 28
#: Pages that a worker takes at a time, and their characters and tokens at most (or one page).
ROWS, CHARS, TOKENS = 500, 32_000_000, 1_000_000

OPENING = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
QUOTE_OR_END = re.compile("['\">]")
#: Elements whose content is no markup; it ends at their own end tag alone.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that the standard sets apart from the main content.
APART = {"nav", "footer", "aside", "menu", "button", "select", "dialog", "template", "svg", "canvas", "object", "audio", "video", "head", "datalist", "map"}
#: These too, unless they wrap the core.
WRAPPERS = {"form", "header", "fieldset"}
CORE = {"article", "main"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img"}
OPTIONAL_END = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: What these hold in a core is text, repeated or not.
HOLDERS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "table", "figcaption"}
COMMENTS = {"comment", "comments", "commentlist", "disqus"}
ADVERTS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsored"}
ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|$)""", re.I)
WORD_PARTS = re.compile(r"[^a-z0-9]+")
RAW_ENDS = {name: re.compile(f"</{name}\\b[^>]*>", re.I) for name in RAW}

PLAIN, SOFT, HARD = 0, 1, 2


def kind_of(name: str, attributes: str) -> int:
    """HARD for what is never main content, SOFT for what is not unless it wraps the core."""
    if name in APART:
        return HARD
    kind = SOFT if name in WRAPPERS else PLAIN
    if not attributes or name in ("html", "body") or name in CORE:
        return kind
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return HARD
        if key == "role" and value in ROLES or key in ("class", "id") and (COMMENTS | ADVERTS).intersection(WORD_PARTS.split(value)):
            kind = SOFT
    return kind


class Reader:
    """Finds the ends of tags; remembers where the last of each mark is, so that no text is searched twice in vain."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "'\">"}

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag, outside quotes if they are closed; -1 if the page ends before."""
        start = at
        while at <= self.last[">"]:
            m = QUOTE_OR_END.search(self.page, at)
            if m is None or m[0] == ">":
                return -1 if m is None else m.start()
            if m.start() >= self.last[m[0]]:
                break  # a quote that never ends is no quote
            at = self.page.find(m[0], m.end()) + 1
        return self.page.find(">", start) if start <= self.last[">"] else -1


Block = tuple[str, str, bool]


def blocks(page: str | None) -> list[Block]:
    """(kind, text, in a paragraph) of a page's blocks in order: ``core``, ``open`` or ``chrome``. Texts are decoded and their white space is
    single spaces. The kind of the first heading of a core is ``core-h1``, of other blocks in ``HOLDERS`` there ``core-held``."""
    if not isinstance(page, str) or not page:
        return []
    reader = Reader(page)
    out: list[tuple[str, int, str, bool]] = []  # (kind, innermost soft frame, text, paragraph)
    text: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # (name, kind, opens the core)
    names: Counter = Counter()
    hard = core = paragraphs = nested = heading = held = number = 0
    soft: list[int] = []  # open soft frames
    wraps: set[int] = {0}  # soft frames that turned out to wrap a core; then all around them do too
    at = 0

    def close_block() -> None:
        if text:
            joined = " ".join(htmllib.unescape("".join(text)).split())
            if joined:
                kind = "chrome" if hard or nested else ("core-h1" if heading else "core-held" if held else "core") if core else "open"
                out.append((kind, soft[-1] if soft else 0, joined, paragraphs > 0))
            text.clear()

    def push(name: str, kind: int, opens: bool) -> None:
        nonlocal hard, core, paragraphs, nested, heading, held, number
        number += 1
        if opens:
            nested += name == "article" and any_article()
            for k in reversed(soft):
                if k in wraps:
                    break
                wraps.add(k)
            core += 1
        hard += kind == HARD
        if kind == SOFT:
            soft.append(number)
        paragraphs += name == "p"
        heading += name == "h1"
        held += name in HOLDERS
        stack.append((name, kind, opens))
        names[name] += 1

    def any_article() -> bool:
        return names["article"] > 0

    def pop() -> None:
        nonlocal hard, core, paragraphs, nested, heading, held
        name, kind, opens = stack.pop()
        names[name] -= 1
        core -= opens
        nested -= opens and name == "article" and any_article()
        hard -= kind == HARD
        if kind == SOFT:
            soft.pop()
        paragraphs -= name == "p"
        heading -= name == "h1"
        held -= name in HOLDERS

    while True:
        m = OPENING.search(page, at)
        if not m:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        name = m[2]
        if name is None:
            end = page.find("-->", m.end()) + 2 if m[0] == "<!--" else page.find(">", m.end())
            if end < m.end():
                break  # a comment that never ends
            at = end + 1
            continue
        end = reader.tag_end(m.end())
        if end < 0:
            break  # a tag that the page's end cut off
        attributes, at, name = page[m.end() : end], end + 1, name.lower()
        if name in INLINE:
            if name == "br":
                text.append(" ")
            continue
        close_block()
        if m[1]:
            if names[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in RAW:
            closing = RAW_ENDS[name].search(page, at)
            at = closing.end() if closing else len(page)
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name in OPTIONAL_END and stack and stack[-1][0] == name:
            pop()  # its end tag may be left out
        push(name, kind_of(name, attributes), name in CORE or 'role="main"' in attributes.lower())
    close_block()
    return [(kind if frame in wraps else "chrome", t, p) for kind, frame, t, p in out]


def plain_core(found: list[Block]) -> list[str] | None:
    """The core's blocks if the markup says plainly that they are the main content."""
    core = [t for kind, t, _ in found if kind.startswith("core")]
    if not core:
        return None
    if any(kind == "core-h1" for kind, _, _ in found):
        return core
    size = lambda ts: sum(t.count(" ") + 1 for t in ts)
    outside = size([t for kind, t, p in found if kind == "open" and p])
    return core if size(core) >= outside else None


def repeated(streams: list[list[int]], run: int = RUN, pages: int = PAGES) -> list[np.ndarray]:
    """For each stream, which tokens lie in a run of ``run`` tokens that ``pages`` distinct streams share.

    A suffix array cut at ``run`` tokens: prefix doubling ranks suffixes by their first 1, 2, 4 ... tokens. Longer
    repeated substrings are unions of such runs. Streams that are equal as a whole count once."""
    lengths = [len(s) for s in streams]
    cover = [np.zeros(n, bool) for n in lengths]
    if len(streams) < pages or max(lengths, default=0) < run:
        return cover
    same: dict[tuple, int] = {}
    page = np.repeat([same.setdefault(tuple(s), k) for k, s in enumerate(streams)], [n + run for n in lengths])
    joined: list[int] = []
    for k, s in enumerate(streams):
        joined += s
        joined += [-1 - run * k - j for j in range(run)]  # separators that occur once
    rank = np.unique(np.array(joined, np.int64), return_inverse=True)[1].astype(np.int64)
    done = 1
    while done < run:
        step = min(done, run - done)
        ahead = np.r_[rank[step:], np.zeros(step, np.int64)]
        rank = np.unique(rank * (len(rank) + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        done += step
    order = np.argsort(rank, kind="stable")
    key = np.unique(np.stack([rank[order], page[order]]), axis=1)[0]
    shared = np.bincount(key, minlength=rank.max() + 1) >= pages
    hit = np.convolve(shared[rank], np.ones(run, int))[: len(rank)] > 0
    at = 0
    for k, n in enumerate(lengths):
        cover[k] = hit[at : at + n]
        at += n + run
    return cover


def parts_of(found: list[Block], core: bool = True) -> list[int]:
    """For each block 1 if it lies in a plain core, else 0."""
    own = core and plain_core(found) is not None
    return [int(own and kind.startswith("core")) for kind, _, _ in found]


def settle(pages: list[list[Block]], run: int = RUN, least: int = PAGES, core: bool = True) -> list[str]:
    """Main text of each page of one host: the reading that :func:`extract` distributes."""
    ids: dict[str, int] = {}
    tokens = [[[ids.setdefault(w, len(ids)) for w in t.split(" ")] for _, t, _ in found] for found in pages]
    parts = [parts_of(found, core) for found in pages]
    arrays = [repeated([sum((ts for ts, x in zip(page, at, strict=True) if x == part), []) for page, at in zip(tokens, parts, strict=True)], run, least) for part in (0, 1)]
    out = []
    for k, (found, at, page) in enumerate(zip(pages, parts, tokens, strict=True)):
        seen, covers = [0, 0], []
        for x, ts in zip(at, page, strict=True):
            covers.append(arrays[x][k][seen[x] : seen[x] + len(ts)])
            seen[x] += len(ts)
        out.append("\n".join(checked([(kind, t) for kind, t, _ in found], at, [int(c.sum()) for c in covers], [len(c) for c in covers])))
    return out


def checked(found: list[tuple[str, str]], parts: list[int], hits: list[int], sizes: list[int]) -> list[str]:
    """Blocks that make up a page's text, from the array's verdicts (how many of a block's tokens are repeated) and the markup's word."""
    left = [2 * h < n for h, n in zip(hits, sizes, strict=True)]
    if any(parts):
        inner = [k for k, x in enumerate(parts) if x]
        copy = 2 * sum(hits[k] for k in inner) >= sum(sizes[k] for k in inner)
        return [found[k][1] for k in inner if left[k] or copy or found[k][0] != "core"]
    free = [k for k, (kind, _) in enumerate(found) if kind != "chrome"]
    return [found[k][1] for k in free if left[k]] or [found[k][1] for k in free]


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        self[word] = out = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


def suffixes(streams: list[list[str]], salts: list[int], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, its stream, its place among all tokens) of every suffix of ``run`` tokens or more: a hash of the stream's salt and its first ``run`` tokens."""
    lengths = np.array([len(x) for x in streams], np.int64)
    total = int(lengths.sum())
    if total < run:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.fromiter(map(Hashes().__getitem__, chain.from_iterable(streams)), np.uint64, total)
    stream = np.repeat(np.arange(len(streams)), lengths)
    place = np.flatnonzero(np.arange(total) + run <= np.cumsum(lengths)[stream])
    key = np.array(salts, np.uint64)[stream[place]]
    for k in range(run):
        key = mixed(key ^ h[place + k])
    return key >> np.uint64(64 - BITS), stream[place], place


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, each with its counts added up, ``PAGES`` at most."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.minimum(np.add.reduceat(counts, starts), PAGES) if len(starts) else counts


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as bytes of their differences, the lowest of all first, and their counts."""
    import zstandard

    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.T).tobytes() + counts.astype(np.uint8).tobytes())


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(flat) // (BITS // 8 + 1)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, : BITS // 8] = flat[: n * (BITS // 8)].reshape(BITS // 8, n).T
    return np.cumsum(steps.view("<u8")[:, 0].astype(np.uint64), dtype=np.uint64), flat[n * (BITS // 8) :].astype(np.int64)


KINDS = {"chrome": "c", "open": "o", "core": "b", "core-h1": "h", "core-held": "t"}
NAMES = {v: k for k, v in KINDS.items()}
SCHEMA = "page_id long, url string, text string, n_chars long"
PARSED = "row long, page_id long, url string, host string, packed binary, outer long, inner long, tokens long"


class Page:
    """A parsed page as it travels: kinds and parts of its blocks, and their texts."""

    def __init__(self, packed: bytes):
        marks, *self.texts = packed.decode("utf-8", "surrogatepass").split("\n")
        self.parts = [int(m.isupper()) for m in marks]
        self.kinds = [NAMES[m.lower()] for m in marks]
        if not marks:
            self.texts = []
        self.words = [t.split(" ") for t in self.texts]

    def stream(self, part: int) -> list[str]:
        return list(chain.from_iterable(ws for ws, x in zip(self.words, self.parts, strict=True) if x == part))


def slices(pdf: pd.DataFrame, sizes: Iterator[int], most: int) -> Iterator[pd.DataFrame]:
    """``pdf`` in pieces of ``ROWS`` rows whose sizes add up to ``most`` at most, or of one row."""
    a = held = 0
    for b, n in enumerate(sizes):
        if b > a and (b - a == ROWS or held + n > most):
            yield pdf.iloc[a:b]
            a, held = b, 0
        held += n
    if a < len(pdf):
        yield pdf.iloc[a:]


def filter_bits(filed: np.ndarray, keys: np.ndarray) -> None:
    """Files keys by their lowest ``FILTER`` bits."""
    at = keys & np.uint64(2**FILTER - 1)
    np.bitwise_or.at(filed, at >> np.uint64(3), np.left_shift(1, at & np.uint64(7), dtype=np.uint64).astype(np.uint8))


def may_hold(filed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key was filed; true for a few others too."""
    at = keys & np.uint64(2**FILTER - 1)
    return (filed[at >> np.uint64(3)].astype(np.uint64) >> (at & np.uint64(7)) & np.uint64(1)).astype(bool)


def salts_of(host: str | None) -> list[int]:
    """Of what lies outside of cores, and of cores: suffix arrays of their own."""
    import xxhash

    return [xxhash.xxh3_64_intdigest(f"{part}{host}".encode("utf-8", "surrogatepass")) for part in (0, 1)]


def extract(pages: DataFrame, broadcast_keys: int = 4_000_000, core: bool = True) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html)."""
    pages = host_path(pages.select(id_in("page_id"), "url", "html")).drop("path").withColumn("row", F.monotonically_increasing_id())

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            for part in slices(pdf, (len(x) if isinstance(x, str) else 0 for x in pdf["html"]), CHARS):
                rows = []
                for host, page in zip(part["host"], part["html"], strict=True):
                    found = blocks(page)
                    parts = parts_of(found, core)
                    marks = "".join(KINDS[kind].upper() if x else KINDS[kind] for (kind, _, _), x in zip(found, parts, strict=True))
                    ids = []
                    for x, salt in enumerate(salts_of(host)):
                        stream = " ".join(t for (_, t, _), y in zip(found, parts, strict=True) if x == y)
                        ids.append(xxhash.xxh3_64_intdigest(stream.encode("utf-8", "surrogatepass"), salt) - 2**63 if stream else 0)
                    packed = "\n".join([marks, *(t for _, t, _ in found)]).encode("utf-8", "surrogatepass")
                    rows.append((packed, *ids, sum(t.count(" ") + 1 for _, t, _ in found)))
                yield pd.DataFrame(
                    {c: part[c] for c in ("row", "page_id", "url", "host")}
                    | {c: pd.Series([r[k] for r in rows], part.index) for k, c in enumerate(("packed", "outer", "inner", "tokens"))}
                )

    parsed = written(pages.mapInPandas(parse, PARSED), "op10-parsed", compression="zstd")
    total = parsed.agg(F.sum("tokens")).first()[0] or 0
    buckets = 1 + total // SORTED

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The suffix array of a task's pages, in pieces: sorted suffixes, each with the number of streams that have it, by bucket."""
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def pieces() -> pd.DataFrame:
            ks, ns = summed(np.concatenate(keys), np.concatenate(counts))
            ends = np.searchsorted(ks, [np.uint64((b << BITS) // buckets) for b in range(1, buckets)])
            cut = [x for x in enumerate(zip(np.split(ks, ends), np.split(ns, ends), strict=True)) if len(x[1][0])]
            keys.clear()
            counts.clear()
            return pd.DataFrame({"bucket": [b for b, _ in cut], "packed": [pack(*x) for _, x in cut]})

        for pdf in batches:
            for part in slices(pdf, pdf["tokens"], TOKENS):
                streams, salts = [], []
                for host, packed, again in zip(part["host"], part["packed"], part["again"], strict=True):
                    page = Page(packed)
                    for x, salt in enumerate(salts_of(host)):
                        if not int(again) >> x & 1:
                            streams.append(page.stream(x))
                            salts.append(salt)
                key, stream, _ = suffixes(streams, salts)
                order = np.argsort(key, kind="stable")
                key, stream = key[order], stream[order]
                new = np.r_[True, (key[1:] != key[:-1]) | (stream[1:] != stream[:-1])][: len(key)]
                ks, ns = summed(key[new], np.ones(int(new.sum()), np.int64))
                keys.append(ks)
                counts.append(ns)
                if sum(map(len, keys)) >= SORTED:
                    yield pieces()
        if keys:
            yield pieces()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """The runs of one bucket that ``PAGES`` streams or more have."""
        read = [unpack(x) for x in pdf["packed"]]
        ks, ns = summed(np.concatenate([k for k, _ in read]), np.concatenate([n for _, n in read]))
        hot = ks[ns >= PAGES]
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "n": [len(hot)], "packed": [pack(hot, np.ones(len(hot)))]})

    # streams that an earlier row has too; their suffixes count once
    streams = parsed.where("tokens > 0").select("row", F.posexplode(F.array("outer", "inner")).alias("part", "stream")).where("stream <> 0")
    firsts = written(streams.groupBy("stream").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "op10-streams")

    def near(df: DataFrame) -> DataFrame:
        most = min(broadcast_keys, NEAR)
        return F.broadcast(df) if df.limit(most + 1).count() <= most else df

    again = F.sum(F.expr("part + 1")).alias("again")  # as bits
    later = written(streams.join(near(firsts), "stream").where("row <> first").groupBy("row").agg(again), "op10-later")
    counted = parsed.where("tokens > 0").join(near(later), "row", "left").select("host", "packed", "tokens", F.coalesce("again", F.lit(0)).alias("again"))
    merged = counted.mapInPandas(sort, "bucket long, packed binary").groupBy("bucket").applyInPandas(merge, "bucket long, n long, packed binary")
    hot = written(merged.where("n > 0"), "op10-runs")
    known = likely = None
    if (hot.agg(F.sum("n")).first()[0] or 0) <= broadcast_keys:
        read = [unpack(bytes(r["packed"]))[0] for r in hot.select("packed").collect()]
        known = pages.sparkSession.sparkContext.broadcast(np.sort(np.concatenate([np.empty(0, np.uint64), *read])))
    else:
        filed = np.zeros(2**FILTER // 8, np.uint8)
        for r in hot.select("packed").toLocalIterator():
            filter_bits(filed, unpack(bytes(r["packed"]))[0])
        likely = pages.sparkSession.sparkContext.broadcast(filed)

    def keys_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf, pdf["tokens"], TOKENS):
                read = [Page(x) for x in part["packed"]]
                key, stream, _ = suffixes([p.stream(x) for p in read for x in (0, 1)], [s for host in part["host"] for s in salts_of(host)])
                held = may_hold(likely.value, key)
                yield pd.DataFrame({"row": part["row"].to_numpy()[stream[held] // 2], "key": key[held].astype(np.int64)}).drop_duplicates()

    def hot_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf["packed"]:
                yield pd.DataFrame({"key": unpack(blob)[0].astype(np.int64)})

    def text_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf, pdf["tokens"], TOKENS):
                texts = []
                read = [Page(x) for x in part["packed"]]
                streams = [p.stream(x) for p in read for x in (0, 1)]
                key, stream, place = suffixes(streams, [s for host in part["host"] for s in salts_of(host)])
                if known is not None:
                    runs = known.value
                    is_hot = runs[np.minimum(np.searchsorted(runs, key), len(runs) - 1)] == key if len(runs) else np.zeros(len(key), bool)
                else:
                    sets = [set() if h is None else set(h) for h in part["hot"]]
                    is_hot = np.fromiter((int(k) in sets[s // 2] for k, s in zip(key, stream, strict=True)), bool, len(key))
                ends = np.cumsum([0, *map(len, streams)])
                cover = np.zeros(ends[-1] + 1, np.int64)
                np.add.at(cover, place[is_hot], 1)
                np.add.at(cover, place[is_hot] + RUN, -1)
                hits = np.r_[0, np.cumsum(np.cumsum(cover)[:-1] > 0)]
                for k, p in enumerate(read):
                    at, sums = [ends[2 * k], ends[2 * k + 1]], []
                    for x, ws in zip(p.parts, p.words, strict=True):
                        sums.append(int(hits[at[x] + len(ws)] - hits[at[x]]))
                        at[x] += len(ws)
                    texts.append("\n".join(checked(list(zip(p.kinds, p.texts, strict=True)), p.parts, sums, [len(ws) for ws in p.words])))
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    out = parsed.select("row", "page_id", "url", "host", "packed", "tokens")
    if known is None:
        keys = hot.mapInPandas(hot_keys, "key long")
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        wanted = parsed.mapInPandas(keys_of, "row long, key long").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        held = wanted.join(keys.withColumn("salt", salts), ["key", "salt"]).groupBy("row").agg(F.collect_set("key").alias("hot"))
        out = out.join(held, "row", "left")
    return id_out(out.mapInPandas(text_of, SCHEMA), "page_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))
