"""Token ids of whole texts, as little-endian unsigned 32-bit bytes.

The tokenizer of ``word_bpe_49k.json`` first cuts a text into words, and equal words always give equal ids. For texts in Latin-1 without
special tokens (their lower case and normal form are simple) this module cuts the words itself, many texts at a time: a table gives the class
of each byte, words begin where the class changes, and Arrow numbers the distinct ones. Only words that are not known yet go to
the library, so every id still comes from it; known ones stay in a bounded cache. Any other text is encoded whole by the library.
"""

from __future__ import annotations

import codecs
import os
from collections.abc import Iterator

from .common import trim

#: Words (and bytes of words) that a cache holds at most, and bytes of texts that are cut at a time.
CACHE_WORDS, CACHE_BYTES, GROUP_BYTES = 300_000, 16 << 20, 4 << 20
DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: What the tokenizer's own pre-tokenizer matches, on lower-cased Latin-1; all else is white space or OTHER.
LETTERS = "abcdefghijklmnopqrstuvwxyzªµºßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
NUMBERS = "0123456789²³¹¼½¾"
WHITE = "\t\n\v\f\r \x85\xa0"
ONE, TWO = "stmd", ("re", "ve", "ll")
OTHER, LETTER, NUMBER, SPACE = range(4)


def byte_characters() -> str:
    """The characters that stand for bytes 0 to 255 in byte-level vocabularies: printable ones for themselves, others from U+0100 on; a
    space stays one, as it separates words here."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (chr(0x100 + k) for k in range(256))
    made = [chr(b) if b in plain else next(others) for b in range(256)]
    made[0x20] = " "
    return "".join(made)


def tokenizer_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


class Encoder:
    def __init__(self, path: str | None = None, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_path(path))
        # the same model without the steps that words cut here have behind them; it sees no word twice
        self.cutter = Tokenizer.from_file(tokenizer_path(path))
        self.cutter.normalizer, self.cutter.pre_tokenizer = None, pre_tokenizers.Split(" ", "removed")
        if hasattr(self.cutter.model, "_resize_cache"):
            self.cutter.model._resize_cache(0)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.kinds = np.full(256, OTHER, np.uint8)
        for kind, letters in ((LETTER, LETTERS), (NUMBER, NUMBERS), (SPACE, WHITE)):
            self.kinds[list(letters.encode("latin-1"))] = kind
        self.characters = byte_characters()
        self.cache_words = cache_words
        self.forget()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = (path is None or path.endswith(DEFAULT_TOKENIZER)) and self._agrees()

    def forget(self) -> None:
        """Empties the cache: ``place`` numbers words, whose ids are ``flat[start : start + length]``."""
        import numpy as np

        self.place: dict[bytes, int] = {}
        self.bytes = 0
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _agrees(self) -> bool:
        """Whether words alone give the same ids as whole texts, on a probe of all of Latin-1."""
        probe = "".join(map(chr, range(1, 256))) + " it's we'll x9y'd ÀÉ!!$%a1,b\xa0ñ''s'tis 'lly don'ts !'re 'v 'llle'd"
        return self._words([probe.lower().encode("latin-1"), b"", b"a"]) == self._whole([probe, "", "a"])

    def _whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, raw, doc_starts):
        """Places in ``raw`` (uint8) where a word, a single number or a run of white space begins."""
        import numpy as np

        kinds = self.kinds[raw]
        mark = np.empty(len(raw), bool)
        mark[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=mark[1:])
        mark |= kinds == NUMBER
        mark[doc_starts] = True
        # an apostrophe that stands alone belongs to an ending after it, which is a word even where letters follow
        at = np.flatnonzero(raw == ord("'"))
        if len(at):
            at = at[mark[at] & (at + 1 < len(raw))]
            at = at[mark[at + 1] & (kinds[np.minimum(at + 1, len(raw) - 1)] == LETTER)]
            first, second = raw[at + 1], raw[np.minimum(at + 2, len(raw) - 1)]
            one = np.isin(first, list(ONE.encode()))
            two = np.zeros(len(at), bool)
            for a, b in TWO:
                two |= (first == ord(a)) & (second == ord(b))
            mark[at[one | two] + 1] = False
            ends = np.r_[at[one] + 2, at[two & ~one] + 3]
            mark[ends[ends < len(raw)]] = True
        return np.flatnonzero(mark)

    def _words(self, texts: list[bytes]) -> list[bytes]:
        """Ids of lower-cased Latin-1 texts."""
        import numpy as np
        import pyarrow as pa

        # white space between texts keeps their words apart
        joined = b" ".join(texts)
        doc_starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        if not joined:
            return [b""] * len(texts)
        raw = np.frombuffer(joined, np.uint8)
        begins = self._cut(raw, doc_starts[:-1][doc_starts[:-1] < len(raw)])
        offsets = np.r_[begins, len(raw)].astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        where = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.lengths[where]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.starts[where] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()
        at = 4 * np.r_[0, ends][np.searchsorted(begins, doc_starts)]
        return [ids[a:b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]

    def _places(self, words: list[bytes]):
        """Number of each of some distinct words; new ones are learnt."""
        import numpy as np

        place = self.place
        found = list(map(place.get, words))
        new = [w for w, k in zip(words, found, strict=True) if k is None]
        if new:
            size = sum(map(len, new))
            if place and (len(place) + len(new) > self.cache_words or self.bytes + size > CACHE_BYTES):
                self.forget()
                return self._places(words)
            self._learn(new, size)
            found = list(map(self.place.__getitem__, words))
        return np.array(found, np.int64)

    def _learn(self, new: list[bytes], size: int) -> None:
        """Keeps the ids of words, from one text of all of them: the last id of each is one that ends words."""
        import numpy as np

        blank = [w for w in new if self.kinds[w[0]] == SPACE]
        words = [w for w in new if self.kinds[w[0]] != SPACE]
        # the library sees UTF-8, each byte as a character
        text = codecs.charmap_decode(b" ".join(words).decode("latin-1").encode("utf-8"), "strict", self.characters)[0]
        ids = np.asarray(self.cutter.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or len(words) and ends[-1] != len(ids):  # words can't be told apart: one by one
            each = [e.ids for e in self.cutter.encode_batch_fast(text.split(" "), add_special_tokens=False)] if words else []
            ids, ends = np.array([i for x in each for i in x], "<u4"), np.cumsum([len(x) for x in each], dtype=np.int64)
        starts = np.r_[0, ends][:-1]
        n = len(self.place)
        self.place.update(zip(words + blank, range(n, n + len(new)), strict=True))
        self.bytes += size
        none = np.zeros(len(blank), np.int64)
        self.starts = np.r_[self.starts, starts + len(self.flat), none]
        self.lengths = np.r_[self.lengths, ends - starts, none]
        self.flat = np.r_[self.flat, ids]

    def simple(self, text: str) -> bytes | None:
        """The text lower-cased in Latin-1, if it can be and holds no special token."""
        try:
            low = text.lower().encode("latin-1")
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if any(s in text for s in self.special) else low

    def encode(self, texts) -> Iterator[bytes]:
        """Ids of each text as bytes, in order; null is an empty text. Memory follows ``GROUP_BYTES`` and the longest text."""
        group, size = [], 0
        for text in texts:
            group.append(text if isinstance(text, str) else "")
            size += len(group[-1])
            if size >= GROUP_BYTES:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> list[bytes]:
        easy = [self.simple(t) if self.fast else None for t in texts]
        quick = iter(self._words([t for t in easy if t is not None]))
        hard = [t for t, low in zip(texts, easy, strict=True) if low is None]
        whole = iter([x for k in range(0, len(hard), 64) for x in self._whole(hard[k : k + 64])])
        return [next(whole if low is None else quick) for low in easy]


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One encoder for each worker process and tokenizer."""
    trim()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
