"""Token counts and token ids of whole texts, as the ``tokenizers`` library gives them.

Counting uses the whole-token shortcut.  Once per process it is proved, by
encoding every vocabulary string alone, which pre-tokens are one token each.
A pre-token in that set counts one; only the rest is merged, once for each
distinct pre-token.
"""

from __future__ import annotations

import array
import functools
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from rowloom.llm.arrow import slices, texts_of
from rowloom.llm.workers import LONG_WORD, forget_long, held

#: Entries of a worker's cache; a full cache is emptied, so memory is bounded.
CACHE_ENTRIES = 500_000
#: Characters of text split into words at once.
SLICE_CHARS = 1_000_000

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# The byte-level pre-tokenizer's pattern.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_RARE_SPACE = regex.compile("[\x85\xa0  -     　]")
_SPACE_PAIRS = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ", " \x0b", "\x0b ", " \x0c", "\x0c ")


@functools.cache
def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.cache
def whole_tokens(path: str) -> frozenset[str]:
    """The strings that are one pre-token and that the library encodes alone as one token."""
    tokenizer, alphabet, pattern = load(path), byte_alphabet(), regex.compile(PRE_TOKEN)
    found = []
    for shown in tokenizer.get_vocab(with_added_tokens=False):
        try:
            plain = bytes(alphabet[c] for c in shown).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if pattern.fullmatch(plain) and pattern.match(plain).end() == len(plain):
            found.append(plain)
    encoded = tokenizer.encode_batch_fast(found, add_special_tokens=False)
    return frozenset(s for s, e in zip(found, encoded, strict=True) if len(e.ids) == 1)


#: Stand-in of each byte, by the byte's value.
_SHOWN = {b: shown for shown, b in byte_alphabet().items()}
_STOPS = (".", ",", ";", ":", "!", "?")


class Counter:
    """Counts the tokens of texts under a byte-level BPE file."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES) -> None:
        self.tokenizer, self.whole, self.entries = load(path), whole_tokens(path), entries
        self.pattern = regex.compile(PRE_TOKEN)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        #: Tokens of a word with the space before it, and of a merged pre-token.
        self.words: dict[str, int] = {}
        self.merged: dict[str, int] = {}

    def _merge(self, pre_tokens: set[str]) -> None:
        """Count what is not one token, each distinct pre-token once."""
        merge, merged = self.tokenizer.model.tokenize, self.merged
        for p in pre_tokens.difference(self.whole, merged):
            merged[p] = len(merge(p.encode().decode("latin-1").translate(_SHOWN)))

    def _size(self, pre_tokens: list[str]) -> int:
        whole, merged = self.whole, self.merged
        return sum(1 if p in whole else merged[p] for p in pre_tokens)

    def _learn(self, words: set[str]) -> None:
        new = words.difference(self.words)
        split = [self._pre_tokens(w) for w in new]
        self._merge({p for pre in split for p in pre})
        for w, pre in zip(new, split, strict=True):
            self.words[w] = self._size(pre)
            if len(w) > LONG_WORD:
                forget_long(self.merged, pre)

    def _pre_tokens(self, word: str) -> list[str]:
        """Pre-tokens of a word with one space before it."""
        if word.isalpha():
            return [" " + word]
        if word[-1:] in _STOPS and word[:-1].isalpha():
            return [" " + word[:-1], word[-1]]
        return self.pattern.findall(" " + word)

    def _plain(self, text: str) -> bool:
        """Whether every space stands alone between two other characters."""
        if text[:1].isspace() or text[-1:].isspace() or any(p in text for p in _SPACE_PAIRS):
            return False
        return text.isascii() or not _RARE_SPACE.search(text)

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for a, b in slices(map(len, texts), SLICE_CHARS):
            if len(self.words) + len(self.merged) > self.entries:
                self.words.clear()
                self.merged.clear()
            out += self._count(texts[a:b])
        return out

    def _count(self, texts: list[str]) -> list[int]:
        split: list[tuple[int, list[str], list[str]]] = []
        words: set[str] = set()
        others: set[str] = set()
        for text in texts:
            fixed, own_words, own_others = 0, [], []
            parts = [text]
            if self.cut is not None and any(s in text for s in self.special):
                parts = self.cut.split(text)
                fixed = len(parts) - 1
            for part in parts:
                if not part:
                    continue
                if self._plain(part):
                    first, *rest = part.split(" ")
                    own_others += self.pattern.findall(first)
                    own_words += rest
                else:
                    own_others += self.pattern.findall(part)
            words.update(own_words)
            others.update(own_others)
            split.append((fixed, own_words, own_others))
        self._learn(words)
        self._merge(others)
        get = self.words.__getitem__
        out = [fixed + sum(map(get, own)) + self._size(rest) for fixed, own, rest in split]
        forget_long(self.words, words)
        forget_long(self.merged, others)
        return out


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    No begin, end or other special token is added; special strings inside a
    text are the special tokens they name, as is the library's default.  A null
    text is empty (no tokens).  Ids may be null or repeat; every row counts by
    itself.  An empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _worker_counter(tokenizer)
        for batch in batches:
            n = pa.array(counter.count(texts_of(batch.column(1))), pa.int64())
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def _worker_counter(path: str) -> Counter:
    return held(("count", path), lambda: Counter(path))


# The word pre-tokenizer's pattern, for text in lower case.
WORD_PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


class Encoder:
    """Token ids of texts under a tokenizer that drops white space and case.

    White space never reaches a pre-token, so a text's ids are those of its
    words one after another; each distinct word and pre-token is encoded once.
    Words of Latin-1 characters without special strings are cut here; any other
    word goes through the whole library.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES) -> None:
        self.tokenizer, self.entries = load(path), entries
        self.pattern = regex.compile(WORD_PRE_TOKEN)
        self.words: dict[str, bytes] = {}
        self.merged: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merge(self, pre_token: str) -> bytes:
        found = self.merged.get(pre_token)
        if found is None:
            tokens = self.tokenizer.model.tokenize(pre_token.encode().decode("latin-1").translate(_SHOWN))
            found = array.array("I", [t.id for t in tokens]).tobytes()
            if len(pre_token) <= LONG_WORD:
                self.merged[pre_token] = found
        return found

    def _learn(self, words: set[str]) -> None:
        kept, merge, other = self.words, self._merge, []
        for w in words.difference(kept):
            if "<|" in w or (not w.isascii() and max(w) > "\xff"):
                other.append(w)
                continue
            low = w.lower()
            if low.isalpha():
                kept[w] = merge(low)
            elif low[-1] in _STOPS and low[:-1].isalpha():
                kept[w] = merge(low[:-1]) + merge(low[-1])
            else:
                kept[w] = b"".join(map(merge, self.pattern.findall(low)))
        kept.update(zip(other, self._whole(other), strict=True))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, in order."""
        for a, b in slices(map(len, texts), SLICE_CHARS):
            if len(self.words) + len(self.merged) > self.entries:
                self.words.clear()
                self.merged.clear()
            split = [None if _control(t) else t.split() for t in texts[a:b]]
            words = set().union(*(s for s in split if s))
            self._learn(words)
            get = self.words.__getitem__
            for t, s in zip(texts[a:b], split, strict=True):
                yield self._whole([t])[0] if s is None else b"".join(map(get, s))
            forget_long(self.words, words)


def _control(text: str) -> bool:
    """Whether the text has a control character that Python, but not the library, splits at."""
    return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text


def worker_encoder(path: str) -> Encoder:
    return held(("encode", path), lambda: Encoder(path))
