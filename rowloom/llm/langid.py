"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language becomes a suffix automaton.  A
text, in lower case and with single spaces, is parsed greedily and as a whole
against each automaton: every phrase is the longest substring of the sample that
starts where the last phrase ended.  The number of phrases times log2 of the
sample's length, over the length of the text, is the cross-parsing entropy in
bits per character; the language with the smallest wins.

A text fits its language where the parse needs fewer bits than the entropy of the
sample's single characters: otherwise knowing the language's strings has not
helped at all, as with random characters, numbers, or a language not learned.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.arrow import texts_of
from rowloom.llm.workers import held

#: Bound of the sample: documents of each language, characters of each, and languages (the most frequent ones).
DOCS_PER_LANG = 128
CHARS_PER_DOC = 1024
MOST_LANGS = 64
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id mod 5 is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Sample of each language, from labelled rows that are not held out.

    The sample holds, for each of DOCS_PER_LANG hash ranges, the document with
    the least hash of its id, cut to CHARS_PER_DOC characters.  Of more than
    MOST_LANGS languages the most frequent are learned.  All three bounds are
    parameters of the model; what reaches the driver is at most their product.
    """
    h = F.xxhash64(id_col)
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    rows = rows.select(F.col(lang_col).alias("lang"), h.alias("h"), F.substring(text_col, 1, CHARS_PER_DOC).alias("t"))
    langs = [r.lang for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()]
    rows = rows.filter(F.col("lang").isin(langs)) if langs else rows.limit(0)
    least = rows.groupBy("lang", F.pmod("h", F.lit(DOCS_PER_LANG)).alias("part")).agg(F.min("h").alias("h")).drop("part")
    chosen = rows.join(F.broadcast(least), ["lang", "h"]).groupBy("lang", "h").agg(F.min("t").alias("t"))
    out: dict[str, list[str]] = {}
    for lang, _, text in sorted(chosen.collect()):
        out.setdefault(lang, []).append(prepared(text))
    return {lang: "\n".join(texts) for lang, texts in sorted(out.items())}


def prepared(text: str) -> str:
    """Lower case, one space before every word; a line end, which separates texts of a sample, is in none."""
    return " " + " ".join(text.lower().split())


#: A state is the dictionary of its transitions: character to state.
State = dict[str, "State"]


def suffix_automaton(text: str) -> State:
    """Start of the smallest automaton that accepts every substring of ``text``."""
    moves: list[State] = [{}]
    number = {id(moves[0]): 0}
    link, length, last = [-1], [0], 0
    for c in text:
        state, at = len(moves), last
        moves.append({})
        number[id(moves[state])] = state
        length.append(length[last] + 1)
        link.append(0)
        while at >= 0 and c not in moves[at]:
            moves[at][c] = moves[state]
            at = link[at]
        if at >= 0:
            target = number[id(moves[at][c])]
            if length[target] == length[at] + 1:
                link[state] = target
            else:
                copy = len(moves)
                moves.append(moves[target].copy())
                number[id(moves[copy])] = copy
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and moves[at].get(c) is moves[target]:
                    moves[at][c] = moves[copy]
                    at = link[at]
                link[target] = link[state] = copy
        last = state
    return moves[0]


def phrases(start: State, text: str) -> int:
    """Number of phrases of the greedy parse; a character unknown to the sample is a phrase."""
    count, state, first = 0, start, start.get
    for c in text:
        following = state.get(c)
        if following is None:
            if state is not start:
                count += 1
            state = first(c)
            if state is None:
                count += 1
                state = start
        else:
            state = following
    return count + (state is not start)


def letter_entropy(sample: str) -> float:
    """Bits per character of the sample's single characters."""
    share = np.array(list(Counter(sample).values()), np.float64) / max(1, len(sample))
    return float(-(share * np.log2(share)).sum())


class Prediction(NamedTuple):
    lang: str
    #: One minus the ratio of the best entropy to the second best.
    score: float
    #: Entropy of the best language, and whether the text fits it.
    bits: float
    fits: bool


class Identifier:
    """Predicts languages; one for each worker process."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.langs = sorted(samples)
        self.automata = [suffix_automaton(samples[x]) for x in self.langs]
        self.bits = np.array([math.log2(max(2, len(samples[x]))) for x in self.langs])
        self.letters = [letter_entropy(samples[x]) for x in self.langs]

    def predict(self, text: str) -> Prediction:
        if not self.langs or not _LETTER.search(text):
            return Prediction(UNDETERMINED, 0.0, 0.0, False)
        text = prepared(text)
        entropy = np.array([phrases(a, text) for a in self.automata]) * self.bits / len(text)
        best = int(entropy.argmin())
        others = np.delete(entropy, best)
        score = float(1 - entropy[best] / others.min()) if len(others) else 1.0
        return Prediction(self.langs[best], score, float(entropy[best]), bool(entropy[best] < self.letters[best]))


def _worker(samples: dict[str, str]) -> Identifier:
    key = hashlib.sha256(repr(samples).encode()).hexdigest()
    return held(("langid", key), lambda: Identifier(samples))


def identify(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, bits, fits.

    score is one minus the ratio of the best entropy to the second best, from 0
    (a tie; the language first in order wins) to 1; bits is the best entropy, and
    fits whether it is below that of single characters.  ``und`` with score and
    bits 0 is for null texts, texts without a letter, and where no language was
    learned.  Ids may be null or repeat; every row is predicted by itself, from
    the whole text however long.  An empty table gives no rows; other columns are
    ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _worker(samples)
        for batch in batches:
            found = [model.predict(t) for t in texts_of(batch.column(2))]
            columns = [pa.array([getattr(p, n) for p in found], t) for n, t in (("lang", pa.string()), ("score", pa.float64()), ("bits", pa.float64()), ("fits", pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "held_out", "lang_pred", "score", "bits", "fits"])

    rows = docs.select(F.col(id_col), held_out(id_col).alias("__held_out"), text_col)
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, bits double, fits boolean")


def identified_documents(docs: DataFrame, samples: dict[str, str], text_col: str = "text", lang_col: str = "lang", languages: Iterable[str] | None = None) -> DataFrame:
    """The documents that fit a language, with all their columns; a null ``lang_col`` gets the prediction.

    ``languages`` keeps only documents predicted to be in one of them; None keeps
    all learned languages.  Texts that are null or have no letter go, and so does
    every document where no language was learned.  Every row is judged by its own
    text: ids may be null, repeated rows stay or go together.  An empty table
    gives no rows.
    """
    at = docs.columns.index(text_col)
    lang_at = docs.columns.index(lang_col) if lang_col in docs.columns else None
    wanted = None if languages is None else set(languages)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _worker(samples)
        for batch in batches:
            found = [model.predict(t) for t in texts_of(batch.column(at))]
            columns = batch.columns
            if lang_at is not None:
                filled = [p.lang if x is None else x for p, x in zip(found, columns[lang_at].to_pylist(), strict=True)]
                columns[lang_at] = pa.array(filled, batch.schema.field(lang_at).type)
            keep = [p.fits and (wanted is None or p.lang in wanted) for p in found]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
