"""An n-gram language model in an Elias-Fano trie, built and queried in parallel.

Levels, each in shards of its own in the shared folder, memory-mapped by the
workers that score:

1. tokens, by the 64-bit hash of their bytes; a token's id is its rank;
2. bigrams: for each token the successors, as one monotone Elias-Fano
   sequence of context * V + successor, and monotone pointers to where each
   token's successors begin;
3. trigrams below each bigram.  The last token is written as
   its place among the successors of the middle token, not as its id, so the
   numbers stay small: a query finds the middle token's successor first and
   searches that relative number below the bigram (context-relative search).

Probabilities are interpolated with absolute discounting,
p(w|ctx) = max(c - D, 0) / c(ctx) + weight(ctx) * p(w|shorter ctx), with the
add-one unigram at the end; both terms are kept as 16-bit logarithmic codes.
Counts cover all training text, and every bigram and trigram of it is retained
(a MIN_COUNT above 1 would leave the share of rarer ones to the weight).

Texts are turned into token ids once, as soon as level 1 is there; the passes
that count and score read the ids.  Every pass pre-aggregates in the worker and ships packed blocks per shard, so a
frequent n-gram costs one entry for each block, not one for each occurrence; a
block holds the gaps between its sorted n-grams, about three bytes for each.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm import packed, store
from rowloom.llm.arrow import coded_words, slices
from rowloom.llm.elias_fano import Sequence, Sequences
from rowloom.llm.scratch import fresh_path, shuffles_dropped
from rowloom.llm.workers import forget_long, held

MIN_COUNT = 1
DISCOUNT = 0.75
LAST_LEVEL = 3
#: Documents to a shard, on average, and the most shards (as powers of two).
SHARD_DOCS, MAX_SHARD_BITS = 8192, 14
#: Entries of a worker's vocabulary cache, characters and tokens of a slice, keys of a block.
CACHE_WORDS, SLICE_CHARS, SLICE_TOKENS, BLOCK_KEYS = 600_000, 2_000_000, 200_000, 4_000_000
#: The end of a text; white space, so no word equals it.
END = b"\n"
#: Codes cover logarithms from 0 to -CODE_RANGE.
CODE_RANGE = 10.0
#: How an unknown token's id is written.
UNKNOWN = 0xFFFFFFFF

U64 = np.uint64
#: Multiplying by one spreads n-grams over all numbers of some bits, by the other takes that back.
_SPREAD = U64(0x9E3779B97F4A7C15)
_GATHER = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def encode_log(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.minimum(np.round(-np.log10(p) * (65535 / CODE_RANGE)), 65535).astype(np.uint16)


_DECODED = 10.0 ** (-np.arange(65536) * (CODE_RANGE / 65535))


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal neighbours."""
    edges = np.flatnonzero(np.diff(values, prepend=-1))
    return zip(edges.tolist(), [*edges[1:].tolist(), len(values)][: len(edges)], strict=True)


def words_of(column: pa.Array) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Of slices of a text column: the distinct tokens, the number of each token in order, and the number of tokens of each text.

    Tokens are lower-cased (A-Z) words between ASCII white space, and one end
    behind each text, which is the last of the distinct ones.  Null is empty.
    """
    for a, b in slices(pc.fill_null(pc.binary_length(column), 0).to_pylist(), SLICE_CHARS):
        distinct, number, lengths = coded_words(column.slice(a, b - a))
        yield [*distinct, END], np.insert(number, np.cumsum(lengths), len(distinct)), lengths + 1


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    # Mostly sorted runs one after the other, which this sort merges.
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _blocks(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """Sorted keys as one row for each shard that has some; shard b holds keys below bounds[b]."""
    ends = np.searchsorted(keys, bounds)
    # The last bound may be the largest number itself.
    ends[-1] = len(keys)
    rows = [(b, lo, hi) for b, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if lo < hi]
    data = [packed.pack(keys[a:e], counts[a:e]) for _, a, e in rows]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in rows], pa.int64()), pa.array(data, pa.binary())], ["shard", "block"])


def _unblocked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for chunk in table["block"].chunks:
        for block in chunk:
            one, two = packed.unpack(block.as_buffer())
            keys.append(one)
            counts.append(two)
    return _summed(np.concatenate(keys), np.concatenate(counts))


class Gatherer:
    """Collects sorted keys with counts and gives them out in blocks."""

    def __init__(self, bounds: np.ndarray) -> None:
        self.bounds, self.keys, self.counts, self.held = bounds, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held >= BLOCK_KEYS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield _blocks(*_summed(np.concatenate(self.keys), np.concatenate(self.counts)), self.bounds)
        self.keys, self.counts, self.held = [], [], 0


class Model:
    """What a worker needs to know of a model: folder, shards and sizes."""

    def __init__(self, folder: str, bits: int) -> None:
        self.folder, self.bits = folder, bits
        self.tokens = self.types = self.rel = 0
        #: Number of ids before each shard, and the total: by level.
        self.starts: dict[int, np.ndarray] = {}

    def follow_bits(self, level: int) -> int:
        """Bits of what follows a context in the keys of the level: a token, or its place among successors."""
        return max(1, (self.types if level == 2 else self.rel + 1).bit_length())

    def key_bits(self, level: int) -> int:
        """Bits of a key of the level: a context, and behind it what follows."""
        bits = self.follow_bits(level) + max(1, int(self.starts[level - 1][-1]).bit_length())
        if bits > 64:
            raise ValueError(f"an n-gram of level {level} needs {bits} bits")
        return max(bits, self.bits)

    def keys(self, level: int, context: np.ndarray, follow: np.ndarray) -> np.ndarray:
        return (context.astype(U64) << U64(self.follow_bits(level))) | follow.astype(U64)

    def parts(self, level: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contexts of keys, and what follows them."""
        bits = self.follow_bits(level)
        return (keys >> U64(bits)).astype(np.int64), keys & U64((1 << bits) - 1)

    def bounds(self, level: int) -> np.ndarray:
        """Exclusive upper key of each shard of the level."""
        return self.starts[level - 1][1:].astype(U64) << U64(self.follow_bits(level))

    def even(self, level: int) -> np.ndarray:
        """Exclusive upper key of each shard when keys are spread over their bits."""
        ends = np.arange(1, (1 << self.bits) + 1, dtype=U64)
        bits = self.key_bits(level) - self.bits
        with np.errstate(over="ignore"):
            ends = ends << U64(bits) if bits < 64 else ends
        if self.key_bits(level) == 64:
            ends[-1] = np.iinfo(U64).max
        return ends

    def spread(self, level: int, keys: np.ndarray, back: bool = False) -> np.ndarray:
        """A bijection of the keys of the level that deals neighbours to all shards."""
        mask = U64((1 << self.key_bits(level)) - 1)
        with np.errstate(over="ignore"):
            return (keys * (_GATHER if back else _SPREAD)) & mask

    def set_level(self, level: int, sizes: dict[int, int]) -> None:
        self.starts[level] = np.concatenate([[0], np.cumsum([sizes.get(b, 0) for b in range(1 << self.bits)])]).astype(np.int64)

    @functools.cached_property
    def cut(self) -> np.ndarray:
        """Upper hash of each shard but the last, exclusive."""
        return np.arange(1, 1 << self.bits, dtype=U64) << U64(64 - self.bits) if self.bits else np.zeros(0, U64)


class Level:
    """All shards of a level in one range of addresses, so that a look-up costs the same however many there are."""

    def __init__(self, model: Model, level: int) -> None:
        # A shard is there if it has tokens, or contexts for the n-grams of the level.
        there = np.diff(model.starts[max(1, level - 1)]) > 0
        self.files = store.Mapped([f"{model.folder}/{level}-{b:05d}" if x else None for b, x in enumerate(there)])
        #: Number of ids of the level before each shard.
        self.first = model.starts.get(level, np.zeros(1, np.int64))[:-1]
        self.at: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def get(self, name: str, shard: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
        """Numbers of ``width`` bytes at indices of an array of the shards."""
        return self.files.views[width][self.place(name)[0][shard] + index]

    def place(self, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if name not in self.at:
            self.at[name] = self.files.places(name)
        return self.at[name]

    @functools.cached_property
    def universe(self) -> int:
        """The same in all shards."""
        at, size, _ = self.place("universe")
        return int(self.files.views[8][at[size > 0][0]])

    @functools.cached_property
    def filter_mask(self) -> np.ndarray:
        return np.maximum(self.place("filter")[1] * 8, 1).astype(U64) - U64(1)

    def sequences(self, name: str) -> Sequences:
        shape, size, _ = self.place(f"{name}.shape")
        n, bits = (np.where(size > 0, self.files.views[8][shape + i], 0).astype(np.int64) for i in (0, 1))
        parts = {k: self.place(f"{name}.{k}") for k in ("low", "high", "rank", "ones", "zeros")}
        return Sequences(self.files.views[8], self.files.views[4], n, bits, {k: v[0] for k, v in parts.items()}, {k: v[1] for k, v in parts.items()})

    @functools.cached_property
    def succ(self) -> Sequences:
        return self.sequences("succ")

    @functools.cached_property
    def ptr(self) -> Sequences:
        return self.sequences("ptr")

    def counts(self, shard: np.ndarray, index: np.ndarray) -> np.ndarray:
        """How often tokens occurred; a shard with a very frequent one has wider numbers."""
        width = self.place("count")[2][shard]
        out = np.zeros(len(index), np.int64)
        for w in (4, 8):
            own = np.flatnonzero(width == w)
            out[own] = self.get("count", shard[own], index[own], w).astype(np.int64)
        return out

    def hashed(self, shard: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Index of each hash in its shard, -1 where it is not there."""
        first, size, _ = self.place("hash")
        low, top = first[shard], first[shard] + size[shard]
        hashes, end = self.files.views[8], top
        for _ in range(int(size.max(initial=0)).bit_length()):
            # Where nothing is left, low stays.
            mid = (low + top) >> 1
            less = (hashes[mid] < h) & (low < top)
            low, top = np.where(less, mid + 1, low), np.where(less, top, mid)
        return np.where((low < end) & (hashes[low] == h), low - first[shard], -1)


class Reader:
    """Queries a model; one for each worker process and model."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.levels: dict[int, Level] = {}
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}

    def level(self, level: int) -> Level:
        if level not in self.levels:
            self.levels[level] = Level(self.model, level)
        return self.levels[level]

    def located(self, level: int, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard and local index of ids of the level."""
        starts = self.model.starts[level]
        shard = np.searchsorted(starts, index, side="right") - 1
        return shard, index - starts[shard]

    def by_shard(self, level: int, index: np.ndarray) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
        """What is below ids of the level, shard by shard: its arrays, places in ``index`` and local indices (-1: none)."""
        places = np.flatnonzero(index >= 0)
        shard, local = self.located(level, index[places])
        order = np.argsort(shard, kind="stable")
        for a, e in _runs(shard[order]):
            own = order[a:e]
            yield store.read(f"{self.model.folder}/{level + 1}-{shard[own[0]]:05d}"), places[own], local[own]

    def weights(self, level: int, context: np.ndarray) -> np.ndarray:
        """Weights of contexts, which are ids of the level."""
        shard, local = self.located(level, context)
        return _DECODED[self.level(level + 1).get("weight", shard, local, 2)]

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Ids of words, -1 for unknown ones."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))
        ids = np.full(len(h), -1, np.int64)
        if not self.model.types or not words:
            return ids
        order = np.argsort(h)
        h = h[order]
        shard = np.searchsorted(self.model.cut, h, side="right")
        at = self.level(1).hashed(shard, h)
        ids[order] = np.where(at >= 0, self.model.starts[1][shard] + at, -1)
        return ids

    def ids(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.clear()
        new = [w for w in words if w not in self.known]
        self.known.update(zip(new, self.look_up(new).tolist(), strict=True))
        out = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        forget_long(self.known, new)
        return out

    def tokens(self, ids: np.ndarray, more: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token its count, and with ``more`` its weight as a context and where its successors begin."""
        some, inverse = np.unique(ids, return_inverse=True)
        counts, weights, begins = np.zeros(len(some), np.int64), np.ones(len(some)), np.zeros(len(some), np.int64)
        first = np.searchsorted(some, 0)
        if first < len(some):
            shard, local = self.located(1, some[first:])
            counts[first:] = self.level(1).counts(shard, local)
            if more:
                level = self.level(2)
                weights[first:] = _DECODED[level.get("weight", shard, local, 2)]
                begins[first:] = level.ptr.access(shard, local).astype(np.int64) + level.first[shard]
        return counts[inverse], weights[inverse], begins[inverse]

    def successors(self, level: int, context: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position (-1: not retained) and discounted probability of ``following`` below ``context``."""
        found, p = np.full(len(context), -1, np.int64), np.zeros(len(context))
        asked = np.flatnonzero((context >= 0) & (following >= 0))
        # Each distinct pair once, in order: neighbours lie together in the level.
        pair, inverse = np.unique(self.model.keys(level + 1, context[asked], following[asked]), return_inverse=True)
        at_pair, p_pair = np.full(len(pair), -1, np.int64), np.zeros(len(pair))
        if len(pair):
            contexts, follow = self.model.parts(level + 1, pair)
            below, (shard, local) = self.level(level + 1), self.located(level, contexts)
            keys = local.astype(U64) * U64(below.universe) + follow
            bit = (_mixed(keys) & below.filter_mask[shard]).astype(np.int64)
            maybe = np.flatnonzero(below.get("filter", shard, bit >> 3, 1) >> (bit & 7).astype(np.uint8) & 1)
            shard = shard[maybe]
            at = below.succ.find(shard, keys[maybe])
            hit = np.flatnonzero(at >= 0)
            places, at, shard = maybe[hit], at[hit], shard[hit]
            at_pair[places] = at + below.first[shard]
            p_pair[places] = _DECODED[below.get("prob", shard, at, 2)]
        found[asked], p[asked] = at_pair[inverse], p_pair[inverse]
        return found, p

    def pairs(self, ids: np.ndarray, begins: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token the position of the bigram it ends (-1: none), its place below the token before, and its probability."""
        found, p = np.full(len(ids), -1, np.int64), np.zeros(len(ids))
        context = ids[:-1].copy()
        context[starts[starts > 0] - 1] = -1
        found[1:], p[1:] = self.successors(1, context, ids[1:])
        place = np.full(len(ids), -1, np.int64)
        place[1:] = np.where(found[1:] >= 0, found[1:] - begins[:-1], -1)
        return found, place, p


def _reader(model: Model) -> Reader:
    return held(("ngram", model.folder, *sorted(model.starts)), lambda: Reader(model))


def _id_slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token ids of neighbouring texts (-1: unknown) and where each text starts."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 4
    data = np.frombuffer(column.buffers()[2], np.uint32) if len(column) else np.zeros(0, np.uint32)
    lengths = np.diff(ends)
    for a, b in slices(lengths.tolist(), SLICE_TOKENS):
        ids = data[ends[a] : ends[b]].astype(np.int64)
        ids[ids == UNKNOWN] = -1
        yield ids, ends[a:b] - ends[a]


def _grouped(blocks: DataFrame, reduce) -> list:
    with shuffles_dropped(blocks.sparkSession):
        return blocks.groupBy("shard").applyInArrow(reduce, "shard long, size long, total long, most long").collect()


def _result(shard: int, size: int, total: int, most: int) -> pa.Table:
    return pa.table({k: pa.array([int(v)], pa.int64()) for k, v in (("shard", shard), ("size", size), ("total", total), ("most", most))})


def _count_tokens(texts: DataFrame, model: Model) -> None:
    bounds = np.concatenate([model.cut, [np.iinfo(U64).max]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gatherer = Gatherer(bounds)
        for batch in batches:
            for words, number, _ in words_of(batch.column(0)):
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))
                yield from gatherer.add(*_summed(h, np.bincount(number, minlength=len(words))))
        yield from gatherer.flush()

    def reduce(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        keys, counts = _unblocked(table)
        store.write(f"{model.folder}/1-{shard:05d}", {"hash": keys, "count": counts.astype(np.uint32 if counts.max() < 1 << 32 else np.int64)})
        return _result(shard, len(keys), counts.sum(), counts.max())

    found = _grouped(texts.mapInArrow(run, "shard long, block binary"), reduce)
    model.tokens, model.types = sum(r.total for r in found), sum(r.size for r in found)
    model.set_level(1, {r.shard: r.size for r in found})


def _mixed(keys: np.ndarray) -> np.ndarray:
    """Numbers whose lowest bits are the place of each key among the bits of a filter."""
    with np.errstate(over="ignore"):
        return (keys * _SPREAD) >> U64(32)


def _filter(keys: np.ndarray) -> np.ndarray:
    """Four to eight bits for each key; a key whose bit is not set is not in the level."""
    size = 1 << max(3, len(keys).bit_length() - 1)
    flags = np.zeros(size * 8, bool)
    flags[(_mixed(keys) & U64(size * 8 - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little")


def _write_level(model: Model, level: int, shard: int, keys: np.ndarray, counts: np.ndarray) -> tuple[int, int]:
    """Write the retained n-grams below the shard's contexts; their number and the most below one context."""
    start, end = model.starts[level - 1][shard : shard + 2]
    contexts, universe = int(end - start), model.types if level == 2 else model.rel + 1
    context, follow = model.parts(level, keys)
    context -= start
    # All that followed a context, retained or not: as often as the context itself occurred.
    if level == 2:
        totals = store.read(f"{model.folder}/1-{shard:05d}")["count"].astype(np.float64)
    else:
        _, totals = packed.unpack(store.read_bytes(f"{model.folder}/{level - 1}-{shard:05d}-count"))
    p = (counts - DISCOUNT) / totals[context]
    sizes = np.bincount(context, minlength=contexts)
    weight = 1 - np.bincount(context, p, contexts)
    keys = context.astype(U64) * U64(universe) + follow
    parts = {"prob": encode_log(p), "weight": encode_log(np.maximum(weight, 1e-10)), "universe": np.array([universe], np.int64), "filter": _filter(keys)}
    if level < LAST_LEVEL:
        # For the next level only.
        store.write_bytes(f"{model.folder}/{level}-{shard:05d}-count", packed.pack(np.zeros(len(counts), U64), counts))
    parts |= {f"succ.{k}": v for k, v in Sequence.build(keys, contexts * universe).items()}
    parts |= {f"ptr.{k}": v for k, v in Sequence.build(np.concatenate([[0], np.cumsum(sizes)]), len(follow) + 1).items()}
    store.write(f"{model.folder}/{level}-{shard:05d}", parts)
    return len(follow), int(sizes.max(initial=0))


def _count_ngrams(texts: DataFrame, model: Model, level: int) -> None:
    """Count and write one level.

    Counts are summed by a hash of the whole n-gram, so that a frequent context
    is dealt over all shards; only what is retained goes on to its context.
    """
    bounds, even = model.bounds(level), model.even(level)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, gatherer = _reader(model), Gatherer(even)
        for batch in batches:
            for ids, starts in _id_slices(batch.column(0)):
                if level == 2:
                    inner = np.ones(len(ids), bool)
                    inner[starts] = False
                    keys = model.keys(level, ids[:-1], ids[1:])[inner[1:]]
                else:
                    _, _, begins = reader.tokens(ids, True)
                    found, place, _ = reader.pairs(ids, begins, starts)
                    both = (found[:-1] >= 0) & (place[1:] >= 0)
                    keys = model.keys(level, found[:-1][both], place[1:][both])
                yield from gatherer.add(model.spread(level, keys))
        yield from gatherer.flush()

    def retain(table: pa.Table) -> pa.Table:
        keys, counts = _unblocked(table)
        keep = counts >= MIN_COUNT
        keys = model.spread(level, keys[keep], True)
        return pa.Table.from_batches([_blocks(*_summed(keys, counts[keep]), bounds)])

    def reduce(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        size, most = _write_level(model, level, shard, *_unblocked(table))
        return _result(shard, size, 0, most)

    blocks = texts.mapInArrow(run, "shard long, block binary")
    found = _grouped(blocks.groupBy("shard").applyInArrow(retain, "shard long, block binary"), reduce)
    model.set_level(level, {r.shard: r.size for r in found})
    # A shard without n-grams still has contexts: they keep all weight.
    present = {r.shard for r in found}
    for b in range(1 << model.bits):
        if b not in present and model.starts[level - 1][b] < model.starts[level - 1][b + 1]:
            _write_level(model, level, b, np.zeros(0, U64), np.zeros(0, np.int64))
    if level == 2:
        model.rel = max((r.most for r in found), default=0)


def _identified(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """The rows with ``ids`` for their text: 32-bit token ids, written to the shared folder."""
    at = docs.columns.index(text_col)
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(model)
        for batch in batches:
            data = []
            for words, number, lengths in words_of(batch.column(at)):
                ids = reader.ids(words).astype(np.uint32)[number].tobytes()
                ends = (4 * np.cumsum(lengths)).tolist()
                data += [ids[a:e] for a, e in zip([0, *ends], ends, strict=False)]
            others = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*others, pa.array(data, pa.binary())], [*rest, "ids"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col]
    path = fresh_path(docs.sparkSession, "ngram-ids")
    found = docs.mapInArrow(run, ", ".join([*kinds, "ids binary"]))
    found.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(found.schema).parquet(path)


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3) -> DataFrame:
    """Train on the documents whose crc32(id) mod 7 is not 2 and score all: see ``score``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    learned = F.col("doc_id").isNotNull() & ~F.col("held_out")
    bits = min(MAX_SHARD_BITS, max(0, (rows.count() // SHARD_DOCS).bit_length()))
    model = Model(fresh_path(docs.sparkSession, "ngram"), bits)
    _count_tokens(rows.filter(learned).select("text"), model)
    rows = _identified(rows, model, "text")
    for level in range(2, order + 1):
        _count_ngrams(rows.filter(learned).select("ids"), model, level)
    return score(rows, model)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``rows`` are doc_id, held_out and ids.  ``score`` is the model's log10
    probability of the text, ``base_score`` that of the add-one unigram.  A null
    or empty text is one end token.  Ids may be null (never held out, nor
    learned from) or repeat; every row is scored by itself.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    order, total, unknown = max(model.starts), model.tokens, model.tokens + model.types + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(model)
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for ids, starts in _id_slices(batch.column(2)):
                counts, weights, begins = reader.tokens(ids, order > 1)
                p = (counts + 1) / unknown
                base = np.log10(p)
                if order > 1 and model.types:
                    found, place, q = reader.pairs(ids, begins, starts)
                    p[1:] *= weights[:-1]
                    p[starts] = (counts[starts] + 1) / unknown
                    p += q
                    if order > 2:
                        context = np.full(len(ids), -1, np.int64)
                        context[1:] = found[:-1]
                        context[starts] = -1
                        _, q = reader.successors(2, context, place)
                        some = np.flatnonzero(context >= 0)
                        if len(some):
                            p[some] *= reader.weights(2, context[some])
                        p += q
                columns = np.diff(np.append(starts, len(ids))), (counts > 0).astype(np.int64), base, np.log10(p)
                for column, values in zip(out, columns, strict=True):
                    column.append(values if column is out[0] else np.add.reduceat(values, starts))
            n, known, base, logp = (np.concatenate(x) if x else np.zeros(0) for x in out)
            arrays = [batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), total, np.int64)), pa.array(base, pa.float64()), pa.array(logp, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.select("doc_id", "held_out", "ids").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
