"""Substring deduplication with a sparse, range-partitioned suffix array.

A byte is removed when a string of SPAN bytes that covers it also starts in a
document with a smaller id.  Sorting every suffix of the corpus would move SPAN
bytes for each byte of text, so suffixes are sampled first, without loss:

1. Anchors.  In every string of SPAN bytes the substrings of LEAD bytes with the
   least hash are its anchors.  Equal strings have equal anchors, so two equal
   strings always meet in a suffix that starts at an anchor.  About one position
   in 15 is one.  An anchor answers for the strings whose least hash it is; they
   start side by side, and all that they hold is its window, of REACH bytes before
   the anchor and SPAN bytes from it on at most.
2. Texts are packed in blocks in the shared folder.  In a block the anchors that
   share a lead are sorted by their windows; of equal windows the one in the least
   document stays, and every string through the others repeats.
3. An anchor whose lead is nowhere else repeats nothing.  To leave those out, a hash
   of each lead and its place travel, once for each block.  This only spares work:
   what meets by hash is compared by its bytes later.
4. The suffixes at all other anchors are range-partitioned by their leading bytes
   at sampled splitters, and each bucket is sorted by multikey quicksort over
   8-byte characters.  From common prefixes of neighbours, in the suffix order
   and in the order of the reversed left contexts, come the classes of equal
   strings for every distance between string and anchor.  Splitters look at the
   first character only, so suffixes with one lead are in one bucket.
5. A lead in very many blocks would make its bucket too large.  Its suffixes are cut
   further, twice: by the bytes behind the lead, for strings that hold at least
   FAR bytes from the anchor on, and by the bytes before it, for the others.  Each
   string is compared in the cut whose bytes it holds, so none is missed where
   suffixes of one lead are in different buckets.
6. Marks go back to the blocks, where the bytes are removed.
"""

from __future__ import annotations

import functools
import hashlib
import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm import packed, store
from rowloom.llm.arrow import slices
from rowloom.llm.neardup import mix
from rowloom.llm.scratch import fresh_path, stash
from rowloom.llm.workers import held

#: Length of a repeated string, and of the leading bytes of an anchor.
SPAN, LEAD = 50, 20
REACH = SPAN - LEAD
#: Strings through a hot lead that hold this many bytes from the anchor on are told apart by those, others by NEAR bytes before it.
FAR = 35
NEAR = SPAN - FAR + 1
#: Bytes of text in a block, and on average behind the anchors of a bucket of hashes and of a bucket of suffixes.
BLOCK_BYTES, HASH_BYTES, RANGE_BYTES = 3 << 19, 96 << 20, 6 << 20
#: Anchors of a task that wait to be sent together, and blocks with one lead from which on it is hot.
WAITING, HOT_LEAD = 3_000_000, 20_000
#: A bucket of hashes is gone through in so many parts (as a power of two), one after another, by the next bits of the hash.
PART_BITS = 3
#: Texts sampled for splitters, at least.
SAMPLE_TEXTS = 512

U64 = np.uint64
_BASE, _MIX = U64(0xD6E8FEB86659FD93), U64(0x9E3779B97F4A7C15)
_MOST = np.iinfo(U64).max


def _byte_values() -> np.ndarray:
    """A 64-bit value for each byte and, last, 0 for what is outside a document."""
    return np.concatenate([np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=U64), np.zeros(1, U64)])


_VALUES = _byte_values()


def rolling(x: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every n neighbours, by doubling."""
    with np.errstate(over="ignore"):
        done, size, power, whole = None, 1, _BASE, x
        taken = 0
        while True:
            if n & size:
                if done is None:
                    done = whole
                else:
                    room = len(x) - taken - size + 1
                    done = done[:room] * power + whole[taken : taken + room]
                taken += size
            if size * 2 > n:
                return done
            room = len(whole) - size
            whole = whole[:room] * power + whole[size:]
            power, size = power * power, size * 2


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        values, size = pick(values[:-size], values[size:]), size * 2
    return pick(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


class Text:
    """The texts of a block in one buffer, each followed by bytes that belong to none."""

    def __init__(self, texts: list[bytes]) -> None:
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths + SPAN) - self.lengths
        self.size = int((self.lengths + SPAN).sum()) + SPAN
        gap = b"\0" * SPAN
        self.bytes = np.frombuffer(gap + b"".join(t + gap for t in texts), np.uint8)

    @functools.cached_property
    def leads(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the LEAD bytes at each place, and the least of them in each whole string (0: none starts there)."""
        inside = np.zeros(self.size, bool)
        for s, n in zip(self.starts.tolist(), self.lengths.tolist(), strict=True):
            if n >= SPAN:
                inside[s : s + n] = True
        values = np.where(inside, _VALUES[self.bytes], U64(0))
        lead = rolling(values, LEAD)
        with np.errstate(over="ignore"):
            lead = (lead ^ (lead >> U64(29))) * _MIX
        lead ^= lead >> U64(32)
        # 0 means none.
        lead = np.where(inside[: len(lead)], np.maximum(lead, U64(1)), U64(0))
        least = _sliding(np.where(lead == 0, _MOST, lead), REACH + 1, np.minimum)
        # A string counts where its first and last byte, so all of it, are in one text.
        count = np.cumsum(inside, dtype=np.int64)
        whole = inside[: len(least)] & (count[SPAN - 1 :][: len(least)] - count[: len(least)] == SPAN - 1)
        return lead, np.where(whole, least, U64(0))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, place in the buffer and hash of the lead of every anchor."""
        lead, least = self.leads
        edge = np.zeros(REACH, U64)
        most = _sliding(np.concatenate([edge, least, edge]), REACH + 1, np.maximum)
        at = np.flatnonzero((most[: len(lead)] == lead) & (lead > 0))
        number = self.numbers(at)
        # Anchors have small hashes; mixed once more they fall evenly into buckets.
        return number, at, mix(lead[at])

    def reach(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far the strings that anchors answer for extend before and from the anchor on.

        They start at ``place - left`` to ``place - (SPAN - right)``, side by side.
        """
        lead, least = self.leads
        left, right = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        for a in range(0, len(places), 1 << 15):
            some = places[a : a + (1 << 15)]
            own = least[some[:, None] + np.arange(-REACH, 1)] == lead[some][:, None]
            left[a : a + len(some)] = REACH - own.argmax(axis=1)
            right[a : a + len(some)] = SPAN - own[:, ::-1].argmax(axis=1)
        return left, right

    def windows(self, places: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The bytes of the strings that anchors answer for, in rows of REACH + SPAN; all others are 0."""
        out = np.zeros((len(places), REACH + SPAN), np.uint8)
        at = np.arange(-REACH, SPAN)
        for a in range(0, len(places), 1 << 15):
            own = slice(a, a + (1 << 15))
            counts = (at >= -left[own, None]) & (at < right[own, None])
            out[own] = np.where(counts, self.bytes[places[own, None] + at], 0)
        return out

    def numbers(self, places: np.ndarray) -> np.ndarray:
        """Numbers of the texts that the places are in."""
        return np.searchsorted(self.starts, places, side="right") - 1


def _write_block(path: str, batch: pa.RecordBatch, **places: np.ndarray) -> None:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    store.write(path, {"bytes": np.frombuffer(out.getvalue(), np.uint8)} | {k: v.astype(np.uint32) for k, v in places.items()})


def _read_block(path: str) -> tuple[pa.RecordBatch, dict[str, np.ndarray]]:
    arrays = store.read(path)
    with pa.ipc.open_stream(pa.py_buffer(np.asarray(arrays["bytes"]))) as r:
        return r.read_next_batch(), {k: np.asarray(v).astype(np.int64) for k, v in arrays.items() if k != "bytes"}


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes]:
    return [b"" if x is None else x for x in batch.column(at).cast(pa.binary()).to_pylist()]


def _ids(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids as numbers, and which documents have one."""
    column = batch.column(at)
    try:
        column = column.cast(pa.int64())
    except pa.ArrowInvalid:
        column = pa.array([_number(x) for x in column.to_pylist()], pa.int64())
    return column.fill_null(0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)


def _number(value: object) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def _joined(parts: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def _repeats(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows equal the row before."""
    same = np.ones(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        same &= c[1:] == c[:-1]
    return np.concatenate([[False], same])[: len(columns[0])]


def _within(text: Text, ids: np.ndarray, at: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors, sorted by lead, have a window that a smaller document of the block has too; and the anchors that share a lead."""
    again = _repeats(lead)
    some = np.flatnonzero(again | np.append(again[1:], False))
    gone = np.zeros(len(at), bool)
    if len(some):
        left, right = text.reach(at[some])
        window = text.windows(at[some], left, right)
        rows = np.concatenate([lead[some].astype(">u8").view(np.uint8).reshape(-1, 8), window, left.astype(np.uint8)[:, None], right.astype(np.uint8)[:, None]], axis=1)
        order = multikey_order(rows)
        same = common_prefixes(rows, order) == rows.shape[1]
        doc = ids[text.numbers(at[some])[order]]
        first = np.flatnonzero(~same)
        least = np.minimum.reduceat(doc, first)[np.cumsum(~same) - 1]
        gone[some[order[doc > least]]] = True
    return gone, some


class _Sender:
    """Anchors of the blocks of a task, given out as one row for each bucket of hashes that has some."""

    def __init__(self, task: str, bits: int, width: int, waiting: int) -> None:
        self.task, self.bits, self.width, self.waiting = task, bits, width, waiting
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.blocks: list[int] = []
        self.held = 0

    def add(self, block: int, lead: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((lead >> U64(64 - self.width), np.full(len(lead), block, np.uint32), place.astype(np.uint32)))
        self.blocks.append(block)
        self.held += len(lead)
        if self.held >= self.waiting:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.blocks:
            return
        lead, block, place = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(lead, kind="stable")
        lead, block, place = lead[order], block[order], place[order]
        cut = min(PART_BITS, self.width - self.bits)
        bounds = np.arange(1 << (self.bits + cut), dtype=U64) << U64(self.width - self.bits - cut)
        edges = [*np.searchsorted(lead, bounds).tolist(), len(lead)]
        part = lambda k: slice(edges[k], edges[k + 1])
        rows = [b for b in range(1 << self.bits) if edges[b << cut] < edges[(b + 1) << cut]]
        data = [[packed.squeeze(np.diff(lead[part(k)], prepend=bounds[k]), block[part(k)], place[part(k)]) for k in range(b << cut, (b + 1) << cut)] for b in rows]
        # Blocks without anchors take part too, so that their texts come back.
        home = hash_of(self.task) % (1 << self.bits)
        columns = [[*rows, home], [self.task] * (len(rows) + 1), [*data, None], [None] * len(rows) + [np.array(self.blocks, np.uint32).tobytes()]]
        kinds = (pa.int64(), pa.string(), pa.list_(pa.binary()), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["bucket", "task", "anchors", "blocks"])
        self.parts, self.blocks, self.held = [], [], 0


def _path(task: str, block: int) -> str:
    return f"{task}-{block:06d}"


def _first_pass(docs: DataFrame, folder: str, bits: int, width: int, id_at: int, text_at: int) -> DataFrame:
    """Write the blocks; rows (bucket, task, anchors, blocks) with ``width`` bits of the hash of each lead of a block, in parts by its leading bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("suffixes", dict)
        sender, made = _Sender(f"{folder}/b-{TaskContext.get().partitionId():06d}", bits, width, WAITING), 0
        for batch in batches:
            sizes = batch.column(text_at).cast(pa.binary())
            sizes = np.array([0 if n is None else n for n in pc.binary_length(sizes).to_pylist()], np.int64)
            for a, b in slices(sizes.tolist(), BLOCK_BYTES):
                part = batch.slice(a, b - a)
                text = Text(_texts(part, text_at))
                ids, valid = _ids(part, id_at)
                number, at, lead = text.anchors()
                keep = valid[number]
                order = np.argsort(lead[keep], kind="stable")
                at, lead = at[keep][order], lead[keep][order]
                gone, some = _within(text, ids, at, lead)
                # One anchor of each lead stands for those that stay; leads of several documents are open already.
                stay = some[~gone[some]]
                first = np.flatnonzero(~_repeats(lead[stay]))
                sizes_of = np.diff(np.append(first, len(stay)))
                doc = ids[text.numbers(at[stay])]
                several = np.zeros(0, bool)
                if len(first):
                    several = np.repeat(np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first), sizes_of)
                stands = np.repeat(stay[first], sizes_of)
                _write_block(_path(sender.task, made), part, settled=at[gone], open=at[stay[several]], twin=at[stay], stands=at[stands])
                sent = np.ones(len(at), bool)
                sent[some] = False
                sent[stay[first]] = True
                yield from sender.add(made, lead[sent], at[sent])
                made += 1
        yield from sender.flush()

    return docs.mapInArrow(run, "bucket long, task string, anchors array<binary>, blocks binary")


def _shared(parts: list[pa.Buffer], hot_lead: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of anchors whose lead comes again in any of the parts: number of the part, block, places, and which are hot."""
    leads, blocks, places = [], [], []
    for data in parts:
        gaps, block, place = packed.expand(data)
        leads.append(np.cumsum(gaps, dtype=U64))
        blocks.append(block.astype(np.uint32))
        places.append(place.astype(np.uint32))
    lead = np.concatenate(leads)
    row = np.repeat(np.arange(len(parts)), [len(x) for x in leads])
    order = np.argsort(lead, kind="stable")
    first = np.flatnonzero(~_repeats(lead[order]))
    sizes = np.diff(np.append(first, len(order)))
    count = np.repeat(sizes, sizes)
    found, hot = order[count > 1], (count > hot_lead)[count > 1]
    block, place = np.concatenate(blocks)[found], np.concatenate(places)[found]
    key = row[found].astype(U64) << U64(32) | block.astype(U64)
    by = np.argsort(key, kind="stable")
    for a, e in _spans(key[by]):
        own = by[a:e]
        yield int(key[own[0]] >> U64(32)), int(block[own[0]]), place[own], hot[own]


def _meet(hot_lead: int):
    """For a bucket: one row for each block with anchors whose lead other blocks may have: block, places, hot ones among them."""

    def run(table: pa.Table) -> pa.Table:
        held("suffixes", dict)
        task, rows, out = [], [], {}
        for t, anchors, own in zip(*(table[c] for c in ("task", "anchors", "blocks")), strict=True):
            name = t.as_py()
            if own.is_valid:
                out |= {(name, int(b)): ([], []) for b in np.frombuffer(own.as_buffer(), np.uint32) if (name, int(b)) not in out}
            if anchors.is_valid:
                task.append(name)
                rows.append(anchors.values)
        # Equal leads are in the same part, so one part is in memory at a time.
        for k in range(len(rows[0]) if rows else 0):
            for row, block, place, hot in _shared([x[k].as_buffer() for x in rows], hot_lead):
                found = out.setdefault((task[row], block), ([], []))
                found[0].append(place.tobytes())
                found[1].append(place[hot].tobytes())
        places, hot = ([b"".join(x[i]) for x in out.values()] for i in (0, 1))
        return pa.table({"block": pa.array([_path(*name) for name in out], pa.string()), "open": pa.array(places, pa.binary()), "hot": pa.array(hot, pa.binary())})

    return run


def _spans(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal neighbours."""
    edges = np.flatnonzero(~_repeats(values)) if len(values) else np.zeros(0, np.int64)
    return zip(edges.tolist(), [*edges[1:].tolist(), len(values)], strict=False)


def _starts(text: Text, places: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Flags of the places where a string that one of the anchors answers for starts."""
    step = np.zeros(text.size + 1, np.int32)
    np.add.at(step, places - left, 1)
    np.add.at(step, places - SPAN + right + 1, -1)
    return np.cumsum(step)[:-1] > 0


def _inside(text: Text) -> np.ndarray:
    """Flags of the places where a whole string starts."""
    flags = np.zeros(text.size, bool)
    for s, n in zip(text.starts.tolist(), text.lengths.tolist(), strict=True):
        if n >= SPAN:
            flags[s : s + n - SPAN + 1] = True
    return flags


#: How suffixes were dealt: by their leading bytes, or, those of hot leads, by the bytes behind and before it.
ALL, BEHIND, BEFORE = 0, 1, 2


_CODEC = pa.Codec("zstd", 3)


def _squeezed(window: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, place: np.ndarray) -> bytes:
    """Suffixes of one block as few bytes, in the order of their leading bytes."""
    order = np.lexsort(_characters(window[:, REACH : REACH + 16])[::-1])
    head = packed.squeeze(left[order], right[order], doc[order].view(U64), place[order])
    return len(head).to_bytes(4, "little") + head + _CODEC.compress(window[order].tobytes(), asbytes=True)


def _expanded(data: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = memoryview(data)
    size = int.from_bytes(data[:4], "little")
    left, right, doc, place = packed.expand(data[4 : 4 + size])
    n = len(left) * (REACH + SPAN)
    raw = _CODEC.decompress(data[4 + size :], n) if n else b""
    return np.frombuffer(raw, np.uint8).reshape(-1, REACH + SPAN), left.astype(np.int64), right.astype(np.int64), doc.view(np.int64), place.astype(np.int64)


def _bytes_hash(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), U64)
    for character in _characters(rows):
        out = mix(out * _BASE + character)
    return out


def _open_suffixes(splitters: np.ndarray, id_at: int, text_at: int):
    """For one block: keep what is settled, send the suffixes of open anchors to their buckets."""
    buckets = len(splitters) + 1

    def run(table: pa.Table) -> pa.Table:
        held("suffixes", dict)
        path = table["block"][0].as_py()
        batch, own = _read_block(path)
        text = Text(_texts(batch, text_at))
        ids, _ = _ids(batch, id_at)
        whole = _inside(text)
        known = _starts(text, own["settled"], *text.reach(own["settled"])) & whole
        store.write(f"{path}.known", {"bits": np.packbits(known)})
        met, hot = (_joined(table[c].to_pylist(), np.uint32).astype(np.int64) for c in ("open", "hot"))
        twins = lambda x: np.union1d(x, own["twin"][np.isin(own["stands"], x)])
        hot = twins(hot)
        places = np.union1d(twins(met), own["open"])
        # An anchor is open only while a string through it is not known to repeat.
        wanted = np.cumsum(np.concatenate([[0], whole & ~known]))
        left, right = text.reach(places)
        needed = wanted[places - SPAN + right + 1] > wanted[places - left]
        places, left, right = places[needed], left[needed], right[needed]
        number, window = text.numbers(places), text.windows(places, left, right)
        is_hot = np.isin(places, hot)
        with np.errstate(over="ignore"):
            # Those that answer for a string of the kind; its bytes are there then.
            behind = np.flatnonzero(is_hot & (right >= FAR))
            before = np.flatnonzero(is_hot & (left >= NEAR))
            plain = np.flatnonzero(~is_hot)
            lead = _characters(window[plain, REACH : REACH + 8])[0]
            keys = [
                (ALL, plain, np.searchsorted(splitters, lead, side="right")),
                (BEHIND, behind, (_bytes_hash(window[behind, REACH : REACH + FAR]) % U64(buckets)).astype(np.int64)),
                (BEFORE, before, (_bytes_hash(window[before, REACH - NEAR : REACH + LEAD]) % U64(buckets)).astype(np.int64)),
            ]
        rows = {"bucket": [], "kind": [], "block": [], "suffixes": []}
        # A block with nothing open still takes part, so that its texts come back.
        home = hash_of(path) % buckets
        for kind, at, bucket in keys:
            order = np.argsort(bucket, kind="stable")
            for a, e in [*_spans(bucket[order]), *([(0, 0)] if kind == ALL else [])]:
                some = at[order[a:e]]
                data = _squeezed(window[some], left[some], right[some], ids[number[some]], places[some])
                for column, value in zip(rows.values(), (int(bucket[order[a]]) if e else home, kind, path, data), strict=True):
                    column.append(value)
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.binary()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(rows.items(), kinds, strict=True)})

    return run


def hash_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "little")


def _characters(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as columns of 8-byte characters that compare as the bytes do."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return [c.astype(U64) for c in padded.view(">u8").T]


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """Order of equally long byte strings by multikey quicksort over 8-byte characters.

    Sorts by one character at a time, and by the next only within runs of
    strings that are equal so far.
    """
    order, tied = np.arange(len(rows)), np.arange(len(rows))
    run = np.zeros(len(rows), np.int64)
    for character in _characters(rows):
        if not len(tied):
            break
        own = order[tied]
        inner = np.lexsort((character[own], run[tied]))
        order[tied] = own[inner]
        same = _repeats(run[tied], character[order[tied]])
        run[tied] = tied[np.maximum.accumulate(np.where(same, 0, np.arange(len(tied))))]
        tied = tied[same | np.append(same[1:], False)]
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the prefix each string shares with the one before in the order."""
    out = np.zeros(len(order), np.int16)
    for a in range(1, len(order), 1 << 16):
        one, two = rows[order[a - 1 : a - 1 + (1 << 16)]], rows[order[a : a + (1 << 16)]]
        differ = one[: len(two)] != two
        out[a : a + len(two)] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def _compare(table: pa.Table) -> pa.Table:
    """Strings through the open anchors of one bucket that repeat from a smaller document.

    Among suffixes dealt by the bytes behind or before their lead, only strings
    that hold those bytes are compared.
    """
    held("suffixes", dict)
    least, most = {ALL: (0, REACH), BEHIND: (0, SPAN - FAR), BEFORE: (NEAR, REACH)}[table["kind"][0].as_py()]
    blocks = table["block"].to_pylist()
    parts = [_expanded(x.as_buffer()) for x in table["suffixes"]]
    counts = [len(p[1]) for p in parts]
    window, left, right, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    row = np.repeat(np.arange(len(counts)), counts)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if len(place):
        order = multikey_order(window[:, REACH:])
        shared = common_prefixes(window[:, REACH:], order)
        # Runs that share the lead; runs of one document only have no source.
        run = np.cumsum(shared < LEAD) - 1
        begin = np.flatnonzero(shared < LEAD)
        several = np.minimum.reduceat(doc[order], begin) < np.maximum.reduceat(doc[order], begin)
        keep = several[run]
        shared = np.where(shared < LEAD, 0, shared)[keep]
        order, run = order[keep], run[keep]
        reversed_left = window[order, :REACH][:, ::-1]
        by_left = np.lexsort((_rank(reversed_left), run))
        shared_left = np.where(_repeats(run[by_left]), common_prefixes(reversed_left, by_left), -1)
        d, r, l, p, w = doc[order], right[order], left[order], place[order], row[order]
        for before in range(least, most + 1):
            fits = np.flatnonzero((l >= before) & (r >= SPAN - before))
            if len(fits) < 2:
                continue
            tails = np.cumsum(shared < SPAN - before)
            heads = np.zeros(len(order), np.int64)
            heads[by_left] = np.cumsum(shared_left < before) if before else np.cumsum(shared_left < 0)
            key = tails[fits] * (len(order) + 1) + heads[fits]
            sort = np.argsort(key, kind="stable")
            first = ~_repeats(key[sort])
            source = np.minimum.reduceat(d[fits[sort]], np.flatnonzero(first))[np.cumsum(first) - 1]
            hit = fits[sort[d[fits[sort]] > source]]
            found.append((w[hit], p[hit] - before))
    rows = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    starts = np.concatenate([f[1] for f in found]).astype(np.uint32) if found else np.zeros(0, np.uint32)
    order = np.argsort(rows, kind="stable")
    ends = np.searchsorted(rows[order], np.arange(len(counts) + 1))
    data = [_runs(starts[order[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.table({"block": pa.array(blocks, pa.string()), "starts": pa.array(data, pa.binary())})


def _runs(starts: np.ndarray) -> bytes:
    """Places as runs of neighbours: the gaps between their beginnings, and their lengths."""
    starts = np.unique(starts).astype(np.int64)
    first = np.flatnonzero(np.diff(starts, prepend=-2) != 1)
    return packed.squeeze(np.diff(starts[first], prepend=0), np.diff(np.append(first, len(starts))))


def _rank(rows: np.ndarray) -> np.ndarray:
    """Rank of each byte string in multikey order."""
    order = multikey_order(rows)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank


def _removed(path: str, marks: list[bytes], text_at: int) -> tuple[pa.RecordBatch, Text, np.ndarray]:
    """Block, texts, and a flag for each byte of the buffer that goes."""
    held("suffixes", dict)
    batch, _ = _read_block(path)
    text = Text(_texts(batch, text_at))
    starts = np.unpackbits(np.asarray(store.read(f"{path}.known")["bits"]), count=text.size).astype(bool)
    edges = np.zeros(text.size + 1, np.int32)
    for gaps, lengths in map(packed.expand, marks):
        begin = np.cumsum(gaps).astype(np.int64)
        np.add.at(edges, begin, 1)
        np.add.at(edges, begin + lengths.astype(np.int64), -1)
    starts |= np.cumsum(edges[:-1]) > 0
    step = np.diff(starts.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    cover = np.zeros(text.size + SPAN + 1, np.int32)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    np.add.at(cover, begin, 1)
    np.add.at(cover, end + SPAN - 1, -1)
    return batch, text, np.cumsum(cover)[: text.size] > 0


def _digest(text_at: int, id_at: int):
    def run(table: pa.Table) -> pa.Table:
        batch, text, gone = _removed(table["block"][0].as_py(), table["starts"].to_pylist(), text_at)
        count = np.concatenate([[0], np.cumsum(gone)])
        spans = np.concatenate([[0], np.cumsum(np.diff(gone.astype(np.int8), prepend=np.int8(0)) == 1)])
        removed = count[text.starts + text.lengths] - count[text.starts]
        pieces = spans[text.starts + text.lengths] - spans[text.starts]
        sha = []
        for s, n, r in zip(text.starts.tolist(), text.lengths.tolist(), removed.tolist(), strict=True):
            own = text.bytes[s : s + n]
            sha.append(hashlib.sha256((own[~gone[s : s + n]] if r else own).tobytes()).hexdigest())
        return pa.table({"doc_id": batch.column(id_at), "n_bytes": pa.array(text.lengths), "n_removed": pa.array(removed), "n_spans": pa.array(pieces), "kept_sha256": pa.array(sha)})

    return run


def _kept(text_at: int, chars_at: int | None):
    def run(table: pa.Table) -> pa.Table:
        batch, text, gone = _removed(table["block"][0].as_py(), table["starts"].to_pylist(), text_at)
        texts, stays = batch.column(text_at).to_pylist(), []
        for i, (s, n) in enumerate(zip(text.starts.tolist(), text.lengths.tolist(), strict=True)):
            flags = gone[s : s + n]
            if flags.any():
                texts[i] = text.bytes[s : s + n][~flags].tobytes().decode("utf-8", "ignore")
            stays.append(not n or bool(texts[i]))
        columns = list(batch.columns)
        columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
        if chars_at is not None:
            changed = [c if t is None else len(t) for t, c in zip(texts, batch.column(chars_at).to_pylist(), strict=True)]
            columns[chars_at] = pa.array(changed, batch.schema.field(chars_at).type)
        return pa.table(columns, batch.schema.names).filter(pa.array(stays, pa.bool_()))

    return run


def _splitters(docs: DataFrame, text_col: str, buckets: int, texts: int) -> np.ndarray:
    """Leading characters that cut sampled suffixes into ``buckets`` even shares.

    The sample is about SAMPLE_TEXTS of ``texts`` texts, or one for 16 buckets,
    by hash, 4,096 characters of each.  It only balances the buckets; every
    suffix is dealt by the splitters.
    """
    wanted = max(SAMPLE_TEXTS, buckets // 16)
    h = F.xxhash64(F.substring(text_col, 1, 64))
    rows = docs.filter(F.col(text_col).isNotNull() & (F.pmod(h, F.lit(max(1, texts // wanted))) == 0))
    sample = rows.select(F.substring(text_col, 1, 4096).alias("t")).limit(4 * wanted)
    text = Text([r.t.encode() for r in sample.collect()])
    _, at, _ = text.anchors()
    if buckets < 2 or not len(at):
        return np.zeros(0, U64)
    lead = np.sort(_characters(text.bytes[at[:, None] + np.arange(16)])[0])
    return np.unique(lead[np.arange(1, buckets) * len(lead) // buckets])


def _width(size: int, bits: int) -> int:
    """So many bits of a lead's hash that different leads hardly ever agree by chance."""
    return min(64, max(40, bits, size.bit_length() + 8))


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (block, starts): places in each block where a repeated string starts, beside those already known."""
    folder = fresh_path(docs.sparkSession, "suffixes")
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    found = docs.agg(F.sum(F.octet_length(text_col)).alias("size"), F.count(F.lit(1)).alias("texts")).collect()[0]
    size = found.size or 0
    bits = max(0, (size // HASH_BYTES).bit_length())
    width = _width(size, bits)
    splitters = _splitters(docs, text_col, size // RANGE_BYTES + 1, found.texts)
    anchors = _first_pass(docs, folder, bits, width, id_at, text_at)
    # Written, so that the hashes need no more room while the suffixes travel.
    met = stash(anchors.groupBy("bucket").applyInArrow(_meet(HOT_LEAD), "block string, open binary, hot binary"), "suffixes-open")
    open_rows = met.groupBy("block").applyInArrow(_open_suffixes(splitters, id_at, text_at), "bucket long, kind int, block string, suffixes binary")
    return open_rows.groupBy("bucket", "kind").applyInArrow(_compare, "block string, starts binary")


def substring_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes; a null text is empty.  Ids are integers or what casts
    to one; a document with a null or other id
    neither loses bytes nor counts as a source; documents with the same id take
    nothing from each other.  Strings are judged on the input, not on what is
    left.  An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    marks = _marked(docs, "doc_id", "text")
    return marks.groupBy("block").applyInArrow(_digest(1, 0), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents with repeated strings removed, with all their columns.

    Parts of a character that a cut leaves are dropped; ``chars_col``, if there
    is one, is counted anew.  Documents of which nothing is left are gone.
    """
    marks = _marked(docs, id_col, text_col)
    chars_at = docs.columns.index(chars_col) if chars_col in docs.columns else None
    return marks.groupBy("block").applyInArrow(_kept(docs.columns.index(text_col), chars_at), docs.schema)
