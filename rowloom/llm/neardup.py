"""Near-duplicate groups by BagMinHash over multisets of word shingles.

A text is the multiset of its five-word shingles (lower case A-Z, words between
ASCII white space; a shorter text is one shingle of all its words).  Two texts
are linked where the weighted Jaccard similarity of their multisets, the sum of
lesser counts over the sum of greater counts, is at least THRESHOLD.  Groups are
the connected components of the links.

Signatures.  For each shingle, points of Poisson processes over the plane of
weight and time are drawn from its hash alone: one process for the weights
below 1, and one for each range from a power of two to the next, at a rate equal
to its width; halving a range by further hash bits gives a point's integer weight
level.  A point counts for a text where its level is below the shingle's count,
and goes to one of SIZE components, which keeps the earliest time.  Points are
drawn in the order of time only while they can still be the earliest, so that
few are needed.  Two texts agree in a component with a probability equal to
their similarity.

Candidates.  Texts with equal multisets are one node.  Nodes that agree in a
band of ROWS components share a bucket; each is first compared with the least
node of the bucket only.  Where nodes of a bucket are still in different groups
after that, every node outside the bucket's largest group is compared with all nodes
of other groups there, likeliest first, where the bucket is: only links that join
groups leave the task, so a group of n texts yields fewer than n links and never
its pairs.  Pairs whose signatures agree in less than LIKELY of the components
are too far below the threshold to be read.

Large mixed buckets.  Texts with much in common can share a bucket without being
near duplicates, and then there are as many groups as texts.  Nodes of such
buckets of more than SMALL_BUCKET meet by their rare shingles instead.  With the
shingles of all multisets in one order, two multisets similar enough share one of
those that begin within the first (1 - THRESHOLD) of either's weight; in an order
by rising frequency (counted in a table of fixed size; any order is right) these
are rare ones, and what is common to a bucket stands at the end.  So nothing is
lost, and a node costs a row for each rare shingle, however large the bucket.
Where many nodes of different groups share even a rare shingle, they are dealt
into pairs of parts of bounded size.

Every candidate is verified on the exact multisets (48 bits of each shingle's
hash, with full counts).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.arrow import coded_words, slices
from rowloom.llm.scratch import result_only, salts, stash
from rowloom.llm.workers import held

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
SIZE = BANDS * ROWS
#: Agreement of signatures below which a pair is not read: five deviations under the threshold.
LIKELY = 0.55
#: Candidates compared at once, and nodes of a bucket that are compared in one task.
NEAREST, SMALL_BUCKET = 64, 500
#: Nodes that share a rare shingle and are paired directly, and nodes of a part beyond that.
FEW_NODES, PART_NODES = 32, 250
#: Size, as a power of two, of the table that counts shingles, and of the parts it travels in.
TABLE_BITS, CHUNK_BITS = 20, 16
#: Pairs of one node from which on its row is dealt to several tasks.
HOT_PAIRS = 5_000
SLICE_CHARS = 1_000_000

U64 = np.uint64
_BASE = U64(0x9FB21C651E98DF25)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def bags_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle multisets of texts: text number, shingle hash and count, sorted by text and hash."""
    words, number, lengths = coded_words(texts)
    flat = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))[number]
    starts = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths)), lengths)
    with np.errstate(over="ignore"):
        n = max(0, len(flat) - SHINGLE + 1)
        h = np.zeros(n, U64)
        for i in range(SHINGLE):
            h = h * _BASE + flat[i : i + n]
        whole = doc[:n] == doc[SHINGLE - 1 :][:n] if n else np.zeros(0, bool)
        h, owner = h[whole], doc[:n][whole]
        short = np.flatnonzero((lengths > 0) & (lengths < SHINGLE))
        if len(short):
            extra = np.zeros(len(short), U64)
            for k, d in enumerate(short):
                for x in flat[starts[d] : starts[d] + lengths[d]]:
                    extra[k] = extra[k] * _BASE + x
            h, owner = np.concatenate([h, extra + U64(1)]), np.concatenate([owner, short])
    h = mix(h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return owner[at], h[at], np.diff(np.append(at, len(h)))


def signatures(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int, size: int = SIZE) -> np.ndarray:
    """BagMinHash: for each text and component the 64-bit name of its earliest point (0: none)."""
    best = np.full(texts * size, np.inf)
    # One process for weights below 1 and one for each range [2**(j - 1), 2**j) below the count.
    ranges = np.frexp((weight - 1).astype(np.float64))[1]
    item = np.repeat(np.arange(len(h)), ranges + 1)
    j = np.arange(len(item)) - np.repeat(np.cumsum(ranges + 1) - ranges - 1, ranges + 1)
    lower = np.where(j > 0, 1 << np.maximum(j - 1, 0), 0)
    width = np.maximum(lower, 1)
    seed = mix(h[item] + j.astype(U64) * _BASE)
    own, most = owner[item], weight[item]
    time, step = np.zeros(len(item)), 0
    with np.errstate(over="ignore"):
        while len(own):
            step += 1
            name = mix(seed + U64(step) * U64(0xD1342543DE82EF95))
            time = time - np.log((name >> U64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / width
            more = mix(name)
            level = lower + ((more >> U64(32)) % width.astype(U64)).astype(np.int64)
            counts = np.flatnonzero(level < most)
            cell = own[counts] * size + (more[counts] & U64(size - 1)).astype(np.int64)
            np.minimum.at(best, cell, time[counts])
            bound = best.reshape(texts, size).max(axis=1)
            go = time < bound[own]
            seed, own, most, time, lower, width = seed[go], own[go], most[go], time[go], lower[go], width[go]
    return np.where(np.isinf(best), U64(0), mix(best.view(U64))).reshape(texts, size)


def bands_of(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = sig.reshape(len(sig), BANDS, ROWS)
        h = np.zeros((len(sig), BANDS), U64) + np.arange(BANDS, dtype=U64)
        for r in range(ROWS):
            h = mix(h * _BASE + parts[:, :, r])
    return h.view(np.int64)


def _text_slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    return slices(pc.fill_null(pc.binary_length(column), 0).to_pylist(), SLICE_CHARS)


def _sums(owner: np.ndarray, values: np.ndarray, texts: int) -> np.ndarray:
    out = np.zeros(texts, U64)
    if len(owner):
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        out[owner[first]] = np.add.reduceat(values, first)
    return out


def _names(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name a multiset."""
    with np.errstate(over="ignore"):
        w = weight.astype(U64)
        return tuple(_sums(owner, mix(mix(h ^ U64(salt)) + w), texts).view(np.int64) for salt in (1, 2))


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per text with words: doc_id, name1, name2, size, sig, bands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("neardup", dict)
        for batch in batches:
            for a, b in _text_slices(batch.column(1)):
                owner, h, weight = bags_of(batch.column(1).slice(a, b - a))
                sig = signatures(owner, h, weight, b - a)
                one, two = _names(owner, h, weight, b - a)
                size = _sums(owner, weight.astype(U64), b - a).view(np.int64)
                rows = np.flatnonzero(size)
                short = (sig[rows] >> U64(48)).astype(np.uint16)
                bands = bands_of(sig[rows])
                ends = pa.array(np.arange(len(rows) + 1) * BANDS, pa.int32())
                arrays = [batch.column(0).slice(a, b - a).take(pa.array(rows)), *(pa.array(x[rows]) for x in (one, two, size)), pa.array([s.tobytes() for s in short], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(bands.ravel()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "name1", "name2", "size", "sig", "bands"])

    rows = docs.filter(F.col(id_col).try_cast("long").isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).try_cast("long"), text_col)
    return rows.mapInArrow(run, "doc_id long, name1 long, name2 long, size long, sig binary, bands array<long>")


def _least(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """``rows`` with the least value of their key, through (key, salt) so that no key is hot."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(value), F.lit(salts(rows.sparkSession))).cast("int"))
    part = rows.groupBy(*key, "salt").agg(F.min(value).alias("least"))
    whole = part.groupBy(*key).agg(F.min("least").alias("least"))
    return rows.join(part.select(*key, "salt").join(whole, key), [*key, "salt"]).drop("salt")


def _bag_table(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Multisets of the wanted nodes: node, bag (see ``_packed``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("neardup", dict)
        for batch in batches:
            for a, b in _text_slices(batch.column(3)):
                owner, h, weight = bags_of(batch.column(3).slice(a, b - a))
                one, two = _names(owner, h, weight, b - a)
                meant = (one == batch.column(1).to_numpy()[a:b]) & (two == batch.column(2).to_numpy()[a:b])
                ends = np.searchsorted(owner, np.arange(b - a + 1))
                data = [_packed(h[x:y], weight[x:y]) if m else None for x, y, m in zip(ends[:-1], ends[1:], meant, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(data, pa.binary())], ["node", "bag"])

    rows = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = wanted.hint("merge").join(rows, wanted["least"] == rows["doc_id"]).select("node", "name1", "name2", "text")
    out = rows.mapInArrow(run, "node long, bag binary").filter("bag IS NOT NULL")
    return stash(out, "neardup-bags")


def _packed(h: np.ndarray, weight: np.ndarray) -> bytes:
    """A multiset as bytes: 48 bits of each shingle's hash in order; behind them place and count of those counted more than once.

    Ends with the number of the latter.
    """
    h = h >> U64(16)
    if len(h) > 1 and (h[1:] == h[:-1]).any():
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        h, weight = h[first], np.add.reduceat(weight, first)
    more = np.flatnonzero(weight > 1)
    return h.view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + more.astype("<u8").tobytes() + weight[more].astype("<u8").tobytes() + len(more).to_bytes(8, "little")


def _unpacked(bag: memoryview) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order, and how often each occurs."""
    more = int.from_bytes(bag[-8:], "little")
    end = len(bag) - 8 - 16 * more
    raw = np.zeros((end // 6, 8), np.uint8)
    raw[:, :6] = np.frombuffer(bag[:end], np.uint8).reshape(-1, 6)
    count = np.ones(len(raw), np.int64)
    if more:
        place, several = np.frombuffer(bag[end:-8], "<u8").reshape(2, -1).astype(np.int64)
        count[place] = several
    return raw.view(U64).ravel(), count


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets, each as distinct values in order and their counts."""
    _, one, two = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][one], b[1][two]).sum())
    return shared / max(1, int(a[1].sum()) + int(b[1].sum()) - shared)


def _dealt(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs, a written table, with the row of their ``a``; a node of many pairs is dealt to several tasks, with copies of its row."""
    hot = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_PAIRS)
    hot = stash(hot.select("a", F.ceil(F.col("n") / HOT_PAIRS).cast("int").alias("copies")), "neardup-hot")
    if hot.isEmpty():
        return pairs.join(rows, "a")
    pairs = pairs.join(hot, "a", "left").withColumn("copy", F.when(F.col("copies").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("copies"))).cast("int")).drop("copies")
    every = F.when(F.col("copies").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("copies") - 1))
    rows = rows.join(hot, "a", "left").withColumn("copy", F.explode(every)).drop("copies")
    return pairs.join(rows, ["a", "copy"]).drop("copy")


def _verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(k) for k in (2, 3))
            kept = [overlap(_unpacked(x.as_buffer()), _unpacked(y.as_buffer())) >= THRESHOLD for x, y in zip(one, two, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    two = bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
    both = _dealt(pairs.select("a", "b"), bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))).join(two, "b")
    return both.select("a", "b", "bag_a", "bag_b").mapInArrow(run, "a long, b long")


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that sizes and signatures do not rule out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, SIZE) for k in (2, 3))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array((one == two).mean(axis=1) >= LIKELY))

    one, two = (nodes.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("size").alias(f"size_{c}")) for c in "ab")
    rows = pairs.join(one, "a").join(two, "b").filter(F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * THRESHOLD)
    return rows.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (node, label), the label being the least node that links lead to.

    Labels pass along links and then to the label's own label, until none
    changes; each round is written to the shared folder.
    """
    both = stash(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stash(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        nearer = stash(labels.join(heard, "node", "left").select("node", "label", F.least("label", F.coalesce("heard", "label")).alias("next")), "labels")
        jump = nearer.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = stash(nearer.join(jump, "next").select("node", "far", (F.col("far") != F.col("label")).alias("changed")), "labels")
        labels = after.select("node", F.col("far").alias("label"))
        if after.filter("changed").isEmpty():
            break
    return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Groups after more links: components of the groups, which are far fewer than the nodes."""
    one, two = (groups.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab")
    between = links.join(one, "a").join(two, "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    between = stash(between.filter("a != b").distinct(), "neardup-between")
    merged = components(groups.select(F.col("label").alias("node")).distinct(), between)
    return groups.join(merged.select(F.col("node").alias("label"), F.col("label").alias("least")), "label").select("node", F.col("least").alias("label"))


def _keys(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Multisets one after the other: hashes, their counts, where each multiset begins, and its size."""
    parts = [_unpacked(memoryview(b)) for b in bags]
    h, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    ends = np.concatenate([[0], np.cumsum([len(x) for x, _ in parts])])
    return h, count, ends, np.add.reduceat(count, ends[:-1])


def _similar(keys: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], i: int, others: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of multiset i with others."""
    h, count, ends, size = keys
    own, own_count = h[ends[i] : ends[i + 1]], count[ends[i] : ends[i + 1]]
    sizes = ends[others + 1] - ends[others]
    begin = np.cumsum(sizes) - sizes
    theirs = np.repeat(ends[others] - begin, sizes) + np.arange(sizes.sum())
    at = np.minimum(np.searchsorted(own, h[theirs]), len(own) - 1)
    both = np.where(own[at] == h[theirs], np.minimum(own_count[at], count[theirs]), 0)
    shared = np.add.reduceat(both, begin)
    return shared / (size[i] + size[others] - shared)


def _across(table: pa.Table) -> pa.Table:
    """Links between different groups of a bucket or of a pair of parts, as few as join what belongs together.

    In a bucket (``side`` -1) nodes outside its largest group are compared with
    all nodes of other groups, in the first band only that two nodes share; in a
    pair of parts, those of one with those of the other.  What signatures rule
    out is not read.
    """
    band = table["band"][0].as_py()
    node, side = table["node"].to_numpy(), table["side"].to_numpy()
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, SIZE)
    bands = np.concatenate([c.flatten().to_numpy() for c in table["bands"].chunks]).reshape(-1, BANDS)
    _, group, members = np.unique(table["label"].to_numpy(), return_inverse=True, return_counts=True)
    keys = _keys(table["bag"].to_pylist())
    size = keys[3]
    if side[0] < 0:
        first, other = np.flatnonzero(group != members.argmax()), side < 0
    else:
        first, other = np.flatnonzero(side == 0), side == side.max()
    out: list[tuple[int, int]] = []
    for i in first:
        near = np.flatnonzero(other & (group != group[i]) & (np.minimum(size, size[i]) >= THRESHOLD * np.maximum(size, size[i])))
        if side[0] < 0:
            near = near[(bands[near, :band] == bands[i, :band]).sum(axis=1) == 0]
        agree = (sig[near] == sig[i]).mean(axis=1)
        near = near[agree >= LIKELY][np.argsort(-agree[agree >= LIKELY], kind="stable")]
        while len(near):
            some, near = near[:NEAREST], near[NEAREST:]
            for k in some[_similar(keys, i, some) >= THRESHOLD]:
                if group[k] != group[i]:
                    out.append((min(node[i], node[k]), max(node[i], node[k])))
                    group[group == group[k]] = group[i]
            near = near[group[near] != group[i]]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


_ACROSS = ("node", "label", "side", "sig", "bands", "bag")


def _slots(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> U64(64 - TABLE_BITS)).astype(np.int64)


def _frequencies(bags: DataFrame) -> np.ndarray:
    """In how many multisets the shingles of each slot of the table occur; 2**TABLE_BITS numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << TABLE_BITS, np.uint64)
        for batch in batches:
            for bag in batch.column(0):
                np.add.at(count, _slots(_unpacked(bag.as_buffer())[0]), U64(1))
        parts = [x.astype("<u8").tobytes() for x in count.reshape(-1, 1 << CHUNK_BITS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], ["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), "<u8") for x in table["counts"])
        return pa.table({"chunk": table["chunk"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk long, counts binary"
    found = bags.select("bag").mapInArrow(run, schema).groupBy("chunk").applyInArrow(add, schema).collect()
    out = np.zeros((1 << TABLE_BITS - CHUNK_BITS, 1 << CHUNK_BITS), np.uint64)
    for r in found:
        out[r.chunk] = np.frombuffer(r.counts, "<u8")
    return out.ravel()


def _rare(rows: DataFrame, count: np.ndarray) -> DataFrame:
    """For each node (node, label, size, bag) its rare shingles: token, node, label, size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = []
            for bag in batch.column(3):
                h, weight = _unpacked(bag.as_buffer())
                order = np.lexsort((h, count[_slots(h)]))
                total = int(weight.sum())
                # Copies of a shingle follow each other, so the first one tells of them all.
                before = np.cumsum(weight[order]) - weight[order]
                tokens.append(h[order[before < total - int(np.ceil(THRESHOLD * total - 1e-9)) + 1]])
            at = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
            token = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token), *(batch.column(k).take(pa.array(at)) for k in range(3))], ["token", "node", "label", "size"])

    return rows.select("node", "label", "size", "bag").mapInArrow(run, "token long, node long, label long, size long")


def _by_rare_shingles(wanted: DataFrame, nodes: DataFrame, bags: DataFrame) -> DataFrame:
    """Links between the nodes (node, label) of different groups that are similar enough; more of them than needed."""
    rows = stash(wanted.join(nodes.select("node", "size", "sig", "bands"), "node").join(bags, "node"), "neardup-large")
    tokens = _rare(rows, _frequencies(rows))
    groups = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    tokens = stash(tokens.join(groups.filter("low < high").select("token", "n"), "token"), "neardup-tokens")
    few = tokens.filter(F.col("n") <= FEW_NODES)
    one, two = (few.select("token", F.col("node").alias(c), F.col("label").alias(f"label_{c}"), F.col("size").alias(f"size_{c}")) for c in "ab")
    near = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * THRESHOLD
    pairs = one.join(two, "token").filter((F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & near).select("a", "b").distinct()
    links = _verified(stash(_agreeing(pairs, nodes), "neardup-pairs"), bags)
    many = tokens.filter(F.col("n") > FEW_NODES)
    if not many.isEmpty():
        # Part i of a token's nodes meets every part, itself included, in a task of its own.
        parts = F.ceil(F.col("n") / PART_NODES).cast("int")
        dealt = many.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.select("token", "node", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), (F.col("part") > F.col("with")).cast("int").alias("side"))
        blocks = dealt.join(rows, "node").withColumn("band", F.lit(0))
        links = links.unionByName(blocks.select("token", "i", "j", "band", *_ACROSS).groupBy("token", "i", "j").applyInArrow(_across, "a long, b long"))
    return links


@result_only
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, kept.

    class_id is the least id of the document's group; that document is kept.

    * null or wordless text: a group of its own;
    * null id: class_id is null and the row is kept;
    * ids: integers, or what casts to one; others take no part, as null ids;
    * very long texts: every shingle counts with its full count;
    * repeated ids: rows of one id are one document; each row is returned, and
      their groups are joined;
    * empty table: no rows; other columns are ignored.
    """
    sketch = stash(sketches(docs, id_col, text_col), "neardup-sketch")
    named = _least(sketch.select("doc_id", "name1", "name2"), ["name1", "name2"], "doc_id")
    member = stash(named.select("doc_id", "name1", "name2", "least").distinct(), "neardup-members")
    nodes = sketch.join(member.filter("doc_id = least"), ["doc_id", "name1", "name2"]).dropDuplicates(["doc_id", "name1", "name2"])
    # A node is a multiset, numbered as it is written; a repeated id can stand for several.
    nodes = stash(nodes.select(F.monotonically_increasing_id().alias("node"), "least", "name1", "name2", "size", "sig", "bands"), "neardup-nodes")
    several = member.count() != member.select("doc_id").distinct().count()

    buckets = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    star = _least(buckets, ["band", "h"], "node").filter("node != least")
    pairs = stash(_agreeing(star.select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), nodes), "neardup-pairs")
    # Buckets of one node need no more attention.
    alive = buckets.join(star.select("band", "h").distinct(), ["band", "h"], "left_semi")
    alive = stash(alive.select("band", "h", "node"), "neardup-buckets")
    wanted = nodes.join(alive.select("node").distinct(), "node", "left_semi").select("node", "least", "name1", "name2")
    bags = _bag_table(docs, wanted, id_col, text_col)

    # Documents with equal multisets are linked to their node.
    links = stash(_verified(pairs, bags), "neardup-links")
    groups = stash(components(nodes.select("node"), links), "neardup-groups")
    placed = alive.join(groups, "node")
    sizes = placed.groupBy("band", "h", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("band", "h").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    mixed = stash(mixed.select("band", "h", "n"), "neardup-mixed")
    open_rows = placed.join(mixed.filter(F.col("n") <= SMALL_BUCKET), ["band", "h"]).select("band", "h", "node", "label", F.lit(-1).alias("side"))
    open_rows = open_rows.join(nodes.select("node", "sig", "bands"), "node").join(bags, "node")
    more = open_rows.select("band", "h", *_ACROSS).groupBy("band", "h").applyInArrow(_across, "a long, b long")
    large = mixed.filter(F.col("n") > SMALL_BUCKET)
    if not large.isEmpty():
        more = more.unionByName(_by_rare_shingles(placed.join(large, ["band", "h"], "left_semi").select("node", "label").distinct(), nodes, bags))
    more = stash(more, "neardup-links")
    if not more.isEmpty():
        groups = stash(_joined(groups, more), "neardup-groups")

    name = ["name1", "name2"]
    if several:
        # The groups of one id are linked to the first of them.
        labels = nodes.select("node", *name).join(groups, "node").select(*name, "label")
        placed = stash(member.join(labels, name).select("doc_id", "label").distinct(), "neardup-placed")
        first = placed.groupBy("doc_id").agg(F.min("label").alias("a"))
        between = placed.join(first, "doc_id").filter("a != label").select("a", F.col("label").alias("b")).distinct()
        merged = components(groups.select(F.col("label").alias("node")).distinct(), between)
        groups = groups.join(merged.select(F.col("node").alias("label"), F.col("label").alias("joined")), "label").select("node", F.col("joined").alias("label"))
    labels = stash(nodes.select("node", *name, F.col("least").alias("doc")).join(groups, "node").select(*name, "label", "doc"), "neardup-labels")
    placed = member.join(_least(labels, ["label"], "doc").select(*name, F.col("least").alias("class_id")), name).select("doc_id", "class_id")
    placed = placed.distinct() if several else placed
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).try_cast("long").alias("number"))
    placed = placed.withColumnRenamed("doc_id", "number")
    out = rows.join(placed, "number", "left").select("doc_id", "number", F.coalesce("class_id", "number").alias("class_id"))
    return out.select("doc_id", "class_id", F.col("number").eqNullSafe(F.col("class_id")).alias("kept"))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns.

    Documents are named by their id: rows of one id go or stay together, and
    rows with a null id, as null and wordless texts, stay.  An empty table gives
    no rows.
    """
    dropped = near_duplicates(docs, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias("__dropped")).distinct()
    # By sorting at every size: the ids that go are as many as the input makes them.
    return docs.join(dropped.hint("merge"), docs[id_col] == dropped["__dropped"], "left_anti")
