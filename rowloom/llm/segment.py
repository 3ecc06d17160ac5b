"""SentencePiece segmentations sampled without replacement by Gumbel top-k.

Text is normalised as the model does: spaces become U+2581 and one stands before
the text.  Every path through the lattice of vocabulary pieces is a segmentation;
a character that is no piece is spelled in byte pieces.  A path's probability is proportional to the product
of its pieces' weights, 1 / (RANK_SHIFT + rank) with the merge rank that the
model's score holds.  A piece has spaces at its start only, so it never reaches from a word
into the spaces behind it, and the lattice is a chain of lattices of words, each with
the run of spaces before it; the sums over a word's lattice, and from them the
probability of each step, are computed once for each distinct word.

Perturbed A* search.  A Gumbel variable for every segmentation, largest first,
gives samples without replacement.  They are drawn from the top: the whole
lattice gets the variable of its log mass 0.  Going down, the part that holds the
best path keeps the value, the other part, all that leaves this path at the next
word, gets a Gumbel variable cut off below it.  The parts wait in order of their
values, which bound all their paths; the best part is opened next and gives the
next sample.  With kappa, the value of the best part left, the score of a sample
with log probability l is its inclusion probability 1 - exp(-exp(l - kappa)).

All randomness comes from a hash of the row key, so a row's samples depend on its
key and text alone.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from rowloom.llm.arrow import slices, texts_of
from rowloom.llm.neardup import mix
from rowloom.llm.workers import held

RANK_SHIFT = 8.0
#: Rank of a character spelled in bytes.
BYTES_RANK = 1_000_000.0
LONGEST = 16
SPACE = "▁"
CACHE_WORDS, SLICE_CHARS, LONG_WORD = 300_000, 400_000, 40
SLICE_IDS = 200_000
TABLE_BITS = 20
#: Below this probability what a draw leaves of a word is added up, not taken as one minus the draw.
CANCELS = 1e-9

U64 = np.uint64
_ZERO = np.zeros(1)
_BASE, _STEP = U64(0x9FB21C651E98DF25), U64(0xD1342543DE82EF95)


#: One step of a lattice, together in memory.
_STEP_RECORD = np.dtype([("up_to", "f8"), ("logp", "f8"), ("piece", "i4"), ("target", "i4")])
#: More spaces than one.
_RUN = re.compile("  +")
#: Words drawn at once.
CHUNK = 1 << 14
#: What the first of n bytes of a character has beside the character's bits.
_FIRST_BYTE = np.array([0, 0, 0xC0, 0xE0, 0xF0])


class Vocabulary:
    """Pieces of a model file by hash, with their weights."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.pieces = [self.model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece has a space behind a word, so words have no lattices of their own")
        if max(len(self.pieces[i]) for i in plain) > LONGEST:
            raise ValueError(f"a piece is longer than {LONGEST} characters")
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(n) if self.model.is_byte(i)}
        self.byte_ids = np.array([self.bytes.get(b, 0) for b in range(256)])
        self.ids = np.array(plain, np.int64)
        self.index = {self.pieces[i]: k for k, i in enumerate(plain)}
        self.weights = 1 / (RANK_SHIFT + np.array([max(0.0, -self.model.get_score(i)) for i in plain]))
        self.byte_weight = 1 / (RANK_SHIFT + BYTES_RANK)
        # Pieces first, then the prefixes of pieces that are none themselves.
        prefixes = sorted({self.pieces[i][:n] for i in plain for n in range(1, len(self.pieces[i]))}.difference(self.index))
        self.hashes = np.array([self._hash(x) for x in [*(self.pieces[i] for i in plain), *prefixes]], U64)
        # Two tables: what finds its place in the first taken goes to the second.
        self.tables = np.full((2, 1 << TABLE_BITS), -1, np.int32)
        for k in range(len(self.hashes)):
            for t in range(2):
                at = self._slot(self.hashes[k : k + 1], t)[0]
                if self.tables[t, at] < 0:
                    self.tables[t, at] = k
                    break
            else:
                raise ValueError("two pieces share both places; change TABLE_BITS")

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def _slot(h: np.ndarray, table: int) -> np.ndarray:
        m = mix(h)
        return (m >> U64(64 - TABLE_BITS) if table == 0 else m & U64((1 << TABLE_BITS) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash; beyond the pieces, of a prefix of some; -1 for none."""
        out = self.tables[0, self._slot(h, 0)]
        wrong = np.flatnonzero((out >= 0) & (self.hashes[out] != h))
        out[wrong] = self.tables[1, self._slot(h[wrong], 1)]
        bad = wrong[(out[wrong] >= 0) & (self.hashes[out[wrong]] != h[wrong])]
        out[bad] = -1
        return out


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Grown:
    """An array that grows at its end; the place behind it is doubled when used up."""

    def __init__(self, values: np.ndarray) -> None:
        self.room, self.size = values, len(values)

    def extend(self, values: np.ndarray) -> None:
        size = self.size + len(values)
        if size > len(self.room):
            room = np.empty(max(size, 2 * len(self.room)), self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : size] = values
        self.size = size


class Lattices:
    """Steps of the lattices of all words seen, as flat arrays by state.

    Each word has a state for every position; ``begin`` says where a state's
    steps start.  A step has an accumulated probability, a piece (or, below 0, a
    character in bytes) and the state it leads to; final states have no steps.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.grown = {"begin": _Grown(np.zeros(1 << 16, np.int64)), "step": _Grown(np.zeros(1 << 16, _STEP_RECORD))}
        self.clear()

    def clear(self) -> None:
        """Forget all words; the arrays' room stays."""
        self.words: dict[str, int] = {}
        for name, g in self.grown.items():
            g.size = int(name == "begin")
        self._expose()

    def _expose(self) -> None:
        begin, step = self.grown["begin"], self.grown["step"]
        self.begin, records = begin.room[: begin.size], step.room[: step.size]
        self.up_to, self.logp, self.piece, self.target = (records[name] for name in _STEP_RECORD.names)

    def states(self, words: list[str]) -> np.ndarray:
        """First state of each word of ``words_of``; the first space before it is added here."""
        if len(self.words) > CACHE_WORDS:
            self.clear()
        new = list(set(words).difference(self.words))
        for group in ([w for w in new if len(w) < LONG_WORD], *([w] for w in new if len(w) >= LONG_WORD)):
            if group:
                self._add(group)
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def _matches(self, text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces that match: position, length, piece (below 0: a character in bytes) and weight; by position, longest first."""
        h, rows, found = np.zeros(len(text), U64), np.arange(len(text)), []
        with np.errstate(over="ignore"):
            for n in range(1, LONGEST + 1):
                rows = rows[left[rows] >= n]
                h[rows] = h[rows] * _BASE + text[rows + (n - 1)] + U64(1)
                k = self.v.find(h[rows])
                hit = np.flatnonzero((k >= 0) & (k < len(self.v.ids)))
                at, piece = rows[hit], k[hit]
                weight = self.v.weights[piece]
                if n == 1:
                    spelled = np.ones(len(text), bool)
                    spelled[at] = False
                    spelled = np.flatnonzero(spelled)
                    at, piece = np.concatenate([at, spelled]), np.concatenate([piece, -2 - text[spelled].astype(np.int32)])
                    weight = np.concatenate([weight, np.full(len(spelled), self.v.byte_weight)])
                found.append((at, np.full(len(at), n), piece, weight))
                rows = rows[k >= 0]
                if not len(rows):
                    break
        at, length, piece, weight = (np.concatenate(x) for x in zip(*found[::-1], strict=True))
        order = np.argsort(at, kind="stable")
        return at[order], length[order], piece[order], weight[order]

    def _add(self, words: list[str]) -> None:
        """Lattices of new words, all at once; a long word comes alone."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        text = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le"), np.uint32).astype(U64)
        ends = np.cumsum(lengths)
        left = np.repeat(ends, lengths) - np.arange(len(text))
        at, length, piece, weight = self._matches(text, left)
        # A state for each position and one for each end.
        number = np.repeat(np.arange(len(words)), lengths)
        state = np.arange(len(text)) + number
        source, target = state[at], state[at] + length
        # Mass of all ways from a state to the end, from the end back.
        mass = np.zeros(len(text) + len(words))
        mass[ends + np.arange(len(words))] = 1
        order = np.argsort(left[at].astype(np.uint8 if len(words) > 1 else np.int64), kind="stable")
        edges = np.flatnonzero(np.diff(left[at[order]], prepend=0))
        odds = np.empty(len(at))
        for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
            own = order[a:b]
            ways = weight[own] * mass[target[own]]
            first = np.flatnonzero(np.diff(source[own], prepend=-1))
            total = np.add.reduceat(ways, first)
            mass[source[own[first]]] = total
            odds[own] = ways / np.repeat(total, np.diff(np.append(first, len(own))))
            if len(words) == 1 and total[0] < 1e-100:
                # The states of a long word share a scale, which only ratios leave; those far behind overflow unused.
                with np.errstate(over="ignore"):
                    mass /= total[0]
        first_state = len(self.begin) - 1
        counts = np.bincount(source, minlength=len(mass))
        up_to = np.cumsum(odds)
        start = np.flatnonzero(np.diff(source, prepend=-1))
        up_to -= np.repeat(up_to[start] - odds[start], np.diff(np.append(start, len(source))))
        up_to[np.append(start[1:] - 1, len(source) - 1)] = 2
        self.words.update(zip(words, (first_state + ends - lengths + np.arange(len(words))).tolist(), strict=True))
        step = np.empty(len(at), _STEP_RECORD)
        step["up_to"], step["logp"], step["piece"], step["target"] = up_to, np.log(odds), piece, first_state + target
        self.grown["begin"].extend(self.begin[-1] + np.cumsum(counts))
        self.grown["step"].extend(step)
        self._expose()

    def draw(self, states: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A path for each word: pieces of all, pieces per word, log probability, and the log probability of all other ways.

        In chunks whose steps stay in the processor's cache.
        """
        parts = [self._draw(states[a : a + CHUNK], seeds[a : a + CHUNK]) for a in range(0, max(len(states), 1), CHUNK)]
        pieces, count, logp, forks = (np.concatenate(x) for x in zip(*parts, strict=True))
        rest = np.where(forks, -np.expm1(logp), 0.0)
        small = np.flatnonzero(forks & (rest < CANCELS))
        if len(small):
            ends = np.cumsum(count)[small].tolist()
            known: dict[tuple, float] = {}
            for i, state, end, n in zip(small.tolist(), states[small].tolist(), ends, count[small].tolist(), strict=True):
                way = (state, *pieces[end - n : end].tolist())
                if way not in known:
                    known[way] = self.rest(state, [way[1:]])
                rest[i] = known[way]
        with np.errstate(divide="ignore"):
            return pieces, count, logp, np.log(rest)

    def _draw(self, states: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``draw``, but for the last: whether there is another way at all."""
        logp, count, forks = np.zeros(len(states)), np.zeros(len(states), np.int64), np.zeros(len(states), bool)
        token, at, seed = np.arange(len(states)), states, seeds
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        with np.errstate(over="ignore"):
            while len(token):
                seed = seed + _STEP
                u = (mix(seed) >> U64(11)).astype(np.float64) * 2.0**-53
                e = self.begin[at]
                wait = np.flatnonzero(u >= self.up_to[e])
                forks[token] |= self.begin[at + 1] > e + 1
                while len(wait):
                    e[wait] += 1
                    wait = wait[u[wait] >= self.up_to[e[wait]]]
                piece = self.piece[e]
                steps.append((token, piece))
                logp[token] += self.logp[e]
                count[token] += 1
                at = self.target[e]
                go = self.begin[at] < self.begin[at + 1]
                token, at, seed = token[go], at[go], seed[go]
        out = np.zeros(int(count.sum()), np.int32)
        starts = np.cumsum(count) - count
        for k, (token, piece) in enumerate(steps):
            out[starts[token] + k] = piece
        return out, count, logp, forks

    def _steps(self, state: int) -> list[tuple[int, float, int]]:
        """Steps of a state: piece, probability, target."""
        span = slice(int(self.begin[state]), int(self.begin[state + 1]))
        return list(zip(self.piece[span].tolist(), map(math.exp, self.logp[span].tolist()), self.target[span].tolist(), strict=True))

    def _tree(self, state: int, drawn: list[tuple[int, ...]]) -> tuple[list[dict[int, int]], list[float]]:
        """Tree of the drawn ways: children by piece, and the probability of all other ways below each node."""
        children: list[dict[int, int]] = [{}]
        states = [state]
        for way in drawn:
            node = 0
            for piece in way:
                if piece not in children[node]:
                    children[node][piece] = len(children)
                    states.append(next(t for q, _, t in self._steps(states[node]) if q == piece))
                    children.append({})
                node = children[node][piece]
        others = [0.0] * len(children)
        for node in range(len(children) - 1, -1, -1):
            # Without cancellation: a sum of what is not drawn, not one minus what is.
            others[node] = sum(p * (others[children[node][piece]] if piece in children[node] else 1.0) for piece, p, _ in self._steps(states[node]))
        return children, others

    def rest(self, state: int, drawn: list[tuple[int, ...]]) -> float:
        """Probability of all ways from the state but the drawn ones."""
        return self._tree(state, drawn)[1][0]

    def draw_other(self, state: int, drawn: list[tuple[int, ...]], uniform: Iterator[float]) -> tuple[tuple[int, ...], float]:
        """A way that is none of the drawn ones, and its log probability among all."""
        children, others = self._tree(state, drawn)
        way, logp, node = [], 0.0, 0
        while self.begin[state] < self.begin[state + 1]:
            steps = self._steps(state)
            below = children[node] if node >= 0 else {}
            odds = [p * (others[below[piece]] if piece in below else 1.0) for piece, p, _ in steps]
            u = next(uniform) * sum(odds)
            chosen = max(k for k, o in enumerate(odds) if o > 0)
            for k, o in enumerate(odds):
                u -= o
                if u < 0:
                    chosen = k
                    break
            piece, p, state = steps[chosen]
            node = below.get(piece, -1)
            way.append(piece)
            logp += math.log(p)
        return tuple(way), logp


class Path:
    """A sampled segmentation of one text."""

    def __init__(self, pieces: np.ndarray, count: np.ndarray, logp: np.ndarray, value: float) -> None:
        self.pieces, self.count, self.logp, self.value = pieces, count, logp, value
        #: Log probability up to each word, and of the whole.
        self.before = np.concatenate([_ZERO, logp.cumsum()])
        #: By word: the ways through it that were already drawn.
        self.drawn: dict[int, list[tuple[int, ...]]] = {}

    @property
    def total(self) -> float:
        return float(self.before[-1])

    def wait(self, waiting: np.ndarray) -> None:
        """Take over the values of the parts that leave the path at each word."""
        self.waiting = waiting
        self._top()

    def _top(self) -> None:
        """The best part: value and word."""
        t = int(self.waiting.argmax()) if len(self.waiting) else -1
        self.best = (float(self.waiting[t]), t) if t >= 0 else (-math.inf, -1)

    def lower(self, word: int, value: float) -> None:
        self.waiting[word] = value
        self._top()


def iter_uniform(seed: int) -> Iterator[float]:
    """Uniform numbers for single draws, without arrays."""
    mask = 0xFFFFFFFFFFFFFFFF
    while True:
        seed = (seed + 0x9E3779B97F4A7C15) & mask
        x = ((seed ^ (seed >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        yield (((x ^ (x >> 31)) >> 11) + 0.5) * 2.0**-53


def _uniform(seed: np.ndarray) -> np.ndarray:
    return ((mix(seed) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _cut_gumbel(location: np.ndarray, bound: np.ndarray | float, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of the locations, given that they are below the bound."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        return np.where(np.isneginf(location), -np.inf, location - np.logaddexp(location - bound, np.log(-np.log(u))))


def _best(paths: list[Path]) -> tuple[float, int, int]:
    """The best part of all: value, path and word."""
    j = max(range(len(paths)), key=lambda i: paths[i].best[0])
    return paths[j].best[0], j, paths[j].best[1]


def _spaced(text: str) -> str:
    """The text with all but the first space of each run as U+2581, so that it falls into words at each space."""
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if text[0] == " " or "  " in text:
        text = _RUN.sub(lambda m: " " + SPACE * (len(m[0]) - 1), " " + text)[1:]
    return text


def words_of(text: str) -> list[str]:
    """Words with the run of spaces before each, but for the first space of the run; spaces at the end are a run before no word."""
    return _spaced(text).split(" ") if text else []


class Sampler:
    def __init__(self, path: str) -> None:
        self.v = vocabulary(path)
        self.lattices = Lattices(self.v)

    def sample(self, keys: list[str], texts: list[str], k: int) -> Iterator[list[tuple[Path, float]]]:
        """For each text at most k distinct paths with their inclusion probabilities."""
        for a, b in slices(map(len, texts), SLICE_CHARS):
            yield from self._sample(keys[a:b], texts[a:b], k)

    def _split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First state of each word of all texts, and the number of words of each text."""
        words = pc.split_pattern(pa.array([_spaced(t) if t else None for t in texts], pa.string()), " ")
        lengths = words.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        known = self.lattices.states(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        return known[coded.indices.to_numpy()], lengths

    def _sample(self, keys: list[str], texts: list[str], k: int) -> list[list[tuple[Path, float]]]:
        states, lengths = self._split(texts)
        starts = np.cumsum(lengths) - lengths
        seeds = mix(np.array([xxhash.xxh3_64_intdigest(x) for x in keys], U64))
        place = np.arange(len(states)) - np.repeat(starts, lengths)
        with np.errstate(over="ignore"):
            word_seed = mix(np.repeat(seeds, lengths) + place.astype(U64) * _BASE)
            #: Behind the value of the part that leaves a path at a word.
            uniform = _uniform(np.repeat(seeds + U64(11), lengths) + place.astype(U64) * _BASE)
            pieces, count, logp, rest = self.lattices.draw(states, word_seed)
            at = np.concatenate([[0], np.cumsum(count)])
            roots = -np.log(-np.log(_uniform(seeds + U64(7))))
            found = [[Path(pieces[at[s] : at[s + n]], count[s : s + n], logp[s : s + n], r)] for s, n, r in zip(starts.tolist(), lengths.tolist(), roots.tolist(), strict=True)]
            before = np.concatenate([p.before[:-1] for (p,) in found]) if found else logp
            waiting = _cut_gumbel(before + rest, np.repeat(roots, lengths), uniform)
            for (p,), s, n in zip(found, starts.tolist(), lengths.tolist(), strict=True):
                p.wait(waiting[s : s + n])
            for r in range(1, k):
                todo = [(d, *_best(paths)) for d, paths in enumerate(found)]
                todo = [x for x in todo if x[1] > -math.inf]
                if todo:
                    self._open(todo, found, states, starts, lengths, mix(seeds + U64(r) * _STEP), word_seed, uniform)
        return [self._scored(paths) for paths in found]

    def _open(self, todo, found: list[list[Path]], states: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seeds: np.ndarray, word_seed: np.ndarray, uniform: np.ndarray) -> None:
        """Draw the best path of the best part of each text in ``todo``."""
        spans = [(int(starts[d]) + t, int(starts[d] + lengths[d])) for d, _, _, t in todo]
        rows = np.concatenate([np.arange(a, b) for a, b in spans])
        sizes = np.array([b - a for a, b in spans])
        first = np.cumsum(sizes) - sizes
        pieces, count, logp, rest = self.lattices.draw(states[rows], mix(word_seed[rows] ^ np.repeat(seeds[[d for d, *_ in todo]], sizes)))
        at = np.concatenate([[0], np.cumsum(count)])
        made: list[Path] = []
        for (d, value, j, t), f, n in zip(todo, first.tolist(), sizes.tolist(), strict=True):
            parent, state = found[d][j], int(states[rows[f]])
            cut = int(parent.count[:t].sum())
            here = tuple(parent.pieces[cut : cut + int(parent.count[t])].tolist())
            drawn = parent.drawn.setdefault(t, [here])
            # Only what was not drawn here before belongs to the part.
            own, own_logp = self.lattices.draw_other(state, drawn, numbers := iter_uniform(int(seeds[d])))
            drawn.append(own)
            path = Path(
                np.concatenate([parent.pieces[:cut], np.array(own, np.int64), pieces[at[f + 1] : at[f + n]]]),
                np.concatenate([parent.count[:t], [len(own)], count[f + 1 : f + n]]),
                np.concatenate([parent.logp[:t], [own_logp], logp[f + 1 : f + n]]),
                value,
            )
            made.append(path)
            found[d].append(path)
            left = 1 - math.exp(parent.logp[t]) - math.exp(own_logp) if len(drawn) == 2 else 0.0
            if left < 0.01:
                left = self.lattices.rest(state, drawn)
            if left > 0:
                parent.lower(t, float(_cut_gumbel(parent.before[t] + math.log(left), value, next(numbers))))
            else:
                parent.lower(t, -math.inf)
        # A new path leaves its parent at the word before its own parts.
        before = np.concatenate([p.before[-1 - n : -1] for p, n in zip(made, sizes.tolist(), strict=True)])
        rest[first] = -np.inf
        waiting = _cut_gumbel(before + rest, np.repeat([p.value for p in made], sizes), uniform[rows])
        for p, f, n in zip(made, first.tolist(), sizes.tolist(), strict=True):
            p.wait(np.concatenate([np.full(len(p.logp) - n, -np.inf), waiting[f : f + n]]))

    def _scored(self, paths: list[Path]) -> list[tuple[Path, float]]:
        kappa = _best(paths)[0]
        return [(p, float(-np.expm1(-np.exp(min(p.total - kappa, 700)))) if kappa > -np.inf else 1.0) for p in paths]

    def ids(self, pieces: np.ndarray) -> np.ndarray:
        """Vocabulary ids; characters in bytes become several."""
        return self.listed(pieces, np.array([0, len(pieces)]))[0]

    def listed(self, pieces: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary ids of lists of pieces that begin at ``ends``, and where the ids of each list begin."""
        out = self.v.ids[np.maximum(pieces, 0)]
        spelled = np.flatnonzero(pieces < 0)
        if not len(spelled):
            return out, ends
        code = -2 - pieces[spelled].astype(np.int64)
        size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        number = np.ones(len(pieces), np.int64)
        number[spelled] = size
        before = np.concatenate([[0], np.cumsum(number)])
        out = np.repeat(out, number)
        # UTF-8: the first byte says how many follow, each of those holds six bits.
        for k in range(4):
            own = np.flatnonzero(size > k)
            bits = code[own] >> 6 * (size[own] - 1 - k)
            byte = np.where(size[own] == 1, bits, bits | _FIRST_BYTE[size[own]]) if k == 0 else bits & 0x3F | 0x80
            out[before[spelled[own]] + k] = self.v.byte_ids[byte]
        return out, before[ends]


class Spelling:
    """What each vocabulary id spells, as slices of one array of bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        spelled = [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.size = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(spelled), np.uint8)

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Text of each list of ids; ``ends`` are where the lists begin in ``ids``, and its length."""
        size = self.size[ids]
        after = np.cumsum(size)
        data = self.data[np.repeat(self.begin[ids] - (after - size), size) + np.arange(int(size.sum()))].tobytes()
        at = np.concatenate([[0], after])[ends].tolist()
        # Byte pieces may also spell a U+2581, or what is no text.
        texts = [data[a:b].decode("utf-8", "replace").replace(SPACE, " ") for a, b in zip(at, at[1:], strict=False)]
        return [t[1:] if t[:1] == " " else t for t in texts]


@functools.cache
def spelling(path: str) -> Spelling:
    return Spelling(path)


def decode(ids: Iterable[int], path: str) -> str:
    """Text of vocabulary ids; byte pieces are joined, and the space put before the text goes."""
    ids = np.array(list(ids), np.int64)
    return spelling(path).texts(ids, np.array([0, len(ids)]))[0]


def _decoded(batch: pa.RecordBatch, at: int, known: Spelling, text_col: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices, with the text of the ids in column ``at``."""
    lengths = [n or 0 for n in batch.column(at).value_lengths().to_pylist()]
    for a, b in slices(lengths, SLICE_IDS):
        part = batch.slice(a, b - a)
        column = part.column(at)
        # Without what null rows may hold.
        ids = column.flatten().to_numpy(zero_copy_only=False)
        texts = pa.array(known.texts(ids, np.cumsum([0, *lengths[a:b]])), pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([*part.columns, texts], [*batch.schema.names, text_col])


def decode_rows(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The rows with the text of their ids, as ``decode`` gives it; null for null ids."""
    at = rows.columns.index(ids_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _decoded(batch, at, spelling(path), text_col)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(text_col, StringType())]))


def _worker(path: str) -> Sampler:
    return held(("segment", path), lambda: Sampler(path))


def _sampled(batch: pa.RecordBatch, sampler: Sampler, k: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """The samples of (id, text) rows, in batches of about SLICE_IDS ids."""
    texts, keys = texts_of(batch.column(1)), [str(x) for x in batch.column(0).to_pylist()]
    rows: list[tuple[int, int, Path, float]] = []

    def flush() -> pa.RecordBatch:
        row, sample, paths, inclusion = zip(*rows, strict=True)
        ends = np.cumsum([0, *(len(p.pieces) for p in paths)])
        ids, ends = sampler.listed(np.concatenate([p.pieces for p in paths]), ends)
        ids = ids.astype("<i4")
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        arrays = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(sample, pa.int32()), pa.array(np.diff(ends))]
        arrays += [pa.array([float(p.total) for p in paths], pa.float64()), pa.array([p.value for p in paths], pa.float64()), pa.array(inclusion, pa.float64()), pa.array(crc, pa.int64())]
        arrays += [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))] if with_ids else []
        rows.clear()
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "sample", "n_pieces", "log_prob", "value", "inclusion", "ids_crc32", *["ids"] * with_ids])

    size = 0
    for row, found in enumerate(sampler.sample(keys, texts, k)):
        rows += [(row, n, p, inclusion) for n, (p, inclusion) in enumerate(found, 1)]
        size += sum(len(p.pieces) for p, _ in found)
        if size >= SLICE_IDS:
            yield flush()
            size = 0
    if rows:
        yield flush()


def sample_segmentations(docs: DataFrame, path: str, k: int = 2, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """At most k rows per document, best first: doc_id, sample, n_pieces, log_prob, value, inclusion, ids_crc32 and, on request, ids.

    ``value`` is the perturbed log probability that orders the samples (from 1).
    Fewer rows than k mean that the text has no more segmentations.  A null or
    empty text has one, without pieces.  A null id seeds as the text "None";
    repeated rows give the same samples.  An empty table gives no rows.

    ``with_text`` adds ``decoded`` to the ids: ``decode_rows`` in the same pass.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    with_ids = with_ids or with_text

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _worker(path)
        for batch in batches:
            for found in _sampled(batch, sampler, k, with_ids):
                yield from _decoded(found, found.num_columns - 1, spelling(path), "decoded") if with_text else [found]

    schema = f"doc_id {kind}, sample int, n_pieces long, log_prob double, value double, inclusion double, ids_crc32 long" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return docs.select(id_col, text_col).mapInArrow(run, schema)
