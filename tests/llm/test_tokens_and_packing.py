import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rowloom.llm import packing, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [*"abcZ 1.,'s  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　éßΣİ中文😀́´", "'ll", "<|endoftext|>", "<|startoftext|>", " the", "don't", "WORDS"]


def texts(n):
    r = random.Random(3)
    return ["".join(r.choices(ALPHABET, k=r.randrange(30))) for _ in range(n)] + ["", " ", "a" * 5000, "the cat " * 3000, "<|endoftext|>" * 3]


def test_counts_equal_the_library():
    library, own = Tokenizer.from_file(BYTE), tokens.Counter(BYTE)
    some = texts(5000)
    assert own.count(some) == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]
    small = tokens.Counter(BYTE, entries=50)
    assert small.count(some) == own.count(some)


def test_whole_tokens_are_proved():
    library, whole = Tokenizer.from_file(BYTE), tokens.whole_tokens(BYTE)
    assert " the" in whole and len(whole) > 40_000
    assert all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in random.Random(1).sample(sorted(whole), 500))


def test_ids_equal_the_library():
    library, own = Tokenizer.from_file(WORD), tokens.Encoder(WORD)
    some = texts(5000)
    wanted = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(some, add_special_tokens=False)]
    assert list(own.encode(some)) == wanted


def test_count_rows(spark):
    rows = [(1, "the cat " * 600), (2, None), (None, "é"), (1, "x")]
    out = tokens.count_tokens(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes int"), BYTE)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, 4800, 1201, True), (2, 0, 0, False), (None, 2, 1, False), (1, 1, 1, False)], key=repr)
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string"), BYTE).count() == 0


def check_packing(spark, rows, size):
    library = Tokenizer.from_file(WORD)
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), WORD, size=size).collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // size)))
        for r in own:
            assert r.start == r.piece * size and r.length == min(size, len(ids) - r.start)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return out, sequences


def test_packing_is_whole_and_tight(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choices(["the", "cat", "sat", "on"], k=r.randrange(90)))) for i in range(400)] + [(500, None), (501, ""), (502, "dog " * 1000), (503, "dog " * 63), (504, "dog " * 64)]
    out, sequences = check_packing(spark, rows, 64)
    total = sum(x.length for x in out)
    assert len(sequences) <= -(-total // 64) + 2


def test_placing_follows_the_rule():
    """Against the sum of squares computed anew for every choice."""
    r = random.Random(8)
    size, lengths = 20, [r.randrange(1, 21) for _ in range(300)]
    seq, offsets = packing.place(lengths, size)
    gaps: list[int] = []
    for n, s, o in zip(lengths, seq, offsets, strict=True):
        def squares(k, n=n):
            after = [g - n if i == k else g for i, g in enumerate(gaps)]
            return sum(sum(g == v for g in after) ** 2 for v in set(after) if v)
        fitting = [k for k, g in enumerate(gaps) if g >= n]
        if not fitting:
            gaps.append(size)
            assert s == len(gaps) - 1
        else:
            least = min(squares(k) for k in fitting)
            best = min(gaps[k] for k in fitting if squares(k) == least)
            assert squares(s) == least and gaps[s] == best
        assert o == size - gaps[s]
        gaps[s] -= n


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), WORD).count() == 0
