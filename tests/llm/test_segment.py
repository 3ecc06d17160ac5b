import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from rowloom.llm import queries, segment

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def all_paths(text):
    """Every segmentation with its probability, by enumeration."""
    v = segment.vocabulary(MODEL)

    def ways(word):
        if not word:
            yield (), 1.0
        for n in range(1, min(segment.LONGEST, len(word)) + 1):
            k = v.index.get(word[:n])
            if k is not None:
                head, w = (int(v.ids[k]),), v.weights[k]
            elif n == 1:
                head, w = tuple(v.bytes[b] for b in word[0].encode()), v.byte_weight
            else:
                continue
            for tail, x in ways(word[n:]):
                yield head + tail, w * x

    words = [list(ways(segment.SPACE + w)) for w in text.split(" ")]
    out = {}
    for combo in itertools.product(*words):
        out[sum((c[0] for c in combo), ())] = math.prod(c[1] for c in combo)
    total = sum(out.values())
    return {k: x / total for k, x in out.items()}


def samples(texts, k, keys=None):
    s = segment.Sampler(MODEL)
    keys = keys or [str(i) for i in range(len(texts))]
    return [[(tuple(s.ids(p.pieces).tolist()), p, q) for p, q in found] for found in s.sample(keys, texts, k)]


def test_first_sample_follows_the_lattice():
    expected, n = all_paths("the cat"), 6000
    got = Counter(f[0][0] for f in samples(["the cat"] * n, 1))
    assert set(got) <= set(expected)
    for path, p in expected.items():
        assert abs(got[path] - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 3


def test_second_sample_is_without_replacement():
    expected, n = all_paths("on it"), 6000
    got = Counter(f[1][0] for f in samples(["on it"] * n, 2))
    for path, p in expected.items():
        q = sum(o * p / (1 - o) for other, o in expected.items() if other != path)
        assert abs(got[path] - n * q) < 5 * math.sqrt(n * q * (1 - q)) + 3


def test_inclusion_scores_are_unbiased():
    """Weighting each of the k samples by p / inclusion estimates sums over all paths."""
    expected = all_paths("an in")
    sizes = [sum(math.exp(p.logp.sum()) / q * len(ids) for ids, p, q in f) for f in samples(["an in"] * 4000, 3)]
    truth = sum(len(path) * p for path, p in expected.items())
    assert abs(np.mean(sizes) - truth) < 5 * np.std(sizes) / math.sqrt(len(sizes)) + 1e-9


def test_distinct_ordered_and_decoded():
    r = random.Random(1)
    alphabet = ["a", "b", "the", "tion", " ", "  ", "é", "中", "😀", "\n", "\t", ".", "Z", "▁", "\0"]
    texts = ["", " ", "x", "a b", "😀" * 50, "y" * 3000] + ["".join(r.choices(alphabet, k=r.randrange(1, 60))) for _ in range(200)]
    for text, found in zip(texts, samples(texts, 4), strict=True):
        ids = [f[0] for f in found]
        assert len(set(ids)) == len(ids) >= 1
        values = [f[1].value for f in found]
        assert values == sorted(values, reverse=True)
        for f in found:
            assert segment.decode(f[0], MODEL) == text.replace("▁", " ")
            assert 0 < f[2] <= 1


def test_all_segmentations_when_k_is_large():
    expected = all_paths("is")
    (found,) = samples(["is"], 50)
    assert {f[0] for f in found} == set(expected)
    for ids, path, _ in found:
        assert math.exp(path.logp.sum()) == pytest.approx(expected[ids])


def test_no_segmentation_is_left_out():
    """Neither small remainders nor parts behind unlikely prefixes are dropped."""
    expected = all_paths("on é it")
    (found,) = samples(["on é it"], len(expected) + 5)
    assert {f[0] for f in found} == set(expected) and len(found) == len(expected)
    (far,) = samples([" ".join(["the", "then"] * 200)], 3)
    for _, path, _ in far[1:]:
        assert path.before[-2] < -100 and np.isfinite(path.waiting[-1])


def all_paths_of_all_pieces(text):
    """As ``all_paths``, over the whole text at once and from the model's own list of pieces."""
    v = segment.vocabulary(MODEL)
    m = v.model
    normal = {m.id_to_piece(i): i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}

    def ways(rest):
        if not rest:
            yield (), 1.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in normal:
                head, w = (normal[rest[:n]],), 1 / (segment.RANK_SHIFT + max(0.0, -m.get_score(normal[rest[:n]])))
            elif n == 1:
                head, w = tuple(v.bytes[b] for b in rest[0].encode()), v.byte_weight
            else:
                continue
            for tail, x in ways(rest[n:]):
                yield head + tail, w * x

    found = dict(ways(segment.SPACE + text.replace(" ", segment.SPACE)))
    total = sum(found.values())
    return {k: x / total for k, x in found.items()}


@pytest.mark.parametrize("text", [" ", "   ", "a  b", "  a", "a   ", "is", "é  \n  b"])
def test_runs_of_spaces_have_all_segmentations(text):
    expected = all_paths_of_all_pieces(text)
    (found,) = samples([text], len(expected) + 5)
    assert {f[0] for f in found} == set(expected)
    for ids, path, _ in found:
        assert path.logp.sum() == pytest.approx(math.log(expected[ids]), abs=1e-6)
        assert segment.decode(ids, MODEL) == text


def test_first_sample_of_a_run_follows_the_lattice():
    expected, n = all_paths_of_all_pieces("a  b"), 6000
    got = Counter(f[0][0] for f in samples(["a  b"] * n, 1))
    assert any(segment.vocabulary(MODEL).pieces[i] == "▁▁" for path in got for i in path)
    for path, p in expected.items():
        assert abs(got[path] - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 3


def test_seeded_by_key():
    text = "several words of a text that has many segmentations"
    one, two = samples([text, "other", text], 2, ["a", "b", "a"])[0::2]
    assert [f[0] for f in one] == [f[0] for f in two]
    assert [f[0] for f in samples([text], 2, ["c"])[0]] != [f[0] for f in one]


def test_query_rows(spark):
    rows = [(1, "some text"), (1, "some text"), (2, None), (3, ""), (None, "x")]
    out = segment.sample_segmentations(spark.createDataFrame(rows, "doc_id long, text string"), MODEL, k=2).collect()
    assert Counter(r.doc_id for r in out)[1] == 4 and [r.n_pieces for r in out if r.doc_id in (2, 3)] == [0, 0]
    assert segment.sample_segmentations(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def test_rows_are_decoded(spark):
    v = segment.vocabulary(MODEL)
    word, spaces, smile = v.index["▁the"], v.index["▁▁"], [v.bytes[b] for b in "😀".encode()]
    lists = [[int(v.ids[word]), int(v.ids[spaces]), *smile], [], None, [v.bytes[0xFF]]]
    out = segment.decode_rows(spark.createDataFrame(list(enumerate(lists)), "n long, ids array<int>").coalesce(1), MODEL).collect()
    assert {r.n: r.decoded for r in out} == {0: "the  😀", 1: "", 2: None, 3: "\ufffd"}
    assert [r.ids for r in sorted(out, key=lambda r: r.n)] == lists


def test_query_gives_ids_and_decoded_text(spark, tmp_path):
    texts = {1: "some  text ▁ of\n words", 2: None, 3: "", 4: " 中😀", 5: "  def f(x):  # y"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op8_gumbel_segment(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == {1: 2, 2: 1, 3: 1, 4: 2, 5: 2}
    for r in out:
        assert r.decoded == (texts[r.doc_id] or "").replace("▁", " ")
        assert len(r.ids) == r.n_pieces and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert len({(r.doc_id, tuple(r.ids)) for r in out}) == len(out)
