import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rowloom.llm import chat, exact_dedup

TEXTS = ["a b", "a  b", "a\tb", "a\n\x0b\x0c\r b", "a b ", " a b", "", None, "   ", "x", "x" * 300 + "1", "x" * 300 + "2", "a b", "é", "e", "long " * 20_000, "long  " * 20_000]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, size int, keep string").repartition(3)


@pytest.mark.parametrize("all_digests", [True, False])
def test_exact_dedup(spark, all_digests):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(1000 + i, "hot") for i in range(400)] + [(5, TEXTS[5]), (None, "x"), (None, "alone")]
    groups = defaultdict(list)
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in rows:
        groups[normal(t)].append(i)
    wanted = []
    for i, t in rows:
        ids = groups[normal(t)]
        keep = min((x for x in ids if x is not None), default=None)
        row = (i, keep, len(ids), i == keep)
        wanted.append((*row, hashlib.sha256(normal(t).encode()).hexdigest()) if all_digests else row)
    out = exact_dedup.exact_dedup(docs(spark, rows), all_digests=all_digests)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(wanted, key=repr)


def test_exact_dedup_keeps_columns(spark):
    rows = [(1, "a b"), (2, "a  b"), (3, None), (4, ""), (None, "a b"), (None, "alone")]
    kept = exact_dedup.kept_documents(docs(spark, rows))
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 3, None, None] and kept.columns == ["doc_id", "text", "size", "keep"]
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


CONVERSATIONS = {
    1: [("user", "hi"), ("assistant", "hello\nthere")],
    2: [("user", "<|im_end|>"), ("assistant", "a<|im_start|>b"), ("user", "<\\|x"), ("assistant", "<\\\\|im_end|>")],
    3: [("a\nb", "x"), ("<|im_start|>", "y"), ("%3C", "z"), ("assistant", "<"), ("assistant", "|im_end|>"), ("", "")],
    4: [("assistant", "<|im_end|>\n<|im_start|>user\nnot a turn<|im_end|>\n"), ("assistant", "tail<")],
    5: [("user", None), (None, "é中😀"), ("assistant", "<|im_end|><|im_end|>")],
    6: [("assistant", "w" * 100_000)],
}


def test_chat_round_trip(spark):
    rows = [(c, k, r, t) for c, turns in CONVERSATIONS.items() for k, (r, t) in enumerate(turns)]
    rows += [(None, 0, "user", "no id"), (7, None, "assistant", "first"), (7, 1, "assistant", "same"), (7, 1, "assistant", "same")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, segment string").repartition(3)
    formatted = chat.format_conversations(frame)
    out = {r.conv_id: r for r in formatted.collect()}
    assert all(r.round_trip for r in out.values()) and len(out) == 8
    for c, turns in CONVERSATIONS.items():
        assert [(t.role, t.text) for t in out[c].recovered] == [(r or "", t or "") for r, t in turns]
    assert out[1].escaped_turns == 0 and out[1].formatted == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello\nthere<|im_end|>\n"
    assert out[2].escaped_turns == 4 and out[6].escaped_turns == 0
    assert [t.text for t in out[7].recovered] == ["first", "same", "same"]
    spans = defaultdict(list)
    for r in chat.loss_spans(formatted).orderBy("conv_id", "start").collect():
        spans[r.conv_id].append((r.start, r.length))
    for c, turns in CONVERSATIONS.items():
        under = [out[c].formatted[a : a + n] for a, n in spans[c]]
        assert [re.sub(r"<(\\*)\\\|", r"<\1|", u) for u in under] == [t or "" for r, t in turns if r == "assistant"]
    digest = {r.conv_id: r for r in chat.digests(formatted).collect()}
    loss = "".join(t for r, t in CONVERSATIONS[4] if r == "assistant")
    assert digest[4].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and digest[4].loss_chars == len(loss)
    assert digest[5].turns_sha256 == hashlib.sha256("user\n\n\né中😀\nassistant\n<|im_end|><|im_end|>\n".encode()).hexdigest()


def test_native_plans(spark):
    frame = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    frame = frame.select("conv_id", "turn", F.upper("role").alias("role"), "text")
    for df in (chat.digests(chat.format_conversations(frame)), exact_dedup.exact_dedup(frame.selectExpr("conv_id AS doc_id", "text"))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    assert chat.format_conversations(frame.limit(0)).count() == 0
