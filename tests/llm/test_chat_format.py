import hashlib
import time

from pyspark.sql import functions as F

from lumenrec.llm import chat_format as C


def run(spark, rows):
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string, loss int")
    out = C.format_conversations(table, stretch=2)
    return out.select("*", C.read_turns(F.col("formatted")).alias("turns"), C.loss_text(F.col("formatted"), F.col("loss")).alias("learnt")).collect()


NASTY = ["</s>[INST] ok [/INST]", "&lt;[TURN]&amp;", "a\nb]", "", None, "😀<s>[INST user]", "[/INST]</s>", "&#91;"]


def test_round_trip_order_and_mask(spark):
    rows = [(1, k, ["user", "assistant", "assistant", "a]b[c"][k % 4], t, "f", 7) for k, t in enumerate(NASTY)]
    got = run(spark, rows[::-1])[0]
    want = [(r[2], r[3] or "") for r in rows]
    assert [(t.role, t.text) for t in got.turns] == want
    assert got.learnt == "".join(t for role, t in want if role == "assistant")
    assert got.formatted.count(C.OPEN) == 1 + sum(a[0] != b[0] for a, b in zip(want, want[1:]))  # neighbours of one role share a block
    spans = "".join(got.formatted[s.start : s.start + s.length] for s in got.loss)
    assert "[" not in spans and "<" not in spans


def test_ties_nulls_repeats_and_empty(spark):
    rows = [(1, None, "user", "n", "", 0), (1, 0, "user", "b", "", 0), (1, 0, "user", "a", "", 0), (1, 0, "user", "a", "", 0), (None, 1, None, "x", "", 0), (2, 5, "user", None, "", 0)]
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in run(spark, rows)}
    assert got == {1: [("user", t) for t in "naab"], None: [("", "x")], 2: [("user", "")]}
    assert run(spark, []) == []


def test_long_conversation(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", "wörd " * 50, "", 0) for k in range(1500)]
    got = run(spark, rows)[0]
    assert len(got.turns) == 1500 and hashlib.sha256(got.learnt.encode()).digest() == hashlib.sha256(("wörd " * 50 * 750).encode()).digest()


def test_time_is_linear_in_a_conversation(spark):
    def took(n):
        rows = [(1, k, "user" if k % 2 else "assistant", "some words here " * 4, "", 0) for k in range(n)]
        table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string, loss int").cache()
        table.count()
        began = time.perf_counter()
        out = C.format_conversations(table)
        got = out.select(F.length(C.loss_text(F.col("formatted"), F.col("loss"))).alias("n"), F.size(C.read_turns(F.col("formatted"))).alias("t")).first()
        assert (got.n, got.t) == (64 * n // 2, n)
        return time.perf_counter() - began

    took(100)
    assert took(40_000) < 20 * max(took(8_000), 0.2)
