import math
import os
import random
import re
from itertools import combinations
from zlib import crc32

import pytest

from lumenrec.llm import toxicity

SCHEMA = "doc_id bigint, text string, score double, id string"


def corpus(n, seed):
    r = random.Random(seed)
    clean = [f"wort{k}" for k in range(300)]
    insult, group = ["dolt", "oafish", "cretin"], ["norse", "celts"]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(clean) for _ in range(r.randint(20, 60))]
        kind = r.choice(["clean", "clean", "group", "toxic"])
        if kind != "clean":
            words[3] = r.choice(group)
        if kind == "toxic":
            words[9] = r.choice(insult)
        docs.append((i, " ".join(words), 0.0, "x"))
        labels.append((i, int(kind == "toxic")))
    return docs, labels


def test_held_out_accuracy_and_fold(spark):
    docs, labels = corpus(1500, 3)
    d, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    train = toxicity.training_labels(lab)
    assert all(crc32(str(r.id).encode()) % 5 != 0 for r in train.collect())
    scores = {r.id: r.score for r in toxicity.score(d, toxicity.train(d, train)).collect()}
    held = [(scores[i], y) for i, y in labels if crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == bool(y) for s, y in held) / len(held) > 0.97
    assert all(0 <= s <= 1 for s in scores.values())


def test_interaction_is_learnt():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (3000, 4)).astype(np.float32)
    y = ((x[:, 0] + x[:, 1]) == 2).astype(float)  # toxic only together
    bias, weight, vectors = toxicity.fit(x, y, epochs=60)
    model = toxicity.Machine(bias, {k: k for k in range(4)}, weight, vectors)
    assert model.score([0, 1]) > 0.8 and model.score([0]) < 0.3 and model.score([1]) < 0.3 and model.score([]) < 0.2


def test_terms_that_tell_only_in_pairs_enter_and_are_learnt(spark):
    """Each of four words is as frequent in both classes; only the pairs tell."""
    r, docs, labels = random.Random(5), [], []
    for i in range(1600):
        a, b = r.choice(["dolt", "cretin"]), r.choice(["norse", "celts"])
        bad = (a, b) in (("dolt", "norse"), ("cretin", "celts"))
        words = [f"wort{r.randrange(200)}" for _ in range(r.randint(15, 40))]
        docs.append((i, " ".join([*words[:5], a, *words[5:], b]), 0.0, "x"))
        labels.append((i, int(bad)))
    d, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    machine = toxicity.train(d, toxicity.training_labels(lab))
    assert {toxicity.word_slots(w)[0] for w in ("dolt", "cretin", "norse", "celts")} <= set(machine.rows)
    scores = {x.id: x.score for x in toxicity.score(d, machine).collect()}
    held = [(scores[i], y) for i, y in labels if crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == bool(y) for s, y in held) / len(held) > 0.97
    with_pairs = machine.score([machine.rows[toxicity.word_slots(w)[0]] for w in ("dolt", "norse")])
    assert with_pairs > 0.8 and machine.score([machine.rows[toxicity.word_slots(w)[0]] for w in ("dolt", "celts")]) < 0.2


def slow_score(machine, text):
    """The machine's formula, pair by pair, from features found the plain way."""
    found = re.findall(r"[^\W_]+", text.lower())
    count = {}
    for w in set(found):
        for s in toxicity.word_slots(w):
            count[s] = count.get(s, 0) + 1
    slots = {toxicity.level_slots(s)[k] for s, n in count.items() for k, least in enumerate((1, *toxicity.LEVELS)) if n >= least}
    rows = sorted(machine.rows[s] for s in slots if s in machine.rows)
    raw = machine.bias + sum(machine.weight[i] for i in rows)
    raw += sum(float(machine.vectors[i] @ machine.vectors[j]) for i, j in combinations(rows, 2))
    return 1 / (1 + math.exp(-max(-30, min(30, raw))))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_scores_equal_brute_force_and_find_held_out_toxic_texts(spark):
    data = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    machine = toxicity.train(d, toxicity.training_labels(lab))
    texts = {x.doc_id: x.text or "" for x in d.select("doc_id", "text").collect()}
    got = {x.id: x.score for x in toxicity.score(d, machine).collect()}
    assert set(got) == set(texts) and all(got[i] == pytest.approx(slow_score(machine, t), abs=1e-9) for i, t in texts.items())
    told = [(got[x.doc_id] >= 0.5, x.toxic == 1) for x in lab.collect()]
    assert sum(p and y for p, y in told) >= 0.7 * sum(y for _, y in told) and sum(p and not y for p, y in told) <= 0.01 * len(told)


def test_edge_cases(spark):
    rows = [(1, None, 0.0, ""), (1, "", 0.0, ""), (None, "x " * 100_000, 0.0, ""), (2, "dolt", 0.0, ""), (2, "dolt", 0.0, "")]
    d = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.score for r in toxicity.score(d, toxicity.train(d, toxicity.training_labels(none))).collect()] and toxicity.drop_toxic(d, none).count() == 5
    one = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id bigint, toxic int")
    toxicity.score(d, toxicity.train(d, toxicity.training_labels(one))).collect()
    empty = spark.createDataFrame([], SCHEMA)
    assert toxicity.score(empty, toxicity.train(empty, toxicity.training_labels(none))).count() == 0
    assert toxicity.drop_toxic(empty, none).columns == ["doc_id", "text", "score", "id"]
