import json
import os
import random
import re
from zlib import crc32

import numpy as np
import pytest

import corpus_pipeline
from lumenrec.llm import byte_bpe, packing, secrets, simhash, toxicity

from test_simhash import brute_components, brute_fp
from test_toxicity import slow_score


@pytest.fixture(scope="module")
def sf(tmp_path_factory, spark):
    d = str(tmp_path_factory.mktemp("sf"))
    def word(n):
        return "".join("abcdefghij"[int(c)] for c in str(n))

    text = [f"doc {word(k)} " + " ".join(word((k * 3701 + j * 1103) % 9973) for j in range(120)) for k in range(40)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(text)]
    rows += [(100, text[3] + " ", "en", "s", 1), (101, "  ".join(text[4].split(" ")), "en", "s", 1), (102, None, "en", "s", None), (103, "password = 'abcdef123456' then last", "en", "s", 35)]
    bad = [(200 + k, f"you idiot {text[k]} moron", "en", "s", 1) for k in range(30)]
    spark.createDataFrame(rows + bad, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], 1, int(r[0] >= 200)) for r in rows + bad]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_each_stage_on_its_own_input(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf)
        path = str(tmp_path / name)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if name != "packing":
            assert out.columns == columns
            after = {r.doc_id: r.text for r in out.collect()}
        if name == "toxicity":
            assert not [i for i in after if i >= 200] and set(after) == {i for i in before if i < 200}
        elif name == "exact_dedup":
            keep = {}
            for i, t in sorted(before.items()):
                keep.setdefault(" ".join(((t or "") + "|").split()), i)
            assert 101 not in after and {3, 4, 102} <= set(after)
        elif name == "simhash":
            fps = {i: simhash.fingerprint(t or "") for i, t in before.items()}
            stay = {i for i in before if not any(j < i and (fps[i] ^ fps[j]).bit_count() <= 4 for j in before)}
            assert set(after) <= set(before) and stay <= set(after) | {i for i in before if i not in stay}
            assert 100 not in after
        elif name == "secrets":
            net = secrets.trained()
            assert after == {i: t if t is None else secrets.redact(t, net) for i, t in before.items()}
            assert "abcdef123456" not in json.dumps(after)
        else:
            assert {r.doc_id for r in out.collect()} == set(before)
            fill = {}
            for r in out.collect():
                fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
            assert max(fill.values()) <= packing.SIZE
        docs = out


def plain_rows(spark, docs, labels):
    """run()'s rows but for places, in plain Python: texts one by one, pairs all against all."""
    machine = toxicity.train(docs, toxicity.training_labels(labels))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(i, t) for i, t in rows if slow_score(machine, t or "") < 0.5]
    first = {}
    for i, t in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    rows = [(i, t) for i, t in rows if i in first.values()]
    fps = {i: brute_fp(t) for i, t in rows}
    label = brute_components(sorted(set(fps.values())), 4)
    low = {}
    for i, _ in sorted(rows):
        low.setdefault(label[fps[i]], i)
    net, tok, out = secrets.trained(), byte_bpe.library(), []
    for i, t in rows:
        if i in low.values():
            ids = np.array([*tok.encode(secrets.redact(t or "", net), add_special_tokens=False).ids, 2], "<u4")
            out += [(i, k, s, n, crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut_points(len(ids), packing.SIZE))]
    return sorted(out)


def check_places(rows):
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= packing.SIZE


def test_run_equals_plain_python(spark, sf):
    got = corpus_pipeline.run(spark, sf).collect()
    want = plain_rows(spark, spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    check_places(got)
    assert corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "secrets", "packing"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_run_equals_plain_python_on_the_smallest_tables(spark):
    data = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, data).collect()
    want = plain_rows(spark, spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    check_places(got)


def test_stages_on_nulls_repeats_clashing_names_and_empty_tables(spark, tmp_path):
    r = random.Random(4)
    a, b, c = (" ".join(f"{r.getrandbits(40):x}"[:9] + "z" for _ in range(200)) for _ in range(3))
    schema = "doc_id bigint, text string, n_chars bigint, row_number int, id string, gone int, fp bigint, `key` string"
    rows = [(None, a), (None, b), (None, b), (5, a + " "), (5, c), (5, c), (7, None), (8, ""), (9, "password = 'abcdef123456'")]
    docs = spark.createDataFrame([(i, t, None, k, "x", 1, 2, "k") for k, (i, t) in enumerate(rows)], schema)
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        left[name] = sorted((r.row_number for r in docs.collect()), key=str) if name != "packing" else docs.count()
        empty = stage(spark, docs.limit(0) if name != "packing" else spark.createDataFrame([], schema), d)
        assert empty.count() == 0
    # Nothing is toxic without labels; of equal texts one row stays, the first of b and of c; "a " is near a and has an id.
    assert left["toxicity"] == list(range(9)) and left["exact_dedup"] == [0, 1, 3, 4, 6, 8]
    assert left["simhash"] == left["secrets"] == [1, 3, 4, 6, 8] and left["packing"] >= 5
