"""The contract queries over the smallest tables, against SQL or brute force."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from lumenrec.llm import oracles, queries
from lumenrec.llm.byte_bpe import library

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{DATA}/documents.parquet'").fetchall()


def rows(spark, name):
    return queries.queries()[name](spark, DATA).collect()


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({oracles.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(*cols).collect())


def test_op1(spark, docs):
    by = {}
    got = rows(spark, "op1_packing")
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    tok = library()
    for i, t in docs:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)  # gapless, nothing overlaps
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 1024 and sum(fill.values()) == sum(r.length for r in got)
    assert len(fill) <= -(-sum(fill.values()) // 1024) + 1  # the sum of lengths allows one less at best


def test_op2(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op2_toxicity")}
    assert set(got) == {i for i, _ in docs}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op3(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op3_secrets")}
    for i, t in docs:
        found = [("assign", m.start(), m.end()) for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.I | re.A) if len(m[2]) >= 6]
        found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        found.sort(key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
        told = [f"{k}:{s}:{e}" for k, s, e in found]
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(f[0] == k for f in found) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest() and set(told) <= set(r.spans.split(",")) | {""}


def test_op4(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op4_simhash")}
    fps = {i: int(r.fingerprint, 16) for i, r in got.items()}
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4 and label[b] < label[a]:
                    label[a], changed = label[b], True
    assert {i: r.component_id for i, r in got.items()} == label and len(label) == len(docs)


def test_op5(spark, docs):
    tok = library()
    want = {i: (len(t.encode()), n := len(tok.encode(t, add_special_tokens=False).ids), n > 1024) for i, t in docs}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows(spark, "op5_token_counts")} == want


def test_op8(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for i, t in docs:
        ids = sp.encode(t)
        want[i] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    assert {r.doc_id: (r.n_pieces, r.ids_crc32, r.decoded_sha256) for r in rows(spark, "op8_sentence_piece")} == want


def test_op9(spark, docs):
    want = {}
    for i, t in docs:
        p = t.encode()
        p += b"\xff" * (-len(p) % 576 if p else 576)
        want[i] = (len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows(spark, "op9_media")} == want
