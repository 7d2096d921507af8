import random
import re

import numpy as np
import pytest
import xxhash

from lumenrec.llm import simhash
from lumenrec.llm.components import components


def brute_fp(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    out = 0
    for b in range(64):
        n = sum(xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1 for g in grams)
        out |= (2 * n > len(grams)) << b
    return out


def brute_components(fps, radius):
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= radius and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_fingerprint_matches_brute_force():
    r = random.Random(1)
    for _ in range(200):
        t = "".join(r.choice(["Ab", "cd ", "É", "\t", "\n x", "  ", "zz\x0b", " ", "Q"]) for _ in range(r.randint(0, 60)))
        assert simhash.fingerprint(t) == brute_fp(t)
    assert simhash.fingerprint("") == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("radius,parts", [(4, None), (4, 2), (4, 3), (4, 5), (3, 4), (1, 1)])
def test_groups_match_brute_force(spark, radius, parts):
    r = random.Random(radius * 10 + (parts or 0))
    fps = []
    for _ in range(6):
        base = r.getrandbits(64)
        now = base
        for _ in range(25):
            fps.append(now)
            now ^= sum(1 << b for b in r.sample(range(64), r.choice([0, 1, 2, 3, 4, 5])))
    fps += [0, 1, (1 << 64) - 1, 3 << 60]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    edges = simhash.links(table, radius, parts)
    want = {(min(a, b), max(a, b)) for a, x in zip(signed, fps) for b, y in zip(signed, fps) if a != b and (x ^ y).bit_count() <= radius}
    assert {(r.a, r.b) for r in edges.collect()} == want
    if parts != 2:  # every key beyond three fingerprints is dealt into blocks
        assert {(r.a, r.b) for r in simhash.links(table, radius, parts, 3).collect()} == want
    got = {r.v & (1 << 64) - 1: r.label for r in components(edges).collect()}
    want = brute_components(fps, radius)
    groups_got, groups_want = {}, {}
    for f in fps:
        groups_got.setdefault(got.get(f, f"own{f}"), set()).add(f)
        groups_want.setdefault(want[f], set()).add(f)
    assert sorted(map(sorted, groups_got.values())) == sorted(map(sorted, groups_want.values()))


def test_masks_share_a_key_exactly_within_threshold():
    bits = list(range(7))
    for t in range(0, 4):
        masks = simhash.key_masks(bits, t)
        keys = {v: {(tag, (v & ~clear) ^ flip) for tag, clear, flip in masks} for v in range(128)}
        for a in range(0, 128, 5):
            for b in range(128):
                if (a ^ b).bit_count() <= t:
                    assert keys[a] & keys[b]


def test_documents_and_edge_cases(spark):
    words = [f"w{k}" for k in range(400)]
    near = words.copy()
    near[200] = "changed"
    rows = [(4, " ".join(words), 1), (2, " ".join(near), 1), (9, " ".join(words).upper(), 1), (5, None, 1), (3, "  ", 1), (8, "other text entirely here now", 1), (8, "other text entirely here now", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    got = sorted((r.id, r.component_id) for r in simhash.near_groups(docs).collect())
    fps = {i: brute_fp(t) for i, t, _ in rows}
    linked = (fps[4] ^ fps[2]).bit_count() <= 4
    assert got == sorted([(4, 2 if linked else 4), (2, 2), (9, 2 if linked else 4), (5, 3), (3, 3), (8, 8), (8, 8)])
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got})
    empty = spark.createDataFrame([], docs.schema)
    assert simhash.near_groups(empty).count() == 0 and simhash.drop_near_copies(empty).count() == 0


def test_repeated_ids_lose_no_component(spark):
    """Null ids and one id on unrelated texts: a row of each component stays, and no near copy by its id."""
    r = random.Random(3)
    a, b, c, d = ([f"{r.getrandbits(40):x}" for _ in range(300)] for _ in range(4))
    copy = [*d[:150], "changed", *d[151:]]
    assert 0 < (brute_fp(" ".join(d)) ^ brute_fp(" ".join(copy))).bit_count() <= 4
    rows = [(None, a, 1), (None, b, 2), (None, b, 2), (7, c, 3), (7, copy, 4), (3, d, 5), (None, d, 6)]
    docs = spark.createDataFrame([(i, " ".join(t), n) for i, t, n in rows], "doc_id bigint, text string, n int")
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((str(k.doc_id), k.n) for k in kept.collect()) == [("3", 5), ("7", 3), ("None", 1), ("None", 2)]


def test_thresholds_add_up():
    joint = np.diag(np.full(64, 50.0)) + 25
    for parts in (1, 2, 3, 5):
        groups, thresholds = simhash.plan(100, joint, 4, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert sum(thresholds) == 4 - parts + 1
    for bits, t in ((13, 0), (16, 1), (21, 2), (9, 3)):
        assert simhash.keys_per_row(bits, t) == len(simhash.key_masks(list(range(bits)), t))


def test_more_fingerprints_take_fewer_partitions():
    def parts(n):
        return len(simhash.plan(n, np.full((64, 64), n / 4) + np.diag(np.full(64, n / 4)), 4)[0])

    assert parts(10_000) == 5 and parts(10**10) == 2 and parts(10**7) in (3, 4)
