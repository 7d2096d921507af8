import os
import re

import numpy as np
import pytest

from lumenrec.llm import secrets


def brute_base(text):
    out = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


TEXTS = [
    "", "password = 'hunter22' and token:abc", "SECRET=token :abcdefgh api_key=\"zzzzzzz\"", "AKIA" + "Q" * 16 + " AKIAAKIA" + "B2" * 8, "é" * 5 + "0123456789abcdef" * 2,
    "apikey=" + "0a" * 20, "paſſword: abcdefgh toKen=abcdefg", "token = \n x", "deadbeef" * 3 + "G" + "deadbeef" * 2, "secret secret=secret=abcdefghij", "x" * 200_000 + " passwd=abcdef",
]


def test_base_spans_match_plain_patterns():
    for t in TEXTS:
        assert secrets.base_spans(t) == brute_base(t)


def test_network_is_accurate_and_calibrated_on_new_findings():
    net = secrets.trained()
    fresh = secrets.labelled_findings(2000, 99)
    p = net.probability(np.stack([next(secrets.windows(t, s, e)) for t, s, e, _ in fresh]))
    y = np.array([b for *_, b in fresh])
    assert (p[y == 1] >= net.threshold).mean() > 0.95 and (p[y == 0] < net.threshold).mean() > 0.95


def test_threshold_keeps_the_recall():
    net = secrets.trained()
    recall, alarms = net.held_out
    assert recall >= 0.96 and alarms <= 0.05
    strict, loose = secrets.trained(2000, 2, 0.9), secrets.trained(2000, 2, 0.999)
    assert loose.threshold < strict.threshold and loose.held_out[0] >= strict.held_out[0]  # no floor stands in the way of recall


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_recall_on_findings_of_the_tables(spark):
    """The base patterns' own findings are secrets for sure: the network, asked alone, finds them."""
    net, hits, sure = secrets.trained(), 0, 0
    for t in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        for _, s, e in secrets.base_spans(t.text or ""):
            rows = np.stack(list(secrets.windows(t.text, s, e)))
            if e - s >= 16:
                sure += 1
                hits += net.probability(rows).max() >= net.threshold
    assert sure > 20 and hits / sure >= 0.95


def test_added_spans_never_overlap_base_and_base_stays():
    net = secrets.trained()
    text = "see ghp_" + "aB3dE5gH7jK9" * 3 + " or password=Zx81kQpw72Lm and www.example.com/path/12/index page"
    found = secrets.find(text, net)
    base = [(k, s, e) for k, s, e, _ in found if k != "cnn"]
    assert base == brute_base(text)
    assert any(k == "cnn" for k, *_ in found)
    assert "ghp_" not in secrets.redact(text, net) and "Zx81" not in secrets.redact(text, net) and "example.com" in secrets.redact(text, net)


def test_tables(spark):
    rows = [(k, t, "k", 1) for k, t in enumerate(TEXTS)] + [(0, None, "k", 1), (1, TEXTS[1], "k", 1)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, spans string, n_chars bigint")
    got = sorted((r.id, [(s.kind, s.start, s.stop) for s in r.spans if s.kind != "cnn"]) for r in secrets.scan(d).collect())
    assert got == sorted((i, brute_base(t or "")) for i, t, *_ in rows)
    masked = secrets.redact_secrets(d)
    assert masked.schema == d.schema and masked.count() == len(rows)
    assert not any(brute_base(r.text or "") for r in masked.collect())
    assert secrets.scan(spark.createDataFrame([], d.schema)).count() == 0
