import base64
import hashlib

import pytest

from lumenrec.llm import warc

SCHEMA = "page_id bigint, url string, html string, sha1 string"


def brute(rows, least):
    seen = {}
    for i, _, h, _ in rows:
        if len((h or "").encode()) >= least:
            seen.setdefault(h or "", []).append(i)
    out = []
    for i, _, h, _ in rows:
        body = (h or "").encode()
        ids = [x for x in seen.get(h or "", []) if x is not None]
        first = min(ids) if ids else None
        to = first if first is not None and first != i else None
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if to is None else "revisit", to))
    return out


ROWS = [
    (5, "http://a/ b", "<p>x</p>", ""), (3, "http://b", "<p>x</p>", ""), (9, None, None, ""), (2, "u", "", ""), (7, "ü", "é\r\n\r\nWARC/1.1\r\n" * 5, ""), (7, "ü", "é\r\n\r\nWARC/1.1\r\n" * 5, ""),
    (-4, "neg", "neg", ""), ((1 << 62) + 5, "big", "<p>x</p>", ""), (11, "long", "z" * 3_000_000, ""),
]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip_matches_brute_force(spark, least):
    d = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(d, least).collect()]
    assert sorted(got, key=str) == sorted(brute(ROWS, least), key=str)


def test_empty_and_null_ids(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
    got = {(r.page_id, r.record_type) for r in warc.round_trip(spark.createDataFrame([(None, "u", "same", ""), (4, "u", "same", "")], SCHEMA)).collect()}
    assert got == {(None, "revisit"), (4, "response")}


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    body = [b"plain", b"with\nline ends\n\n", b""]
    data = warc.arc_opening(version, "x.arc") + b"".join(warc.arc_record(version, f"http://h/{k}", "20010203040506", b) for k, b in enumerate(body))
    got = list(warc.read_arc(data))
    assert [r["content"] for r in got] == body and got[1]["URL"] == "http://h/1"
    assert warc.warc_date(got[0]["Archive-date"]) == "2001-02-03T04:05:06Z"
    with pytest.raises(ValueError):
        list(warc.read_arc(data[:-3]))
    with pytest.raises(ValueError):
        list(warc.read_arc(b"http://no-opening 1 2 3 4\n"))


def test_identifiers_hold_the_page_id():
    for i in (0, 1, -1, warc.NULL_ID, (1 << 63) - 1, 123456789):
        made = warc.record_id(i, hashlib.sha1(b"x").digest())
        assert warc.page_of(made) == i and made[24] == "8" and made[29] in "89ab"
