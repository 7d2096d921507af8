import hashlib
import re

from lumenrec.llm import exact_dedup

SCHEMA = "doc_id bigint, text string, digest string, run int"


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in rows]
    groups = {}
    for k, (r, n) in enumerate(zip(rows, norm)):
        groups.setdefault(n, []).append((r[0] is None, r[0] or 0, k))
    out = []
    for r, n in zip(rows, norm):
        g = groups[n]
        out.append((r[0], min(g)[1] if not min(g)[0] else None, len(g), hashlib.sha256(n.encode()).hexdigest()))
    return out


ROWS = [
    (5, "a  b", "x", 1), (3, "a\tb", "x", 1), (9, None, None, None), (2, "", "y", 2), (7, "c", None, 3),
    (7, "c", None, 3), (8, "a b ", "x", 1), (None, "c", "z", 4), (11, "é" * 200_000, "l", 5), (10, "é" * 200_000, "l", 5),
]


def test_groups_match_brute_force(spark):
    for runs, fan_in in ((1, 2), (5, 2), (256, 16)):
        got = exact_dedup.exact_groups(spark.createDataFrame(ROWS, SCHEMA).repartition(3), runs=runs, fan_in=fan_in).collect()
        rows = sorted(((r.id, r.keep_id, r.group_size, r.digest.hex()) for r in got), key=str)
        assert rows == sorted(brute(ROWS), key=str)
        kept = [r for r in got if r.kept]
        assert len(kept) == len({r.digest.hex() for r in got})  # one row of each group, also of repeated rows


def test_drop_keeps_one_row_of_each_text(spark):
    out = exact_dedup.drop_exact_copies(spark.createDataFrame(ROWS, SCHEMA))
    assert out.columns == ["doc_id", "text", "digest", "run"]
    assert sorted(r.doc_id for r in out.collect()) == [2, 3, 7, 8, 10]


def test_the_marked_row_stays_and_any_column_name_is_fine(spark):
    rows = [(7, "c", k, "d", 1, 2) for k in range(40)] + [(None, "c", 99, "d", 1, 2), (8, "e", 5, "d", 1, 2)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, row_number int, __digest string, gone int, pos int").repartition(4, "row_number")
    out = exact_dedup.drop_exact_copies(d)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == [7, 8]
    plain = spark.createDataFrame([(k, f"t{k % 3}", 1) for k in range(9)], "doc_id bigint, text string, __keep_id int")
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_copies(plain).collect()) == [0, 1, 2]
    assert "BroadcastHashJoin" in exact_dedup.drop_exact_copies(plain)._jdf.queryExecution().executedPlan().toString()  # texts stay where they are


def test_empty_table(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert exact_dedup.drop_exact_copies(spark.createDataFrame([], SCHEMA)).count() == 0
