import pytest
from pyspark.sql import functions as F

from lumenrec.operators import prep
from lumenrec.sources import readers, sinks, workspace


def ix(spark, rows):
    return spark.createDataFrame(rows, "user_id bigint, item_id bigint, ts bigint")


@pytest.mark.parametrize("n,want", [(10, (7, 1, 2)), (4, (2, 1, 1)), (90, (62, 9, 19)), (3, (2, 1, 0))])
def test_time_split_counts(spark, n, want):
    out = prep.time_split(ix(spark, [(1, k, k) for k in range(n)]))
    got = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == want


def test_time_split_orders_ties_by_item(spark):
    out = prep.time_split(ix(spark, [(1, k, 5) for k in (9, 3, 7, 1)]))
    assert {r.item_id: r.split for r in out.collect()} == {1: "train", 3: "train", 7: "val", 9: "test"}


def test_k_core_reaches_a_fixpoint(spark):
    rows = [(u, i, 0) for u in range(6) for i in range(4)] + [(9, 0, 0), (0, 50, 0)]
    out = prep.k_core(ix(spark, rows), 4, 5)
    assert out.count() == 24
    assert out.groupBy("user_id").count().agg(F.min("count")).first()[0] >= 4
    assert prep.k_core(ix(spark, [(1, 1, 1)]), 2, 2).count() == 0


def staircase(steps):
    """Interactions whose (2, 2)-core needs a round for each step: a path falls key by key from its end; a square stays."""
    path = [(100 + k // 2 + k % 2, 200 + k // 2, k) for k in range(2 * steps + 1)]
    return path + [(u, i, 0) for u in (1, 2) for i in (1, 2)] + [(1, 200 + steps, 0)]


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_k_core_of_many_rounds_deals_the_rows_once(spark, monkeypatch, broadcast):
    written, real = [], prep.store
    monkeypatch.setattr(prep, "store", lambda df, name="table": (written.append(name), real(df, name))[1])
    monkeypatch.setattr(prep, "BROADCAST_KEYS", broadcast, raising=False)
    rows = staircase(4) + [(None, 1, 0), (1, None, 0), (None, None, 0)]
    left, size = {r for r in rows if None not in r}, None
    while size != len(left):
        size = len(left)
        for side in (0, 1):
            have = [r[side] for r in left]
            left = {r for r in left if have.count(r[side]) >= 2}
    assert {tuple(r) for r in prep.k_core(ix(spark, rows), 2, 2).collect()} == left == {(u, i, 0) for u in (1, 2) for i in (1, 2)}
    assert written.count("k-core") == 1 and written.count("few") > 6  # rows are not written anew for a round


def test_histories_and_last_n(spark):
    rows = [(1, k, k) for k in range(30)] + [(2, 5, 1), (2, 4, 1)]
    got = {r.user_id: r.history for r in prep.histories(ix(spark, rows), 20).collect()}
    assert got == {1: list(range(10, 30)), 2: [4, 5]}


def test_normalise_id(spark):
    ok = spark.createDataFrame([("2858.0",), (" 7 ",), ("12",)], "x string").select(prep.normalise_id(F.col("x")).alias("i"))
    assert [r.i for r in ok.collect()] == [2858, 7, 12]
    for bad in ("1.5", "NaN", "", None, "abc"):
        with pytest.raises(Exception, match="not a whole id"):
            spark.createDataFrame([(bad,)], "x string").select(prep.normalise_id(F.col("x"))).collect()


def test_global_rank_is_total(spark):
    df = spark.createDataFrame([(k * 37 % 101,) for k in range(101)], "x int").repartition(5)
    got = sorted((r.x, r["rank"]) for r in prep.global_rank(df, ["x"]).collect())
    assert got == [(k, k + 1) for k in range(101)]
    assert prep.global_rank(df.limit(0), ["x"]).count() == 0


def test_user_split_share(spark):
    users = spark.createDataFrame([(k,) for k in range(50)], "user_id bigint")
    assert prep.user_hash_split(users).filter("is_val").count() == 10


def test_delimited_sources(spark, tmp_path):
    (tmp_path / "r.dat").write_bytes("1::10::5::978300760\n2::20::3::978302109\n".encode("latin-1"))
    (tmp_path / "m.dat").write_bytes("10::Amélie (2001)::Comedy|Romance\n11::Untitled::Drama\n".encode("latin-1"))
    (tmp_path / "u.dat").write_text("1::F::1::10::48067\n")
    r = readers.ratings(spark, str(tmp_path / "r.dat")).collect()
    assert (r[0].user_id, r[0].movie_id, r[0].rating, r[0].timestamp) == (1, 10, 5, 978300760)
    m = {x.movie_id: x for x in readers.movies(spark, str(tmp_path / "m.dat")).collect()}
    assert (m[10].year, m[10].clean_title, m[11].year, m[11].clean_title) == ("2001", "Amélie", None, "Untitled")
    assert readers.users(spark, str(tmp_path / "u.dat")).first().zip_code == "48067"
    assert prep.positive(readers.ratings(spark, str(tmp_path / "r.dat"))).count() == 1


def test_json_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.json").write_text('{\n "movie_id": 1, "title": "T", "genres": ["A", "B"]\n}')
    (tmp_path / "a" / "2.json").write_text('{"movie_id": 2}')
    assert readers.metadata_directory(spark, str(tmp_path / "a")).count() == 2
    (tmp_path / "x.jsonl").write_text('{"user_id": 1}\n\nnot json\n{"user_id": 2}\n')
    schema = "user_id bigint"
    assert readers.json_lines(spark, str(tmp_path / "x.jsonl"), schema, drop_malformed=True).filter("user_id IS NOT NULL").count() == 2
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "x.jsonl"), schema).collect()


def test_credits_and_vectors(spark, tmp_path):
    import numpy as np

    row = ([{"name": f"a{k}", "job": None} for k in range(7)], [{"name": "d", "job": "Director"}, {"name": "w", "job": "Writer"}])
    df = spark.createDataFrame([row], readers.CREDITS_JSON)
    a, d = readers.credits_lists(F.col("cast"), F.col("crew"))
    got = df.select(a.alias("a"), d.alias("d")).first()
    assert got.a == ["a0", "a1", "a2", "a3", "a4"] and got.d == ["d"]
    np.save(tmp_path / "v.npy", np.eye(3))
    np.save(tmp_path / "i.npy", np.array([5, 6, 7]))
    assert {r.id: r.vector for r in readers.vectors_npy(spark, str(tmp_path / "v.npy"), str(tmp_path / "i.npy")).collect()}[6] == [0.0, 1.0, 0.0]


def test_paths_and_score_columns(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.7), (2, 9, 0.1)], "user_id bigint, movie_id bigint, lgcn_score double")
    assert readers.optional(spark, p) is None and readers.optional(spark, None) is None
    with pytest.raises(FileNotFoundError):
        readers.required(spark, p)
    sinks.overwrite(df, p)
    assert readers.first_existing(spark, [p + "no", p]) == p and readers.required(spark, p).count() == 3
    std = readers.standard_scores(df)
    assert std.columns == ["user_id", "movie_id", "cf_score", "kg_recall_score"]
    assert {(r.user_id, r.movie_id) for r in readers.ranked_recommendations(std, 1).collect()} == {(1, 3), (2, 9)}
    assert readers.ranked_recommendations(df.withColumn("rank", F.lit(2)), 1).count() == 0
    with pytest.raises(ValueError):
        readers.ranked_recommendations(df.drop("lgcn_score"), 1)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "a"), (3, 4, "b")], "doc_id bigint, movie_id bigint, text string")
    sinks.corpus(df, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c" / "doc_to_movie")).columns == ["doc_id", "movie_id"]
    for _ in range(2):
        sinks.append_json(df, str(tmp_path / "j"))
    assert sinks.load_explanations(spark, str(tmp_path / "j"), df.schema).count() == 4
    sinks.faithfulness(df, df.limit(1), {"n": 2}, str(tmp_path / "f"))
    assert spark.read.text(str(tmp_path / "f" / "metadata")).first().value == '{"n": 2}'
    table = sinks.markdown([{"metric": "x", "v": 0.123456789, "n": float("nan")}, {"metric": "longer", "v": 2.0}], ["metric", "v", "n"])
    assert table.split("\n")[2].startswith("| x      | 0.123457 |") and "nan" not in table


def test_stored_tables_leave_no_rounds_and_no_shuffles(spark, tmp_path, monkeypatch):
    """Of a k-core only the last round stays; shuffle files go with a stored table's write and the setting returns."""
    monkeypatch.setattr(workspace, "root", lambda _: f"file://{tmp_path}")
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    out = prep.k_core(ix(spark, [(u, i, u + i) for u in range(6) for i in range(6)] + [(9, 9, 9)]), 2, 2)
    assert out.count() == 36
    assert len(list(tmp_path.glob("k-core-*"))) == 1
    assert spark.conf.get(name) == before
    with workspace._swept(spark):
        assert spark.conf.get(name) == "true"
