import os

import pytest
from pyspark.sql import functions as F

from lumenrec.operators import graph
from lumenrec.plans import phases
from lumenrec.sources import lookup

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_phases_end_to_end(spark, tmp_path):
    out = str(tmp_path)
    recs = phases.recommend(spark, DATA, out, rounds=2)
    assert recs.columns == ["user_id", "movie_id", "rank", "pred_score", "label"] and recs.count() > 0
    first = phases.explain_top(spark, DATA, out)
    n = first.count()
    assert n > 0 and phases.explain_top(spark, DATA, out).count() == n  # a second run adds nothing
    report = phases.evaluate(spark, out)
    assert report.count("\n") == 13 and "E4" in report


def test_lookup_with_a_fake_service(spark):
    def fetch(path, params):
        if path == "search/movie":
            return {"results": [] if params["query"] == "none" else [{"id": 7}, {"id": 8}]}
        if path.endswith("credits"):
            return {"cast": [{"name": f"a{k}"} for k in range(9)], "crew": [{"name": "d", "job": "Director"}, {"name": "w", "job": "Writer"}]}
        return {"title": "T", "genres": [{"name": "G"}], "overview": "o", "vote_count": 3}

    movies = spark.createDataFrame([(1, "x", 1999), (2, "none", None)], "movie_id bigint, title string, year int")
    got = {r.movie_id: r for r in lookup.lookup(movies, fetch).collect()}
    assert got[1].tmdb_id == 7 and got[1].actors == [f"a{k}" for k in range(5)] and got[1].directors == ["d"] and got[2].tmdb_id is None
    assert [r.movie_id for r in lookup.not_yet(movies, movies.filter("movie_id = 1")).collect()] == [2]


def test_subgraph_cap(spark):
    rows = [("movie_0", "has_genre", f"genre_{k}") for k in range(30)] + [(f"movie_{k}", "has_genre", "genre_1") for k in range(1, 20)]
    kg = spark.createDataFrame(rows, "head string, relation string, tail string")
    e = graph.subgraph(kg, "movie_0", 2, 10)
    nodes = {n for r in e.collect() for n in (r.src, r.dst)}
    assert len(nodes) <= 10 and "movie_0" in nodes
    assert spark.createDataFrame([("genre_Sci_Fi",)], "e string").select(graph.entity_label(F.col("e")).alias("l")).first().l == "Sci_Fi"
