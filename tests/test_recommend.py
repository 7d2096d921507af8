import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenrec.functions import metrics
from lumenrec.functions import vectors as V
from lumenrec.operators import features, graph, ranker, recall


def ix(spark, rows):
    return spark.createDataFrame([(u, i, k) for k, (u, i) in enumerate(rows)], "user_id bigint, item_id bigint, ts bigint")


def test_item_cf_by_hand(spark):
    train = ix(spark, [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 2), (3, 3)])
    got = {(r.user_id, r.item_id): r.score for r in recall.item_cf(train, 5).collect()}
    assert got[1, 3] == pytest.approx(1 / 2 + 2 / math.sqrt(6))
    assert set(got) == {(1, 3), (3, 1)}


def test_item_cf_fills_with_zero_scores_by_id(spark):
    train = ix(spark, [(1, 5), (2, 5), (2, 9), (3, 1), (3, 2), (4, 2)])
    got = [(r.item_id, r.score, r["rank"]) for r in recall.item_cf(train, 3).filter("user_id = 1").orderBy("rank").collect()]
    assert got == [(9, pytest.approx(1 / math.sqrt(2)), 1), (1, 0.0, 2), (2, 0.0, 3)]


def test_merge_by_hand(spark):
    cf = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.5, 2)], "user_id bigint, item_id bigint, score double, rank int")
    kg = spark.createDataFrame([(1, 11, 0.8, 1), (1, 12, 0.7, 2)], "user_id bigint, item_id bigint, score double, rank int")
    got = [(r.item_id, r.cf_score, r.kg_score, r.source) for r in recall.merge_routes(cf, kg).orderBy("rank").collect()]
    assert got == [(10, 0.9, 0.0, "cf"), (11, 0.5, 0.8, "both"), (12, 0.0, 0.7, "kg")]
    assert recall.merge_routes(cf, kg, n_total=2).count() == 2
    comp = recall.compensated_kg(cf, kg, n_kg=1, n_total=3)
    assert sorted(r.item_id for r in comp.collect()) == [11, 12]


def test_decay_weights(spark):
    train = ix(spark, [(1, 1), (1, 2), (1, 3)])
    vec = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0])], "item_id bigint, vector array<double>")
    p = recall.profiles(train, vec, None, decay=True, normalise=False).first().profile
    w = [math.exp(-2), math.exp(-1), 1]
    assert p == pytest.approx([x / sum(w) for x in w])
    one = recall.profiles(ix(spark, [(1, 2)]), vec, None, decay=True).first().profile
    assert one == pytest.approx([0, 1, 0])


def test_many_items_meet_the_queries_without_copies_of_queries(spark, monkeypatch):
    """Items beyond the limit travel in shares: no query goes to each block of items, and the best equal brute force."""
    import numpy as np

    monkeypatch.setattr(V, "BLOCK", 3)
    monkeypatch.setattr(V, "BROADCAST_LIMIT", 64)
    rng = np.random.default_rng(3)
    q, x = rng.integers(-2, 3, (9, 2)).astype(float), rng.integers(-2, 3, (14, 2)).astype(float)
    asked = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(q)], "q bigint, vector array<double>")
    items = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "item_id bigint, vector array<double>")
    seen = spark.createDataFrame([(i, i % 5) for i in range(8)], "q bigint, item_id bigint")
    top = V.top_inner_products(asked, items, 4, seen)
    assert "FlatMapCoGroups" not in top._jdf.queryExecution().toString() and "Exchange" not in top._jdf.queryExecution().toString()
    got = {(r.q, r["rank"]): (r.item_id, r.score) for r in top.collect()}
    for i in range(9):
        best = sorted((j for j in range(14) if i > 7 or j != i % 5), key=lambda j: (-(q[i] @ x[j]), j))[:4]
        assert [got[i, n + 1] for n in range(4)] == [(j, q[i] @ x[j]) for j in best]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_top_inner_products_excludes_and_blocks(spark, monkeypatch, limit):
    monkeypatch.setattr(V, "BLOCK", 2)
    monkeypatch.setattr(V, "BROADCAST_LIMIT", limit)
    items = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(7)], "item_id bigint, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "q bigint, vector array<double>")
    seen = spark.createDataFrame([(1, 6)], "q bigint, item_id bigint")
    got = {(r.q, r["rank"]): r.item_id for r in V.top_inner_products(asked, items, 2, seen).collect()}
    assert got == {(1, 1): 5, (1, 2): 4, (2, 1): 0, (2, 2): 1}
    assert V.top_inner_products(asked, items.limit(0), 2, seen).count() == 0


@pytest.mark.parametrize("k,want", [(3, (1, 0.919721, 1.0, 1.0)), (2, (1, 0.613147, 0.5, 1.0))])
def test_metrics_by_hand(spark, k, want):
    ranked = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 4, 1)], "user_id bigint, item_id bigint, rank int")
    truth = spark.createDataFrame([(1, 1), (1, 3), (2, 1), (3, 9)], "user_id bigint, item_id bigint")
    got = {r.user_id: r for r in metrics.per_user(ranked, truth, k).collect()}
    assert set(got) == {1, 2}
    assert (got[1].hit, got[1].ndcg, got[1].recall, got[1].mrr) == pytest.approx(want, abs=1e-6)
    assert (got[2].hit, got[2].ndcg, got[2].recall, got[2].mrr) == (0, 0, 0, 0)
    assert metrics.coverage(ranked, truth, [1]).first().coverage == pytest.approx(2 / 3)


def test_strata_and_entropy(spark):
    pop = spark.createDataFrame([(k, k) for k in (1, 2, 3, 4)], "item_id bigint, popularity bigint")
    assert {r.item_id: r.stratum for r in metrics.head_tail(pop).collect()} == {1: "tail", 2: "tail", 3: "head", 4: "head"}
    meta = spark.createDataFrame([(1, ["A", "B"]), (2, ["A", "B"])], "item_id bigint, genres array<string>")
    got = {r.user_id: r.entropy for r in metrics.user_entropy(ix(spark, [(1, 1), (1, 2), (2, 77)]), meta).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == 0.0
    x = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 8.0)], "v double")
    assert x.agg(F.percentile("v", F.lit(0.333))).first()[0] == pytest.approx(1.999)


META = [(1, "one", ["g", "h"], ["a"], "d", 1990, 5), (2, "two", ["g"], ["a", "b"], "d", 1990, 5), (3, "three", ["x"], [], "e", 2000, 5), (4, "four", ["g"], ["b"], "f", None, 0)]


def kg(spark):
    meta = spark.createDataFrame(META, "item_id bigint, title string, genres array<string>, actors array<string>, director string, decade int, vote_count bigint")
    train = ix(spark, [(1, 1), (1, 3), (2, 1), (2, 3), (3, 2)])
    return graph.triples(meta, train, 2)


def test_graph_structures(spark):
    g = kg(spark)
    assert {(r.head, r.tail) for r in g.filter("relation = 'co_liked'").collect()} == {("movie_1", "movie_3")}
    ids = graph.entities(g).orderBy("entity_id").collect()
    assert [r.entity for r in ids] == sorted(r.entity for r in ids) and ids[0].entity_id == 0
    idf = {r.entity: r.idf for r in graph.entity_idf(g).collect()}
    assert idf["genre_g"] == pytest.approx(math.log(4 / 3)) and idf["actor_b"] == pytest.approx(math.log(2))
    assert {r.neighbour for r in graph.neighbours(g, "movie_1", "has_genre").collect()} == {"genre_g", "genre_h"}
    depth = {r.node: r.depth for r in graph.bfs(g, spark.createDataFrame([("movie_3",)], "node string"), 2).collect()}
    assert depth["movie_3"] == 0 and depth["movie_1"] == 1 and depth["genre_g"] == 2 and "movie_4" not in depth


def test_pairwise_and_user_features(spark):
    g = kg(spark)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 4)], "a bigint, b bigint")
    got = {(r.a, r.b): r for r in graph.pairwise(g, pairs).collect()}
    p = got[1, 2]
    assert (p.shared_actor_count, p.same_director, p.same_genre_count, p.same_decade, p.co_liked) == (1, 1, 1, 1, 0)
    assert p.same_genre_idf == pytest.approx(math.log(4 / 3)) and got[1, 3].co_liked == 1 and got[3, 4].same_genre_count == 0
    cand = spark.createDataFrame([(7, 2), (8, 2)], "user_id bigint, item_id bigint")
    hist = spark.createDataFrame([(7, 1), (7, 999)], "user_id bigint, source bigint")
    f = {r.user_id: r for r in graph.user_candidate_features(g, cand, hist).collect()}
    assert f[7].kg_same_decade_ratio == 0.5 and f[7].kg_same_director_max == 1 and f[8].kg_shared_actor_count_sum == 0


def test_paths(spark):
    g = kg(spark)
    pairs = spark.createDataFrame([(1, 3, 1, 1), (1, 4, 1, 1), (1, 4, 3, 2)], "user_id bigint, item_id bigint, source bigint, age int")
    hops = {r.item_id: r.hops for r in graph.path_lengths(g, pairs).collect()}
    assert hops == {3: 1, 4: 2}
    chain = spark.createDataFrame([(f"movie_{k}", "co_liked", f"movie_{k + 1}") for k in range(20, 31)] + [("movie_50", "co_liked", "movie_51")], "head string, relation string, tail string")
    far = spark.createDataFrame([(1, 31, 20), (1, 31, 22), (1, 51, 20), (2, 23, 23), (2, 28, 23), (3, 77, 20)], "user_id bigint, item_id bigint, source bigint")
    assert {(r.user_id, r.item_id): r.hops for r in graph.path_lengths(chain, far).collect()} == {(1, 31): 9, (1, 51): None, (2, 23): 0, (2, 28): 5, (3, 77): None}
    rows = graph.two_hop_paths(g, pairs).collect()
    assert {(r.item_id, r.source, r.mid) for r in rows} == {(3, 1, None), (4, 1, "genre_g")}


def test_features(spark):
    vec = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0, 0.0])], "item_id bigint, vector array<double>")
    train, cand = ix(spark, [(1, 1), (1, 50)]), spark.createDataFrame([(1, 2), (1, 50), (9, 2)], "user_id bigint, item_id bigint")
    c = {(r.user_id, r.item_id): r.content_similarity for r in features.content_similarity(cand, train, vec).collect()}
    assert c == {(1, 2): pytest.approx(0.6), (1, 50): 0.0, (9, 2): 0.0}
    e = {(r.user_id, r.item_id): r for r in features.embedding_features(cand, train, vec).collect()}
    assert e[1, 2].kg_emb_mean_dist == pytest.approx(math.sqrt(20)) and e[1, 2].kg_emb_max_cos == pytest.approx(0.6) and e[9, 2].kg_emb_max_cos == 0
    got = [r.c for r in spark.createDataFrame([("kg_recall_score",), ("cf_score",), ("popularity",)], "f string").select(features.category(F.col("f")).alias("c")).collect()]
    assert got == ["KG", "CF", "Content"]
    assert features.resolve(features.FEATURE_SETS["V3"], ["cf_score", "kg_a", "kg_emb_x", "kg_recall_score"]) == ["cf_score", "kg_recall_score", "kg_a"]


def test_item_cf_in_parts(spark, monkeypatch):
    """Lists cut in parts, several passes and small groups give the plain sums."""
    monkeypatch.setattr(recall, "CHUNK", 2)
    monkeypatch.setattr(recall, "PASS_ENTRIES", 5)
    pairs = sorted({(u, (u * 7 + k * k) % 11) for u in range(9) for k in range(2 + u % 4)})
    users = {u: {i for v, i in pairs if v == u} for u, _ in pairs}
    d = {i: sum(i in own for own in users.values()) for _, i in pairs}
    want = {}
    for u, own in users.items():
        s = {j: sum(sum({i, j} <= o for o in users.values()) / math.sqrt(d[i] * d[j]) for i in own) for j in d if j not in own}
        for rank, j in enumerate(sorted(s, key=lambda j: (s[j] == 0, -round(s[j], 6), j))[:4], 1):
            want[u, j] = (rank, pytest.approx(s[j]))
    got = recall.item_cf(ix(spark, pairs), 4)
    assert {(r.user_id, r.item_id): (r["rank"], r.score) for r in got.collect()} == want


def test_neighbour_counts_by_parts(monkeypatch):
    monkeypatch.setattr(recall, "CHUNK", 2)
    monkeypatch.setattr(recall, "SUM_ENTRIES", 1)
    rows = [(u, i, 3, part, [3] * len(part)) for i in (1, 2, 3, 4) for u in (1, 2, 3) for part in ([1, 2], [3, 4])]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names=["user_id", "item_id", "d", "near", "dn"])
    made = [r for b in recall._count(iter([batch])) for r in b.to_pylist()]
    assert all(len(r["users"]) <= 2 and len(r["near"]) <= 2 for r in made)
    got = sorted((r["item_id"], u, j, s) for r in made for u in r["users"] for j, s in zip(r["near"], r["sims"], strict=True))
    assert got == [(i, u, j, 1.0) for i in (1, 2, 3, 4) for u in (1, 2, 3) for j in (1, 2, 3, 4) if j != i]


def test_merge_takes_one_exchange(spark):
    routes = [spark.createDataFrame([(1, 10, 0.9, 1)], "user_id bigint, item_id bigint, score double, rank int") for _ in range(2)]
    plan = recall.merge_routes(*routes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def _plan_of_shuffles(spark, make) -> str:
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_labels_and_caps_deal_candidates_once(spark):
    cand = spark.createDataFrame([(1, 2), (1, 3), (2, 2)], "user_id bigint, item_id bigint")
    pos = spark.createDataFrame([(1, 3), (1, 3), (3, 2)], "user_id bigint, item_id bigint")
    assert sorted(map(tuple, recall.label(cand, pos).collect())) == [(1, 2, 0), (1, 3, 1), (2, 2, 0)]
    assert _plan_of_shuffles(spark, lambda: ranker.cap_groups(recall.label(cand, pos), 1)).count("Exchange hashpartitioning") == 2


def test_metrics_of_all_cuts_take_one_pass(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3), (2, 5, 1), (3, 5, 1)], "user_id bigint, item_id bigint, rank int")
    truth = spark.createDataFrame([(1, 6), (1, 8), (2, 6), (4, 5)], "user_id bigint, item_id bigint")
    got = {r.k: r for r in metrics.at_k(ranked, truth, [1, 2]).collect()}
    assert (got[1].users, got[1].hit, got[1].mrr) == (2, 0.0, 0.0) and (got[2].hit, got[2].recall, got[2].mrr) == (0.5, 0.25, 0.25)
    assert got[2].ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)) / 2)
    assert _plan_of_shuffles(spark, lambda: metrics.at_k(ranked, truth, [1, 5, 10])).count("Exchange hashpartitioning") <= 9


def test_merge_for_users_without_vectors_takes_one_exchange(spark):
    cf = spark.createDataFrame([(u, i, 1.0 - i / 10, i) for u in (1, 2) for i in (1, 2, 3)], "user_id bigint, item_id bigint, score double, rank int")
    kg = spark.createDataFrame([(1, 3, 0.5, 1)], "user_id bigint, item_id bigint, score double, rank int")
    merge = lambda: recall.merge_routes(cf, kg, n_cf=1, n_total=2, cf_only_users=True)
    assert sorted((r.user_id, r.item_id, r.cf_score, r.source) for r in merge().collect()) == [(1, 1, 0.9, "cf"), (1, 3, 0.0, "kg"), (2, 1, 0.9, "cf"), (2, 2, 0.8, "cf")]
    assert _plan_of_shuffles(spark, merge).count("Exchange hashpartitioning") == 1


def test_user_features_by_shares_of_users(spark, monkeypatch):
    g, cand = kg(spark), spark.createDataFrame([(7, 2), (8, 2), (7, 3), (9, 77)], "user_id bigint, item_id bigint")
    hist = spark.createDataFrame([(7, 1), (7, 3), (9, 1), (10, 1)], "user_id bigint, source bigint")
    whole = sorted(map(tuple, graph.user_candidate_features(g, cand, hist).collect()))
    monkeypatch.setattr(graph, "PASS_ROWS", 1)
    made = graph.user_candidate_features(g, cand, hist)
    assert sorted(map(tuple, made.collect())) == whole and len(whole) == 4
    pair = {(r.a, r.b): r for r in graph.pairwise(g, cand.join(hist, "user_id").select(F.col("source").alias("a"), F.col("item_id").alias("b"))).collect()}
    one = next(r for r in made.collect() if (r.user_id, r.item_id) == (7, 2))
    assert one.kg_same_genre_count_sum == pair[1, 2].same_genre_count + pair[3, 2].same_genre_count and one.kg_shared_actor_idf_sum == pytest.approx(pair[1, 2].shared_actor_idf + pair[3, 2].shared_actor_idf)


def test_frame_by_shares_of_users(spark, monkeypatch):
    vec = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0, 0.0])], "item_id bigint, vector array<double>")
    train = ix(spark, [(1, 1), (1, 50), (2, 1), (3, 2)])
    cand = spark.createDataFrame([(1, 2, 0.5), (2, 2, 0.25), (3, 1, 0.1), (3, 77, 0.0)], "user_id bigint, item_id bigint, cf_score double")
    meta = spark.createDataFrame([(1, 9), (2, 8)], "item_id bigint, vote_count bigint")
    kgf = cand.select("user_id", "item_id", F.lit(1).cast("bigint").alias("kg_x"))
    users, pos = spark.createDataFrame([(1, True), (2, False), (3, False)], "user_id bigint, is_val boolean"), spark.createDataFrame([(3, 1)], "user_id bigint, item_id bigint")
    make = lambda: sorted(map(tuple, features.frame(cand, train, meta, vec, kgf, users, {"label_val": pos.limit(0), "label_test": pos}).collect()))
    whole = make()
    monkeypatch.setattr(features, "PASS_ROWS", 1)
    assert make() == whole and [r[:6] for r in whole] == [(1, 2, 0.5, True, 0, 0), (2, 2, 0.25, False, 0, 0), (3, 1, 0.1, False, 0, 1), (3, 77, 0.0, False, 0, 0)]


def test_shared_entities_by_shares_of_users(spark, monkeypatch):
    monkeypatch.setattr(graph, "PASS_ROWS", 1)
    cand = spark.createDataFrame([(7, 2), (8, 2), (7, 3)], "user_id bigint, item_id bigint")
    hist = spark.createDataFrame([(7, 1), (7, 999)], "user_id bigint, source bigint")
    got = {(r.user_id, r.item_id): r for r in graph.shared_entities(kg(spark), cand, hist).collect()}
    assert set(got) == {(7, 2), (7, 3)} and got[7, 3].n_co_liked == 1
    two = got[7, 2]
    assert (two.n_history, two.n_actors, two.n_directors, two.n_genres, two.n_decade, two.n_co_liked) == (2, 1, 1, 1, 1, 0)


def test_frontiers_hold_64_roots_a_row(spark, monkeypatch):
    """A hub's items are reached once for each 64 roots, not once for each root."""
    rows = [(f"movie_{k}", "has_genre", "genre_g") for k in range(70)] + [("movie_0", "has_genre", "genre_h"), ("movie_99", "has_genre", "genre_h")]
    g = spark.createDataFrame(rows, "head string, relation string, tail string")
    made = []
    kept = graph.store
    monkeypatch.setattr(graph, "store", lambda df, name="table": made.append((name, kept(df, name))) or made[-1][1])
    cand = spark.createDataFrame([(k, 99) for k in range(1, 70)], "user_id bigint, item_id bigint")
    hist = cand.selectExpr("user_id", "user_id AS source")
    assert {(r.item_id, r.hops) for r in graph.user_path_lengths(g, cand, hist).collect()} == {(99, 4)}
    assert max(df.count() for name, df in made if name == "frontier") <= 73 * 2


def test_compensated_reads_cf_of_kg_users_only(spark):
    """Users without KG rows leave before the exchanges."""
    cf = spark.createDataFrame([(u, i, 1.0, i) for u in (1, 2) for i in (1, 2)], "user_id bigint, item_id bigint, score double, rank int")
    kg_rows = spark.createDataFrame([(1, 2, 0.9, 1), (1, 3, 0.8, 2)], "user_id bigint, item_id bigint, score double, rank int")
    out = recall.compensated_kg(cf, kg_rows)
    assert {(r.user_id, r.item_id) for r in out.collect()} == {(1, 2), (1, 3)}
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()


def test_user_paths_in_passes(spark, monkeypatch):
    """Links meet by user, a share of the users at a time: no pair of ends carries links."""
    g = kg(spark)
    cand = spark.createDataFrame([(1, 3), (1, 4), (2, 2)], "user_id bigint, item_id bigint")
    hist = spark.createDataFrame([(1, 1, 1), (2, 3, 1), (2, 1, 2), (2, 999, 3)], "user_id bigint, source bigint, age int")
    whole = sorted(map(str, graph.user_paths(g, cand, hist).collect()))
    monkeypatch.setattr(graph, "PATH_ROWS", 1)
    assert whole and sorted(map(str, graph.user_paths(g, cand, hist).collect())) == whole
    pairs = cand.join(hist, "user_id")
    assert sorted(map(str, graph.two_hop_paths(g, pairs).select("user_id", "item_id", "source", "rel1", "mid", "rel2", "n").collect())) == whole
