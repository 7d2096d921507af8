import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrec.functions import stats
from lumenrec.functions import strings as S
from lumenrec.operators import explain, text
from lumenrec.plans import catalogue
from lumenrec.sources import sinks
from lumenrec.streaming import resume


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sentences(spark):
    say = lambda t: one(spark, S.sentences(F.lit(t)))
    assert say("Hello world. Ok! This is a longer sentence here.") == ["Hello world. Ok!", "This is a longer sentence here."]
    assert say("") == [] and say("  \n ") == [] and say("Short.") == ["Short."]


def test_overlap_and_rouge(spark):
    x, ev = F.lit("The movie stars Tom Hanks"), F.array(F.lit("Tom Hanks stars in it"))
    assert one(spark, text.overlap(x, ev)) == pytest.approx(3 / 4)
    assert one(spark, text.rouge_l(x, ev)) == pytest.approx(0.4)
    assert one(spark, text.overlap(F.lit("the a is"), ev)) == 0 and one(spark, text.rouge_l(F.lit(""), ev)) == 0


def test_lcs_equals_dynamic_programme():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (list(map(str, rng.integers(0, 5, rng.integers(0, 30)))) for _ in range(2))
        dp = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                dp[i + 1, j + 1] = dp[i, j] + 1 if a[i] == b[j] else max(dp[i, j + 1], dp[i + 1, j])
        assert text.lcs_length(a, b) == dp[-1, -1]


def test_bm25_against_plain_python(spark):
    import math

    docs = [(0, "the cat sat"), (1, "the dog sat on the mat"), (2, "a cat and a dog"), (3, ""), (4, "the the the")]
    got = {(r.q, r.doc_id): r.score for r in text.bm25(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(7, "cat cat the"), (8, "none")], "q bigint, text string")).collect()}
    toks = {i: t.split() for i, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {w: sum(w in t for t in toks.values()) for t in toks.values() for w in t}
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    for i, t in toks.items():
        s = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in "cat cat the".split())
        assert got.get((7, i), 0.0) == pytest.approx(s)
    assert not [k for k in got if k[0] == 8]


def test_hybrid_dedupes_text_and_includes_extra(spark):
    docs = spark.createDataFrame([(0, "blue sky"), (1, "blue sky"), (2, "red sun"), (3, "green hill")], "doc_id bigint, text string")
    vec = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "doc_id bigint, vector array<double>")
    ask = spark.createDataFrame([(1, "blue sky", [1.0, 0.0])], "q bigint, text string, vector array<double>")
    got = [(r.doc_id, r.score) for r in text.hybrid(docs, ask, vec, top_k=2).orderBy("rank").collect()]
    assert got == [(0, 0.6), (3, 0.36)]  # both words are in half of the documents: idf 0
    extra = spark.createDataFrame([(1, 2)], "q bigint, doc_id bigint")
    assert 2 in [r.doc_id for r in text.hybrid(docs, ask, vec, extra, top_k=3).collect()]


def test_corpus(spark):
    meta = spark.createDataFrame([(1, "T", "Long first sentence here. Ok!", "Tag line", ["A", "B"], ["x"], ["d"]), (2, "U", None, "ab", [], [], ["d"]), (3, "V", None, None, None, ["x", "y"], None)], "movie_id bigint, title string, overview string, tagline string, genres array<string>, actors array<string>, directors array<string>")
    got = {(r.movie_id, r.source): r.text for r in text.metadata_chunks(meta).collect()}
    assert got == {(1, "overview"): "T: Long first sentence here. Ok!", (1, "tagline"): 'T — "Tag line"', (1, "genre"): "T is a A, B film.", (1, "cast"): "T stars x, directed by d.", (2, "cast"): "U is directed by d.", (3, "cast"): "V stars x, y."}
    both = text.metadata_chunks(meta).unionByName(text.metadata_chunks(meta))
    assert sorted(r.doc_id for r in text.build_corpus(both, ["movie_id", "ord"]).collect()) == list(range(6))


EV = "array<struct<doc_id:bigint,text:string>>"


def test_canonical_evidence(spark):
    rows = [(1, [(5, " b "), (None, "z"), (2, "a"), (9, " ")], [(1, "used")]), (2, [], [(None, "y"), (None, "x")]), (3, None, None)]
    df = spark.createDataFrame(rows, f"i int, r {EV}, u {EV}")
    got = {r.i: r.x for r in df.select("i", text.canonical_evidence(F.col("r"), F.col("u")).alias("x")).collect()}
    assert got == {1: ["a", "b", "z"], 2: ["y", "x"], 3: [""]}


def item(k, score=0.0, movie=1):
    return (k, movie, f"text {k}", "s", 0.0, 0.0, score)


def records(spark, rows):
    return spark.createDataFrame(rows, f"user_id bigint, movie_id bigint, evidence_used {explain.EVIDENCE}")


@pytest.mark.parametrize("n,kept", [(1, 0), (3, 2), (5, 3), (0, 0)])
def test_e2_drops_the_best(spark, n, kept):
    df = records(spark, [(1, 2, [item(k, k / 10) for k in range(n)])])
    out = explain.perturb(df, "E2", "hybrid").first().evidence_used
    assert [e.doc_id for e in out] == list(range(kept))


def test_e1_e3_e4(spark):
    df = records(spark, [(u, u, [item(10 * u + k, movie=u) for k in range(4)]) for u in range(1, 8)])
    assert explain.perturb(df, "E1", "hybrid").collect() == df.collect()
    a, b = ({r.user_id: [e.doc_id for e in r.evidence_used] for r in explain.perturb(df.repartition(n), "E3", "hybrid").collect()} for n in (1, 5))
    assert a == b and all(sorted(v) == [10 * u + k for k in range(4)] for u, v in a.items()) and any(v != sorted(v) for v in a.values())
    corpus = spark.createDataFrame([(k, k % 9, f"c{k}", "s") for k in range(500)], "doc_id bigint, movie_id bigint, text string, source string")
    for r in explain.perturb(df, "E4", "retrieval_only", corpus).collect():
        assert len(r.evidence_used) == 4 and all(e.movie_id != r.movie_id and e.score == 0 for e in r.evidence_used)
    for r in explain.perturb(df, "E4", "kg_only").collect():
        assert all(e.movie_id != r.movie_id for e in r.evidence_used)
    lone = spark.createDataFrame([(k, 3 if k < 197 else 5, f"c{k}", "s") for k in range(200)], "doc_id bigint, movie_id bigint, text string, source string")
    got = {r.user_id: [e.doc_id for e in r.evidence_used] for r in explain.perturb(df, "E4", "retrieval_only", lone).collect()}
    assert all(len(set(v)) == 4 for u, v in got.items() if u != 3) and sorted(got[3]) == [197, 198, 199]  # found although rare
    none = explain.perturb(df, "E4", "retrieval_only", lone.limit(0))
    assert [len(r.evidence_used) for r in none.collect()] == [0] * 7
    for bad in (("E9", "hybrid"), ("E1", "other"), ("E4", "hybrid")):
        with pytest.raises(ValueError):
            explain.perturb(df, *bad)


@pytest.mark.parametrize("mode,want", [("hybrid", ["k", "t"]), ("kg_only", ["k"]), ("retrieval_only", ["t"])])
def test_bundle_order(spark, mode, want):
    kg = explain.kg_evidence(F.array(F.lit("k"), F.lit("")), F.lit(3))
    got = F.array(F.struct(F.lit(1).cast("bigint").alias("doc_id"), F.lit(3).cast("bigint").alias("movie_id"), F.lit("t").alias("text"), F.lit("o").alias("source"), *[F.lit(0.5).alias(c) for c in ("dense_score", "bm25_score", "score")]))
    assert [e.text for e in one(spark, explain.bundle(got, kg, mode))] == want
    with pytest.raises(ValueError):
        explain.bundle(got, kg, "nothing")


def test_modes_and_reference_files(spark, tmp_path):
    assert [explain.mode(m).table for m in ("hybrid", "kg_only", "retrieval_only")] == ["rag", "kg_only", "retrieval_only"]
    df = spark.createDataFrame([(1,)], "user_id bigint")
    d = str(tmp_path)
    assert explain.reference_path(spark, d) is None
    for m in ("prompt_only", "retrieval_only", "kg_only"):
        sinks.overwrite(df, f"{d}/explanations_{m}")
    assert explain.reference_path(spark, d).endswith("kg_only")
    assert [m for m, _ in explain.explanation_tables(spark, d)] == ["kg_only", "retrieval_only", "prompt_only"]


def test_kg_only_filter(spark):
    recs = spark.createDataFrame([(1, 2), (1, 3)], "user_id bigint, movie_id bigint")
    kept, skipped = explain.explainable(recs, recs.limit(1), "kg_only")
    assert kept.count() == 1 and skipped == 1
    assert explain.explainable(recs, recs.limit(0), "hybrid")[1] == 0
    for paths in (recs.limit(0), recs.selectExpr("user_id + 5 AS user_id", "movie_id")):
        with pytest.raises(ValueError):
            explain.explainable(recs, paths, "kg_only")


def test_path_sentences(spark):
    say = lambda a, m, b, mt="Mid": one(spark, S.path_sentence(F.lit(a), F.lit(m).cast("string"), F.lit(b).cast("string"), F.lit("S"), F.lit(mt), F.lit("T")))
    assert say("has_genre", "genre_Drama", "has_genre") == "'S' and 'T' both belong to the Drama genre."
    assert say("co_liked", "movie_5", "co_liked") == "Users who watched 'S' also frequently watched 'Mid', and fans of 'Mid' often enjoy 'T' as well."
    assert say("acted_by", "actor_X", "acted_by") == "'S' connects to 'T' via acted by → actor_X → acted by."
    assert say("co_liked", None, None) == "'S' connects to 'T' via co liked."


def test_prompts_generate_and_resume(spark, tmp_path):
    ev = F.array(F.struct(F.lit("First fact.").alias("text")), F.struct(F.lit("Second.").alias("text")))
    df = spark.createDataFrame([(1, 2), (1, 3)], "user_id bigint, movie_id bigint").withColumn("system", F.lit(explain.RAG_SYSTEM))
    df = df.withColumn("prompt", explain.rag_prompt(F.array(F.lit("Old")), F.lit("New"), ev))
    assert "(1) First fact.\n(2) Second." in df.first().prompt and '"Old"' in df.first().prompt
    out = explain.generate(df, explain.TemplateBackend()).collect()
    assert len(out) == 2 and "First fact." in out[0].explanation
    plain = one(spark, explain.plain_prompt(F.array(F.lit("Old")), F.lit("New"), F.array(F.lit("A"), F.lit("B"))))
    assert "New (A, B)" in plain and "passages" not in plain
    src, res, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    df.limit(1).write.parquet(src)
    for _ in range(2):
        resume.run(spark, src, df.schema, res, ck, explain.TemplateBackend()).awaitTermination()
    assert spark.read.parquet(res).count() == 1
    df.write.mode("append").parquet(src)  # repeats the first pair: it is skipped
    resume.run(spark, src, df.schema, res, ck, explain.TemplateBackend()).awaitTermination()
    assert spark.read.parquet(res).count() == 2
    assert explain.pending(df, spark.read.parquet(res)).count() == 0


def test_significance(spark):
    left = spark.createDataFrame([(1, 1, 0.1, 0), (1, 1, 0.5, 1), (2, 1, 0.6, 0), (3, 1, 0.9, 0)], "user_id bigint, movie_id bigint, m double, seq int")
    right = spark.createDataFrame([(1, 1, 0.4, 0), (2, 1, 0.4, 0), (4, 1, 0.9, 0)], "user_id bigint, movie_id bigint, m double, seq int")
    got = {r.user_id: (r.left_value, r.right_value) for r in stats.align(left, right, "m").collect()}
    assert got == {1: (0.5, 0.4), 2: (0.6, 0.4)}
    d = spark.createDataFrame([(k, 1, v, 0.0) for k, v in enumerate((0.1, 0.2, 0.3, 0.4))], "user_id bigint, movie_id bigint, left_value double, right_value double")
    t = stats.paired_t(d).first()
    assert t.mean_difference == pytest.approx(0.25) and t.t_statistic == pytest.approx(3.872983, abs=1e-6)
    assert stats.t_p_value(3.872983, 4) == pytest.approx(0.030466, abs=1e-5) and stats.t_p_value(0.0, 10) == pytest.approx(1.0)
    lo, hi = stats.bootstrap_ci(np.array([0.1, 0.2, 0.3, 0.4]), 500, 7)
    assert lo <= 0.25 <= hi and (lo, hi) == stats.bootstrap_ci(np.array([0.1, 0.2, 0.3, 0.4]), 500, 7)
    row = stats.significance_row(d, "a", "b", "m")
    assert row["ci_low"] <= 0.25 <= row["ci_high"] and row["pair_count"] == 4
    assert "| a" in sinks.markdown([row], ["left_label", "right_label", "metric", "mean_difference"])


def test_bertscore(spark):
    assert text.bertscore_settings(True) == ("models/roberta-large", {"model_type": "models/roberta-large", "num_layers": 17, "lang": None, "rescale_with_baseline": False})
    assert text.bertscore_settings(False)[1]["rescale_with_baseline"] is True and text.bertscore_settings(False, rescale=False)[1]["rescale_with_baseline"] is False
    v = text.hashed_token_vectors(["alpha", "beta"])
    assert text.greedy_match_f1(v, v) == pytest.approx(1.0) and text.greedy_match_f1(v, v[:0]) == 0.0
    ev = [(1, "same words")]
    df = spark.createDataFrame([(1, 2, "rag", "same words", ev, ev), (1, 3, "rag", "", ev, None)], f"user_id bigint, movie_id bigint, condition string, explanation string, reference_evidence {EV}, evidence_used {EV}")
    out = {r.movie_id: r for r in text.evaluate(df).collect()}
    assert (out[2].evidence_overlap, out[2].rouge_l, out[2].semantic_sim, out[2].bert_score_f1) == (1.0, 1.0, 1.0, 1.0) and out[3].rouge_l == 0
    assert text.summarise(text.evaluate(df)).first().rouge_l == 0.5


def test_evidence_is_whole_text(spark):
    """No registered query cuts the turns or documents it takes as evidence."""
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    want = {r.conv_id: r.t for r in spark.read.parquet(f"{data}/conversations.parquet").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda e: e["text"]), "|").alias("t")).collect()}
    got = {r.user_id: r.retrieval_only for r in catalogue.evidence_bundle(spark, data).collect()}
    assert got == want
    texts = {r.text.strip() for r in spark.read.parquet(f"{data}/conversations.parquet").filter("text IS NOT NULL").collect()}
    assert all(e in texts or e == "" for r in catalogue.canonical_evidence(spark, data).collect() for e in r.evidence)
