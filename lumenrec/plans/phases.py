"""The phases end to end, on tables in one folder, and their command line.

    python -m lumenrec.plans.phases --data DIR --out DIR --phase all

recommend: split, graph, routes, merge, labels, features, re-ranking, metrics.
explain:   paths, retrieval, evidence, generated texts (append-only, resumable).
evaluate:  faithfulness by condition and paired significance, as tables and Markdown.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrec.functions import metrics, stats
from lumenrec.functions import strings as S
from lumenrec.operators import explain, features, graph, prep, ranker, recall, text
from lumenrec.sources import fixtures as X
from lumenrec.sources import readers, sinks
from lumenrec.sources.workspace import store

PHASES = ("recommend", "explain", "evaluate")


def recommend(spark: SparkSession, data: str, out: str, co_liked: int = 2, rounds: int = 20) -> DataFrame:
    """Writes recommendations and metrics; returns (user_id, movie_id, rank, pred_score, label)."""
    train, vec, meta = X.train(spark, data), X.vectors(spark, data), X.metadata(spark, data)
    kg = store(graph.triples(meta, train, co_liked), "kg")
    merged = store(recall.merge_routes(recall.item_cf(train, 100), recall.vector_recall(train, vec, 50)), "merged")
    cand = merged.select("user_id", "item_id", "cf_score", F.col("kg_score").alias("kg_recall_score"))
    history = prep.last_n(train, 20).select("user_id", F.col("item_id").alias("source"))
    tables = [features.content_similarity(cand, train, vec), graph.user_candidate_features(kg, cand, history), features.embedding_features(cand, train, vec)]
    frame = store(features.assemble(cand, prep.popularity(train), meta, *tables), "frame")
    fit = store(recall.label(frame, X.part_of(spark, data, "val")).join(prep.user_hash_split(train), "user_id"), "fit")
    test = recall.label(frame, X.part_of(spark, data, "test"))
    names = features.resolve(features.FEATURE_SETS["V4"], frame.columns)
    scored = store(ranker.Pointwise(names, rounds).fit(fit).score(test), "scored")
    top = ranker.export_top(scored, 10)
    sinks.overwrite(top, f"{out}/recommendations")
    sinks.overwrite(ranker.evaluate(scored, [1, 5, 10]).unionByName(metrics.at_k(merged, X.part_of(spark, data, "test"), [10])), f"{out}/metrics")
    sinks.overwrite(kg, f"{out}/kg")
    return spark.read.parquet(f"{out}/recommendations")


def explain_top(spark: SparkSession, data: str, out: str, mode: str = "kg_only", top_k: int = 1, backend: explain.Backend | None = None) -> DataFrame:
    """Generates texts for the best recommendations; pairs that have one are skipped."""
    recs = readers.required(spark, f"{out}/recommendations").filter(F.col("rank") <= top_k)
    kg, train = readers.required(spark, f"{out}/kg"), X.train(spark, data)
    pairs = recs.select("user_id", F.col("movie_id").alias("item_id")).join(prep.last_n(train, 10).select("user_id", F.col("item_id").alias("source"), "age"), "user_id")
    titles = readers.parquet(spark, data, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("t"))
    paths = graph.two_hop_paths(kg, pairs, 3)
    named = (
        paths.join(titles.select(F.col("id").alias("source"), F.col("t").alias("st")), "source").join(titles.select(F.col("id").alias("item_id"), F.col("t").alias("tt")), "item_id")
        .join(titles.select(F.concat(F.lit("movie_"), "id").alias("mid"), F.col("t").alias("mt")), "mid", "left")
    )
    said = S.path_sentence(F.col("rel1"), F.col("mid"), F.col("rel2"), F.col("st"), F.col("mt"), F.col("tt"))
    texts = named.select("user_id", F.col("item_id").alias("movie_id"), "tt", "n", said.alias("s")).groupBy("user_id", "movie_id", F.col("tt").alias("movie_title"))
    rows = texts.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]).alias("texts"))
    used = explain.bundle(F.lit(None).cast(explain.EVIDENCE), explain.kg_evidence(F.col("texts"), F.col("movie_id")), mode)
    asked = rows.withColumn("evidence_used", used).join(prep.histories(train, 10), "user_id")
    shown = F.transform("history", lambda h: F.concat(F.lit("Movie "), h.cast("string")))
    ready = asked.select("user_id", "movie_id", "movie_title", F.lit(explain.mode(mode).table).alias("mode"), "evidence_used", F.lit(explain.RAG_SYSTEM).alias("system"), explain.rag_prompt(shown, F.col("movie_title"), F.col("evidence_used")).alias("prompt"))
    path = f"{out}/explanations_{explain.mode(mode).table}"
    done = readers.optional(spark, path)
    todo = ready if done is None else explain.pending(ready, done)
    explain.generate(todo, backend or explain.TemplateBackend()).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def evaluate(spark: SparkSession, out: str, mode: str = "kg_only") -> str:
    """Scores E1 to E4 of a mode's explanations; returns the Markdown report."""
    base = readers.required(spark, explain.reference_path(spark, out) or f"{out}/explanations_{explain.mode(mode).table}")
    records = base.select("user_id", "movie_id", "explanation", "evidence_used").withColumn("reference_evidence", F.col("evidence_used"))
    backend, parts = explain.TemplateBackend(), None
    for condition in ("E1", "E2", "E3", "E4"):
        changed = explain.perturb(records, condition, mode).drop("explanation")
        prompt = explain.rag_prompt(F.array().cast("array<string>"), F.col("movie_id").cast("string"), F.col("evidence_used"))
        made = explain.generate(changed.withColumn("system", F.lit(explain.RAG_SYSTEM)).withColumn("prompt", prompt), backend).withColumn("condition", F.lit(condition))
        parts = made if parts is None else parts.unionByName(made)

    def slim(c: str):
        return F.transform(c, lambda e: F.struct(e["doc_id"].alias("doc_id"), e["text"].alias("text")))

    rows = parts.select("user_id", "movie_id", "condition", "explanation", slim("reference_evidence").alias("reference_evidence"), slim("evidence_used").alias("evidence_used"))
    detailed = store(text.evaluate(rows), "detailed")
    summary = text.summarise(detailed)
    sinks.faithfulness(detailed, summary, {"mode": mode}, f"{out}/faithfulness")
    long = detailed.select(F.col("condition").alias("label"), "user_id", "movie_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in stats.METRICS])).alias("m")).select("label", "user_id", "movie_id", "m.*")
    table = stats.comparison_matrix(long, [("E1", "E2"), ("E1", "E3"), ("E1", "E4")]).orderBy("metric", "right_label")
    rows_ = [r.asDict() | {"p_value": stats.t_p_value(r.t_statistic, r.pair_count)} for r in table.collect()]  # twelve rows
    report = sinks.markdown(rows_, ["left_label", "right_label", "metric", "pair_count", "left_mean", "right_mean", "mean_difference", "t_statistic", "p_value"])
    sinks.metrics_json(spark, {"report": report}, f"{out}/report")
    return report


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--data", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--phase", default="all", choices=("all", *PHASES))
    p.add_argument("--mode", default="kg_only", choices=sorted(explain.MODES))
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.phase in ("all", "recommend"):
        recommend(spark, a.data, a.out)
    if a.phase in ("all", "explain"):
        explain_top(spark, a.data, a.out, a.mode)
    if a.phase in ("all", "evaluate"):
        print(evaluate(spark, a.out, a.mode))


if __name__ == "__main__":
    main()
