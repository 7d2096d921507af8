"""Evidence bundles, prompts, generation, perturbations, resuming."""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrec.functions.strings import seeded
from lumenrec.operators import prep
from lumenrec.sources.readers import exists
from lumenrec.sources.workspace import store

EVIDENCE = "array<struct<doc_id:bigint,movie_id:bigint,text:string,source:string,dense_score:double,bm25_score:double,score:double>>"

RAG_SYSTEM = "Explain in two to four sentences why the movie suits this user. Use only the numbered passages, name the details that you rely on, and tie them to what the user likes."
PROMPT_SYSTEM = "Explain in two to four sentences why the movie suits this user. Be specific about what matches the user's taste."


@dataclass(frozen=True)
class EvidenceMode:
    """Where a mode's explanations are kept, and which kinds of evidence it takes, in order."""

    table: str
    takes: tuple[str, ...]


#: The modes' names, their tables' names, and the order of their evidence.
MODES = {
    "hybrid": EvidenceMode("rag", ("graph", "retrieved")),
    "kg_only": EvidenceMode("kg_only", ("graph",)),
    "retrieval_only": EvidenceMode("retrieval_only", ("retrieved",)),
}
#: Tables by strength of evidence; the last one has none of its own.
TABLES = ("rag", "kg_only", "retrieval_only", "prompt_only")


def mode(name: str) -> EvidenceMode:
    try:
        return MODES[name]
    except KeyError:
        raise ValueError(f"{name!r} is no evidence mode; choose from {', '.join(MODES)}") from None


def explanation_tables(spark: SparkSession, directory: str) -> list[tuple[str, str]]:
    """(table, path) of the explanation tables that exist, strongest evidence first."""
    paths = ((t, f"{directory}/explanations_{t}") for t in TABLES)
    return [(t, p) for t, p in paths if exists(spark, p)]


def reference_path(spark: SparkSession, directory: str) -> str | None:
    """The explanation table with the strongest evidence of its own, if there is any."""
    backed = [p for t, p in explanation_tables(spark, directory) if t != TABLES[-1]]
    return backed[0] if backed else None


def kg_evidence(texts: Column, movie_id: Column, most: int = 3) -> Column:
    """Up to ``most`` non-blank path sentences as evidence items with score 1 and doc_id -1."""
    kept = F.filter(F.slice(texts, 1, most), lambda t: t != "")
    one = F.lit(1.0)
    return F.transform(
        kept,
        lambda t: F.struct(
            F.lit(-1).cast("bigint").alias("doc_id"), movie_id.cast("bigint").alias("movie_id"), t.alias("text"), F.lit("kg_path").alias("source"),
            one.alias("dense_score"), one.alias("bm25_score"), one.alias("score"),
        ),
    )


def bundle(retrieved: Column, graph: Column, name: str) -> Column:
    """The evidence that a mode takes, in the mode's order; a missing kind is empty."""
    given = {"graph": graph, "retrieved": retrieved}
    return F.concat(*[F.coalesce(given[kind], F.array().cast(EVIDENCE)) for kind in mode(name).takes])


def explainable(recommendations: DataFrame, paths: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(pairs that the mode has evidence for, number of pairs left out).

    A mode that lives on graph evidence alone needs a path for each pair; no pair
    with a path at all is an error.
    """
    if mode(name).takes != ("graph",):
        return recommendations, 0
    told = paths.select("user_id", "movie_id").distinct().withColumn("told", F.lit(1))
    marked = store(recommendations.join(told, ["user_id", "movie_id"], "left"), "marked")
    kept, n = marked.agg(F.count("told"), F.count(F.lit(1))).first()
    if not kept:
        raise ValueError(f"mode {name} needs a graph path for some recommended pair, and there is none")
    return marked.filter("told = 1").drop("told"), n - kept


def with_reference(records: DataFrame, reference: DataFrame) -> DataFrame:
    """reference_evidence: the record's own, else the reference table's, else evidence_used."""
    ref = reference.select("user_id", "movie_id", F.col("evidence_used").alias("__ref"))

    def filled(c: str) -> Column:
        return F.when(F.size(c) > 0, F.col(c))

    joined = records.join(ref, ["user_id", "movie_id"], "left")
    return joined.withColumn("reference_evidence", F.coalesce(filled("reference_evidence"), filled("__ref"), F.col("evidence_used"))).drop("__ref")


# ---------------------------------------------------------------- perturbations


def remove_key(evidence: Column, share: float = 0.5) -> Column:
    """E2: drops the max(1, int(n * share)) items of highest score; order by score, ascending, stays."""
    n = F.size(evidence)
    by_score = F.transform(F.array_sort(F.transform(evidence, lambda e, i: F.struct(e["score"].alias("s"), (-i).alias("i"), e.alias("e")))), lambda x: x["e"])
    keep = F.greatest(n - F.greatest(F.lit(1), F.floor(n * F.lit(share)).cast("int")), F.lit(0))
    return F.when(n > 0, F.slice(by_score, 1, keep)).otherwise(evidence)


def shuffled(evidence: Column, key: Column, seed: int = 42) -> Column:
    """E3: an order by seeded hash of key and place, the same on every run and partitioning."""
    keyed = F.transform(evidence, lambda e, i: F.struct(seeded(key, i, seed=seed).alias("h"), i.alias("i"), e.alias("e")))
    return F.transform(
        F.array_sort(keyed, lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).when(a["i"] < b["i"], -1).otherwise(1)), lambda x: x["e"]
    )


def replace_text(records: DataFrame, corpus: DataFrame, seed: int = 42) -> DataFrame:
    """E4 for texts: as many documents of other movies as there was evidence (one at least), scores 0.

    The corpus stands in a seeded order; a record starts at a place of its own and
    takes the next documents of other movies, from the end on to the beginning.
    Records that lack some look on over twice the stretch, so each gets its number
    unless the corpus has fewer.  ``records`` are told apart by (user_id, movie_id).
    """
    keyed = corpus.select("doc_id", F.col("movie_id").alias("m"), "text", "source", seeded("doc_id", seed=seed).alias("h"))
    docs = store(prep.global_rank(keyed, ["h", "doc_id"], "place"), "corpus").select((F.col("place") - 1).alias("place"), "doc_id", "m", "text", "source")
    n = docs.count()
    want = F.greatest(F.size("evidence_used"), F.lit(1))
    start = F.pmod(seeded("user_id", "movie_id", seed=seed), F.lit(max(n, 1)))
    open_ = store(records.select("user_id", "movie_id", want.alias("want"), start.alias("start")).distinct(), "open")
    found, done, width = None, 0, 2
    while n and not open_.isEmpty():
        reach = F.least(F.col("want") * width + 8, F.lit(n)).cast("bigint")
        steps = open_.select("user_id", "movie_id", "want", F.explode(F.sequence(F.lit(0).cast("bigint"), reach - 1)).alias("step"), "start")
        drawn = steps.withColumn("place", F.pmod(F.col("start") + F.col("step"), F.lit(n))).join(docs.select("place", "m", "doc_id"), "place")
        other = drawn.filter(F.col("m").isNull() | ~F.col("m").eqNullSafe(F.col("movie_id")))
        got = other.groupBy("user_id", "movie_id", "want").agg(F.array_sort(F.collect_list(F.struct("step", "place"))).alias("drawn"))
        got = store(got.select("user_id", "movie_id", "want", F.slice("drawn", 1, F.col("want")).alias("drawn")), "drawn")
        enough = got if width > n else got.filter(F.size("drawn") >= F.col("want"))
        found = enough if found is None else found.unionByName(enough)
        if width > n:
            break
        open_ = store(open_.join(enough.select("user_id", "movie_id"), ["user_id", "movie_id"], "left_anti"), "open")
        width *= 4
    zero, none = F.lit(0.0), F.array().cast(EVIDENCE)
    if found is None:
        return records.withColumn("evidence_used", none)
    one = F.struct("doc_id", F.col("m").alias("movie_id"), "text", "source", zero.alias("dense_score"), zero.alias("bm25_score"), zero.alias("score"))
    rows = found.select("user_id", "movie_id", F.explode("drawn").alias("d")).select("user_id", "movie_id", "d.step", "d.place").join(docs, "place")
    made = rows.select("user_id", "movie_id", F.struct("step", one.alias("e")).alias("x")).groupBy("user_id", "movie_id").agg(
        F.transform(F.array_sort(F.collect_list("x"), lambda a, b: F.when(a["step"] < b["step"], -1).when(a["step"] > b["step"], 1).otherwise(0)), lambda x: x["e"]).alias("made")
    )
    joined = records.join(made, ["user_id", "movie_id"], "left").withColumn("evidence_used", F.coalesce(F.col("made").cast(EVIDENCE), none))
    return joined.select(records.columns)


def replace_kg(records: DataFrame, seed: int = 42) -> DataFrame:
    """E4 for graph evidence: distinct texts from other pairs of other movies."""
    pool = records.select("movie_id", F.explode("evidence_used").alias("e")).select(F.col("e.doc_id").alias("doc_id"), "movie_id", F.col("e.text").alias("text"), F.col("e.source").alias("source"))
    distinct = pool.filter("text <> ''").groupBy("text").agg(F.min(F.struct("movie_id", "doc_id", "source")).alias("b"))
    corpus = distinct.select(F.xxhash64("text").alias("doc_id"), F.col("b.movie_id").alias("movie_id"), "text", F.col("b.source").alias("source"))
    return replace_text(records, corpus, seed)


def perturb(records: DataFrame, condition: str, evidence_mode: str, corpus: DataFrame | None = None) -> DataFrame:
    """E1 leaves, E2 removes key items, E3 shuffles, E4 replaces the column ``evidence_used``."""
    mode(evidence_mode)  # must exist
    if condition == "E1":
        return records
    if condition == "E2":
        return records.withColumn("evidence_used", remove_key(F.col("evidence_used")))
    if condition == "E3":
        return records.withColumn("evidence_used", shuffled(F.col("evidence_used"), F.concat_ws("_", "user_id", "movie_id")))
    if condition != "E4":
        raise ValueError(f"{condition!r} is none of the conditions E1 to E4")
    if evidence_mode == "kg_only":
        return replace_kg(records)
    if corpus is None:
        raise ValueError(f"E4 in mode {evidence_mode} draws from a corpus, which is missing")
    return replace_text(records, corpus)


# ---------------------------------------------------------------- generation


def _liked(titles: Column, most: int = 10) -> Column:
    return F.concat(F.lit("This user likes: "), F.array_join(F.transform(F.slice(titles, 1, most), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), "; "), F.lit("."))


def _passages(evidence: Column) -> Column:
    return F.array_join(F.transform(evidence, lambda e, i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") "), e["text"])), "\n")


TITLE_LINE = "Movie in question: "


def rag_prompt(titles: Column, title: Column, evidence: Column) -> Column:
    """Passages first, then the movie, then the user's taste and the request."""
    return F.concat(
        F.lit("Numbered passages:\n"), _passages(evidence), F.lit(f"\n\n{TITLE_LINE}"), title, F.lit("\n"), _liked(titles),
        F.lit("\nSay why the movie fits, by passages alone; cite them as (1), (2) and so on."),
    )


def plain_prompt(titles: Column, title: Column, genres: Column) -> Column:
    """The movie with its genres, then the user's taste and the request; no passages."""
    return F.concat(F.lit(TITLE_LINE), title, F.lit(" ("), F.array_join(genres, ", "), F.lit(")\n"), _liked(titles), F.lit("\nSay why the movie fits."))


class Backend(ABC):
    """Anything that turns a system and a user text into an answer; it must pickle."""

    @abstractmethod
    def generate(self, system: str, user: str, max_new_tokens: int = 256) -> str: ...


class TemplateBackend(Backend):
    """Deterministic: restates the first passages of the prompt, or the title without any."""

    def generate(self, system: str, user: str, max_new_tokens: int = 256) -> str:
        lines = user.split("\n")
        cited = [x.split(") ", 1)[1] for x in lines if re.match(r"\(\d+\) ", x)][:2]
        title = next((x.removeprefix(TITLE_LINE) for x in lines if x.startswith(TITLE_LINE)), "")
        body = f"{title} suits this user. " + (f"As noted: {' '.join(cited)}" if cited else "It matches what this user likes.")
        return " ".join(body.split()[:max_new_tokens])


class HttpBackend(Backend):
    """A chat-completions endpoint; failures give an empty text, which callers retry on the next run."""

    def __init__(self, url: str, model: str, key: str = "", timeout: float = 60.0):
        self.url, self.model, self.key, self.timeout = url, model, key, timeout

    def generate(self, system: str, user: str, max_new_tokens: int = 256) -> str:
        import json
        import urllib.request

        body = {"model": self.model, "max_tokens": max_new_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        request = urllib.request.Request(f"{self.url}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.load(answer)["choices"][0]["message"]["content"]
        except OSError:
            return ""


def generate(requests: DataFrame, backend: Backend, threads: int = 8) -> DataFrame:
    """Adds ``explanation`` to rows with ``system`` and ``prompt``; blank answers are dropped, so that a rerun retries them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(threads) as pool:
            for f in frames:
                said = list(pool.map(backend.generate, f["system"], f["prompt"]))
                out = f.assign(explanation=said)
                yield out[out["explanation"] != ""]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", explanation string"
    return requests.mapInPandas(run, schema)


def pending(requests: DataFrame, done: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Requests without a stored result."""
    keys = keys or ["user_id", "movie_id"]
    return requests.join(done.select(*keys).distinct(), keys, "left_anti")
