"""Evidence corpus, sparse and dense retrieval, faithfulness measures."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenrec.functions import strings as S
from lumenrec.functions import vectors as V
from lumenrec.operators import prep
from lumenrec.sources.workspace import store


def sentence_chunks(docs: DataFrame) -> DataFrame:
    """(source_id, pos, text): merged sentences of ``text``."""
    return docs.select("source_id", F.posexplode(S.sentences(F.col("text"))).alias("pos", "text"))


def metadata_chunks(meta: DataFrame) -> DataFrame:
    """(movie_id, ord, text, source) of (movie_id, title, overview, tagline, genres[], actors[], directors[])."""
    title = F.coalesce("title", F.concat(F.lit("Movie "), F.col("movie_id").cast("string")))

    def has(c: str) -> Column:
        return F.coalesce(F.size(c), F.lit(0)) > 0

    def listed(c: str) -> Column:
        return F.array_join(c, ", ")

    over = meta.select("movie_id", F.posexplode(S.sentences(F.coalesce("overview", F.lit("")))).alias("p", "s"), title.alias("t"))
    def said(form: str, *columns) -> Column:
        return F.format_string(form, title, *columns)

    def chunk(rows: DataFrame, place: int, sentence: Column, source: str) -> DataFrame:
        return rows.select("movie_id", F.lit(place).alias("ord"), sentence.alias("text"), F.lit(source).alias("source"))

    cast, lead = listed("actors"), listed("directors")
    people = F.when(has("actors") & has("directors"), said(S.CHUNK_CAST_DIRECTOR, cast, lead)).when(has("actors"), said(S.CHUNK_CAST, cast)).otherwise(said(S.CHUNK_DIRECTOR, lead))
    parts = [
        over.select("movie_id", (F.col("p") + 0).alias("ord"), F.format_string(S.CHUNK_OVERVIEW, "t", "s").alias("text"), F.lit("overview").alias("source")),
        chunk(meta.filter(F.length(F.trim("tagline")) > 3), 100_000, said(S.CHUNK_TAGLINE, F.trim("tagline")), "tagline"),
        chunk(meta.filter(has("genres")), 100_001, said(S.CHUNK_GENRE, listed("genres")), "genre"),
        chunk(meta.filter(has("actors") | has("directors")), 100_002, people, "cast"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_by_text(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Of equal texts the first in ``order``; one aggregate, no window over a hot text."""
    rest = [c for c in chunks.columns if c != "text"]
    best = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("b")
    return chunks.groupBy("text").agg(best).select("text", *[F.col(f"b.{c}").alias(c) for c in rest])


def build_corpus(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Distinct texts with ``doc_id`` from 0 in the given order."""
    ranked = prep.global_rank(first_by_text(chunks, order), order, "r")
    return ranked.withColumn("doc_id", F.col("r") - 1).drop("r")


# ---------------------------------------------------------------- retrieval

K1, B, EPSILON = 1.5, 0.75, 0.25


#: Rows (query, word) that may be broadcast to the postings.
BROADCAST_WORDS = 1_000_000


def bm25(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, doc_id, score): Okapi scores of documents that share a query word.

    Repeated query words add up.  Negative idf becomes epsilon times the mean idf.
    Word statistics cover the corpus.  The queries' words go to the postings where
    there are no more than BROADCAST_WORDS (counted), so a frequent word's postings
    stay spread; beyond that both sides are shuffled by word and a part of the
    document's hash, which splits a frequent word 32 ways.
    """
    split = corpus.select("doc_id", S.tokens(F.col("text")).alias("t"))
    words = split.select("doc_id", F.size("t").alias("len"), F.explode("t").alias("w"))
    tf = store(words.groupBy("doc_id", "len", "w").agg(F.count(F.lit(1)).alias("tf")), "postings")  # texts are split once
    stats = tf.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words")).join(corpus.agg(F.count(F.lit(1)).alias("n")))
    stats = stats.select("n", F.try_divide("words", "n").alias("avgdl"))
    idf = tf.groupBy("w").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(stats)).select("w", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"), "avgdl")
    mean = idf.agg(F.avg("raw").alias("mean_idf"))
    asked = queries.select("q", F.explode(S.tokens(F.col("text"))).alias("w")).groupBy("q", "w").agg(F.count(F.lit(1)).alias("qn"))
    weight = asked.join(idf, "w").join(F.broadcast(mean)).select("q", "w", "qn", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    weight = store(weight, "weights")
    if weight.count() <= BROADCAST_WORDS:
        hits = tf.join(F.broadcast(weight), "w")
    else:
        parts = weight.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(31))))
        hits = tf.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(32)).cast("int")).join(parts, ["w", "part"])
    part = F.col("qn") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    return hits.groupBy("q", "doc_id").agg(F.sum(part).alias("score"))


def top_docs(scores: DataFrame, k: int, digits: int = 6) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc(F.round("score", digits)), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hybrid(corpus: DataFrame, queries: DataFrame, doc_vectors: DataFrame, extra: DataFrame | None = None, top_k: int = 8, alpha: float = 0.6) -> DataFrame:
    """(q, doc_id, text, dense_score, bm25_score, score, rank).

    ``queries`` (q, text, vector or null), ``doc_vectors`` (doc_id, vector), ``extra``
    (q, doc_id): documents of the candidate and of the history.  Both routes give
    5 top_k documents; each candidate's score is exact in both; scores are rounded
    to 4 digits before sorting; of equal texts the best stays.
    """
    fetch = 5 * top_k
    units = doc_vectors.select("doc_id", V.unit(F.col("vector")).alias("dv"))
    asked = queries.select("q", V.unit(F.col("vector")).alias("qv"))
    items = units.select(F.col("doc_id").alias("item_id"), F.col("dv").alias("vector"))
    dense = V.top_inner_products(asked.filter("qv IS NOT NULL").select("q", F.col("qv").alias("vector")), items, fetch).select("q", F.col("item_id").alias("doc_id"))
    raw = bm25(corpus, queries.select("q", "text"))
    top = raw.groupBy("q").agg(F.max("score").alias("m"))
    sparse = raw.join(top, "q").select("q", "doc_id", (F.col("score") / F.when(F.col("m") > 0, F.col("m")).otherwise(F.lit(1.0))).alias("score"))
    found = dense.unionByName(top_docs(sparse.filter("score > 0"), fetch).select("q", "doc_id"))
    if extra is not None:
        found = found.unionByName(extra.select("q", "doc_id"))
    rows = found.distinct().join(units, "doc_id", "left").join(asked, "q").join(sparse.withColumnRenamed("score", "s"), ["q", "doc_id"], "left").join(corpus.select("doc_id", "text"), "doc_id")
    d, s = F.coalesce(V.dot(F.col("qv"), F.col("dv")), F.lit(0.0)), F.coalesce("s", F.lit(0.0))
    scored = rows.select("q", "doc_id", "text", F.round(d, 4).alias("dense_score"), F.round(s, 4).alias("bm25_score"), F.round(alpha * d + (1 - alpha) * s, 4).alias("score"))
    best = Window.partitionBy("q", "text").orderBy(F.desc("score"), "doc_id")
    place = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n").withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top_k)


def hashed_vectors(texts: Column, dims: int = 64) -> Column:
    """A bag-of-words vector for each text of an array, a stand-in where no encoder is at hand."""

    def places(t: Column) -> Column:
        return F.transform(S.tokens(F.coalesce(t, F.lit(""))), lambda w: F.pmod(F.crc32(F.encode(w, "UTF-8")), F.lit(dims)).cast("int"))

    def counts(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.size(F.filter(p, lambda x: x == k)).cast("double"))

    return F.transform(texts, lambda t: F.transform(F.array(places(t)), counts)[0])


# ---------------------------------------------------------------- faithfulness


def canonical_evidence(reference: Column, used: Column) -> Column:
    """Texts of reference evidence (else of used evidence), trimmed, by doc_id, then those without one in place; [''] if none.

    Both are array<struct<doc_id, text>>.
    """
    raw = F.when(F.coalesce(F.size(reference), F.lit(0)) > 0, reference).otherwise(F.coalesce(used, F.array().cast(_EVIDENCE)))
    keyed = F.transform(
        raw,
        lambda e, i: F.struct(
            e["doc_id"].isNull().cast("int").alias("late"), F.coalesce(e["doc_id"], i.cast("bigint")).alias("k"), i.alias("i"), F.trim(e["text"]).alias("text")
        ),
    )
    texts = F.transform(F.array_sort(F.filter(keyed, lambda e: e["text"] != "")), lambda e: e["text"])
    return F.when(F.size(texts) > 0, texts).otherwise(F.array(F.lit("")))


_EVIDENCE = "array<struct<doc_id:bigint,text:string>>"


def overlap(explanation: Column, evidence: Column) -> Column:
    """Share of the explanation's distinct words (stop words left out) that the evidence has."""
    stop = F.array(*[F.lit(w) for w in S.STOP_WORDS])
    said = F.array_except(S.tokens(F.coalesce(explanation, F.lit(""))), stop)
    known = F.array_except(F.flatten(F.transform(evidence, lambda e: S.tokens(e))), stop)
    return F.when(F.size(said) > 0, F.size(F.array_intersect(said, known)) / F.size(said)).otherwise(F.lit(0.0))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by bit-parallel rows: one big-integer step per word of ``b``."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def rouge_l_one(explanation: str | None, evidence) -> float:
    """LCS over the explanation's words: a precision; 0 where either is empty."""
    hyp = (explanation or "").lower().split()
    ref = " ".join(e or "" for e in (evidence if evidence is not None else [])).lower().split()
    return lcs_length(ref, hyp) / len(hyp) if hyp and ref else 0.0


def rouge_l(explanation: Column, evidence: Column) -> Column:
    """ROUGE-L of each row, Arrow batch by Arrow batch."""

    @F.pandas_udf("double")
    def run(x: pd.Series, ev: pd.Series) -> pd.Series:
        return pd.Series([rouge_l_one(a, b) for a, b in zip(x, ev, strict=True)], dtype="float64")

    return run(explanation, evidence)


def semantic_similarity(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Mean cosine of ``vector`` with each of ``evidence_vectors``, per row of (key, vector, evidence_vectors)."""
    cos = F.transform(F.array(V.unit(F.col("vector"))), lambda u: F.transform("evidence_vectors", lambda e: V.dot(u, V.unit(e))))[0]
    mean = F.aggregate(cos, F.lit(0.0), lambda s, x: s + x) / F.size(cos)
    return pairs.select(*key, F.when(F.size(cos) > 0, mean).otherwise(F.lit(0.0)).alias("semantic_sim"))


#: The public scorer's model and layer.
SCORER_MODEL, SCORER_LAYERS, SCORER_LANG = "roberta-large", 17, "en"


def bertscore_settings(local: bool, directory: str = "models/roberta-large", rescale: bool | None = None) -> tuple[str, dict]:
    """Model name and arguments: a local model has 17 layers and no rescaling unless asked."""
    scale = not local if rescale is None else bool(rescale)
    own = {"model_type": directory, "num_layers": SCORER_LAYERS, "lang": None} if local else {"lang": SCORER_LANG}
    return (directory if local else SCORER_MODEL), own | {"rescale_with_baseline": scale}


TokenVectors = Callable[[list[str]], np.ndarray]


@functools.lru_cache(200_000)
def _word_vector(word: str, dims: int) -> np.ndarray:
    padded, out = f"^{word}$", np.zeros(dims)
    for k in range(max(1, len(padded) - 2)):
        h = crc32(padded[k : k + 3].encode())
        out[h % dims] += 1 if h & 1 << 20 else -1
    n = np.linalg.norm(out)
    return out / n if n > 0 else out


def hashed_token_vectors(words: list[str], dims: int = 32) -> np.ndarray:
    """Deterministic unit vectors from character trigrams: related spellings are close.

    A stand-in for a neural scorer, by name and by numbers; words met before are remembered.
    """
    return np.stack([_word_vector(w, dims) for w in words]) if words else np.zeros((0, dims))


def greedy_match_f1(candidate: np.ndarray, reference: np.ndarray) -> float:
    """BERTScore's F1: mean best cosine both ways."""
    if not len(candidate) or not len(reference):
        return 0.0
    sim = candidate @ reference.T
    p, r = float(sim.max(axis=1).mean()), float(sim.max(axis=0).mean())
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def bertscore(df: DataFrame, embed: TokenVectors = hashed_token_vectors) -> DataFrame:
    """Adds ``bert_score_f1`` to (explanation, evidence[]); the token embedding is pluggable."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            scores = []
            for x, ev in zip(f["explanation"], f["evidence"], strict=True):
                a, b = (x or "").lower().split(), " ".join(ev).lower().split()
                scores.append(greedy_match_f1(embed(a), embed(b)) if a and b else 0.0)
            yield f.assign(bert_score_f1=scores)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", bert_score_f1 double"
    return df.mapInPandas(run, schema)


def evaluate(records: DataFrame) -> DataFrame:
    """(user_id, movie_id, condition, explanation, four measures rounded to 4 digits).

    ``records`` (user_id, movie_id, condition, explanation, reference_evidence, evidence_used).
    """
    rows = records.withColumn("evidence", canonical_evidence(F.col("reference_evidence"), F.col("evidence_used")))
    scored = bertscore(rows.select("user_id", "movie_id", "condition", "explanation", "evidence"))
    vec = scored.select("*", hashed_vectors(F.concat(F.array(F.coalesce("explanation", F.lit(""))), "evidence")).alias("v"))
    vec = vec.withColumn("v", F.transform("v", lambda e: V.unit(e))).withColumn("ev", F.slice("v", 2, F.size("v")))
    cos = F.transform(F.array(F.col("v")[0]), lambda u: F.transform("ev", lambda e: V.dot(u, e)))[0]
    sem = F.aggregate(cos, F.lit(0.0), lambda s, x: s + x) / F.size(cos)
    return vec.select(
        "user_id", "movie_id", "condition", "explanation", F.round(overlap(F.col("explanation"), F.col("evidence")), 4).alias("evidence_overlap"),
        F.round(rouge_l(F.col("explanation"), F.col("evidence")), 4).alias("rouge_l"), F.round(sem, 4).alias("semantic_sim"), F.round("bert_score_f1", 4).alias("bert_score_f1"),
    )


def summarise(detailed: DataFrame) -> DataFrame:
    """Mean of each measure by condition, 4 digits."""
    return detailed.groupBy("condition").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in ("evidence_overlap", "rouge_l", "semantic_sim", "bert_score_f1") if c in detailed.columns]
    ).orderBy("condition")
