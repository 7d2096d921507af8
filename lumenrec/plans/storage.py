"""Queries over sources and sinks: tables written in each format and read back."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrec.functions import strings as S
from lumenrec.functions import vectors as V
from lumenrec.operators import explain, features
from lumenrec.plans.registry import query
from lumenrec.plans.sql import with_
from lumenrec.sources import fixtures as X
from lumenrec.sources import lookup, readers, sinks
from lumenrec.sources.workspace import root


def _path(s: SparkSession, name: str) -> str:
    return f"{root(s)}/{name}-{uuid.uuid4().hex}"


def _lines(df: DataFrame, path: str, *columns) -> str:
    """Text lines of columns joined by ``::``."""
    df.select(F.concat_ws("::", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]).alias("value")).write.text(path)
    return path


# ---------------------------------------------------------------- sources


@query("SELECT o_custkey AS user_id, l_partkey AS movie_id, CAST(ceil(l_quantity / 10) AS INTEGER) AS rating, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 86400 AS timestamp FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def delimited_ratings(s, d):
    days = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
    return readers.ratings(s, _lines(X.interactions_raw(s, d), _path(s, "ratings"), "user_id", "item_id", "rating", days))


@query("""SELECT p_partkey AS movie_id, p_name || ' (' || (1950 + p_size) || ')' AS title, p_type || '|' || p_brand AS genres, CAST(1950 + p_size AS VARCHAR) AS year, p_name AS clean_title FROM part""")
def delimited_movies(s, d):
    title = F.concat("p_name", F.lit(" ("), (F.lit(1950) + F.col("p_size")).cast("string"), F.lit(")"))
    return readers.movies(s, _lines(readers.parquet(s, d, "part"), _path(s, "movies"), "p_partkey", title, F.concat_ws("|", "p_type", "p_brand")))


@query("""SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender, c_nationkey AS age, c_nationkey % 7 AS occupation, c_mktsegment AS zip_code FROM customer""")
def delimited_users(s, d):
    c = readers.parquet(s, d, "customer")
    path = _lines(c, _path(s, "users"), "c_custkey", F.when(F.col("c_custkey") % 2 == 0, "M").otherwise("F"), "c_nationkey", F.col("c_nationkey") % 7, "c_mktsegment")
    return readers.users(s, path)


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def csv_header_scan(s, d):
    p, path = readers.parquet(s, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), _path(s, "csv")
    p.write.csv(path, header=True)
    return readers.csv_with_header(s, path, p.schema)


@query("SELECT CAST(n_nationkey AS BIGINT) AS movie_id, n_name AS title, [r_name, 'any'] AS genres, CAST(NULL AS VARCHAR) AS overview, CAST(n_regionkey AS BIGINT) AS vote_count FROM nation JOIN region ON r_regionkey = n_regionkey")
def json_directory_scan(s, d):
    """One JSON object per file, as a metadata cache holds them; absent fields are null."""
    rows = readers.parquet(s, d, "nation").join(readers.parquet(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = _path(s, "cache")
    rows.select(F.col("n_nationkey").alias("movie_id"), F.col("n_name").alias("title"), F.array("r_name", F.lit("any")).alias("genres"), F.col("n_regionkey").alias("vote_count")).write.option("maxRecordsPerFile", 1).json(path)
    return readers.metadata_directory(s, path).select("movie_id", "title", "genres", "overview", "vote_count")


_SUPPLIER = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType())])


@query("SELECT s_suppkey, s_name FROM supplier")
def json_lines_scan(s, d):
    """Blank lines between records are skipped."""
    path = _path(s, "jsonl")
    lines = F.explode(F.array(F.to_json(F.struct("s_suppkey", "s_name")), F.lit("")))
    readers.parquet(s, d, "supplier").select(lines.alias("value")).write.text(path)
    return readers.json_lines(s, path, _SUPPLIER)


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 5 <> 0")
def json_lines_malformed(s, d):
    """Records that were cut off while being written are dropped."""
    whole = F.to_json(F.struct("s_suppkey", "s_name"))
    path = _path(s, "broken")
    readers.parquet(s, d, "supplier").select(F.when(F.col("s_suppkey") % 5 == 0, F.substring(whole, 1, 12)).otherwise(whole).alias("value")).write.text(path)
    return readers.json_lines(s, path, _SUPPLIER, drop_malformed=True)


@query("""SELECT CAST(n_nationkey AS BIGINT) AS id, round(n_nationkey / n, 6) + 0.0 AS x, round(n_regionkey / n, 6) + 0.0 AS y FROM (SELECT *, greatest(sqrt(CAST(n_nationkey * n_nationkey + n_regionkey * n_regionkey AS DOUBLE)), CAST(1e-9 AS DOUBLE)) AS n FROM nation)""")
def npy_vectors(s, d):
    """Vectors of a small table through NPY files on the driver, normalised; the zero vector stays zero."""
    rows = readers.parquet(s, d, "nation").select("n_nationkey", "n_regionkey").collect()  # 25 rows by the table's nature
    with tempfile.TemporaryDirectory() as folder:
        v, ids = os.path.join(folder, "v.npy"), os.path.join(folder, "ids.npy")
        np.save(v, np.array([[r.n_nationkey, r.n_regionkey] for r in rows], float))
        np.save(ids, np.array([r.n_nationkey for r in rows]))
        table = readers.vectors_npy(s, v, ids)
    unit = table.select("id", V.unit(F.col("vector")).alias("u"))
    return unit.select("id", (F.round(F.col("u")[0], 6) + 0.0).alias("x"), (F.round(F.col("u")[1], 6) + 0.0).alias("y"))


@query(with_("pop", "SELECT p_partkey, coalesce(popularity, 0) AS popularity, 0 AS kg_recall_score FROM part LEFT JOIN pop ON item_id = p_partkey"))
def source_or_zero(s, d):
    """A table that exists is joined; one that does not gives zeros."""
    path = _path(s, "popularity")
    sinks.overwrite(X.train(s, d).groupBy(F.col("item_id").alias("p_partkey")).agg(F.count(F.lit(1)).alias("popularity")), path)
    out = readers.parquet(s, d, "part").select("p_partkey")
    for name, where in (("popularity", path), ("kg_recall_score", f"{path}-missing")):
        table = readers.optional(s, where)
        out = out.withColumn(name, F.lit(0).cast("bigint")) if table is None else out.join(table, "p_partkey", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("kg_recall_score", F.col("kg_recall_score").cast("int"))


@query("SELECT n_nationkey, 'second' AS found, true AS refused FROM nation")
def source_preference(s, d):
    """The first of three places that exists is read; a required table that does not exist is refused."""
    base, nation = _path(s, "places"), readers.parquet(s, d, "nation").select("n_nationkey")
    for name in ("third", "second"):
        sinks.overwrite(nation.withColumn("found", F.lit(name)), f"{base}/{name}")
    try:
        readers.required(s, f"{base}/first")
        refused = False
    except FileNotFoundError:
        refused = True
    chosen = readers.first_existing(s, [f"{base}/{n}" for n in ("first", "second", "third")])
    return readers.required(s, chosen).withColumn("refused", F.lit(refused))


def _fetch(path: str, params: dict) -> dict:
    """A search service made up from the request alone: titles with 'cold' have no hit."""
    if path == "search/movie":
        return {"results": [] if "cold" in params["query"] else [{"id": 1000 + len(params["query"])}, {"id": 7}]}
    if path.endswith("credits"):
        return {"cast": [{"name": f"a{k}"} for k in range(9)], "crew": [{"name": "d", "job": "Director"}, {"name": "w", "job": "Writer"}]}
    return {"title": "T", "genres": [{"name": "G"}], "overview": "o", "vote_count": int(path.split("/")[1])}


@query("""SELECT p_partkey AS movie_id, CASE WHEN NOT contains(p_name, 'cold') THEN 1000 + length(p_name) END AS tmdb_id, CASE WHEN contains(p_name, 'cold') THEN p_name ELSE 'T' END AS title,
CASE WHEN contains(p_name, 'cold') THEN [] ELSE ['a0', 'a1', 'a2', 'a3', 'a4'] END AS actors, CASE WHEN contains(p_name, 'cold') THEN [] ELSE ['d'] END AS directors, CASE WHEN NOT contains(p_name, 'cold') THEN 1000 + length(p_name) END AS vote_count FROM part""")
def metadata_lookup(s, d):
    movies = readers.parquet(s, d, "part").select(F.col("p_partkey").alias("movie_id"), F.col("p_name").alias("title"), (F.lit(1950) + F.col("p_size")).alias("year"))
    return lookup.lookup(movies, _fetch).select("movie_id", "tmdb_id", "title", "actors", "directors", "vote_count")


# ---------------------------------------------------------------- sinks


@query("SELECT n_nationkey, n_name, 'NATION' AS kind FROM nation UNION ALL SELECT r_regionkey, r_name, 'REGION' FROM region")
def append_sink(s, d):
    path = _path(s, "appended")
    for table, prefix in (("nation", "n"), ("region", "r")):
        rows = readers.parquet(s, d, table)
        sinks.append_json(rows.select(F.col(f"{prefix}_{table}key").alias("n_nationkey"), F.col(f"{prefix}_name").alias("n_name"), F.lit(table.upper()).alias("kind")), path)
    return readers.json_lines(s, path, T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType()), T.StructField("kind", T.StringType())]))


@query("SELECT r_name AS metric, CAST(count(*) AS DOUBLE) AS value FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def metrics_sink(s, d):
    """A metric dictionary written as one JSON file and read back."""
    by = readers.parquet(s, d, "nation").join(readers.parquet(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").count()
    path = _path(s, "metrics")
    sinks.metrics_json(s, {r.r_name: float(r["count"]) for r in by.collect()}, path)  # five regions
    back = s.read.text(path).select(F.from_json("value", "map<string,double>").alias("m"))
    return back.select(F.explode("m").alias("metric", "value"))


@query("""WITH r AS (SELECT r_name AS region, CAST(count(*) AS VARCHAR) AS nations, row_number() OVER (ORDER BY r_name) AS i FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name),
w AS (SELECT CAST(greatest(6, max(length(region))) AS INTEGER) AS a, CAST(greatest(7, max(length(nations))) AS INTEGER) AS b FROM r)
SELECT CAST(0 AS BIGINT) AS line_no, '| ' || rpad('region', a, ' ') || ' | ' || rpad('nations', b, ' ') || ' |' AS line FROM w
UNION ALL SELECT 1, '| ' || repeat('-', a) || ' | ' || repeat('-', b) || ' |' FROM w UNION ALL SELECT i + 1, '| ' || rpad(region, a, ' ') || ' | ' || rpad(nations, b, ' ') || ' |' FROM r, w""")
def markdown_report(s, d):
    by = readers.parquet(s, d, "nation").join(readers.parquet(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    made = sinks.markdown_of(by.groupBy(F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("nations")).orderBy("region"))
    return s.createDataFrame(list(enumerate(made.split("\n"))), "line_no bigint, line string")


@query(with_("turnp", "SELECT user_id, movie_id, explanation FROM turnp"))
def explanations_sink(s, d):
    path, rows = _path(s, "explanations"), X.turn_pairs(s, d).select("user_id", "movie_id", "explanation")
    sinks.explanations(rows, path)
    return sinks.load_explanations(s, path, rows.schema)


@query(with_("ovl", "SELECT user_id, movie_id, round(evidence_overlap, 4) AS evidence_overlap, (SELECT round(avg(evidence_overlap), 4) FROM ovl) AS mean, 'kg_only' AS mode FROM ovl"))
def faithfulness_sink(s, d):
    """Details, summary and run metadata, written and read back."""
    from lumenrec.operators import text

    p, path = X.turn_pairs(s, d), _path(s, "faithfulness")
    detailed = p.select("user_id", "movie_id", F.round(text.overlap(F.col("explanation"), F.array("evidence")), 4).alias("evidence_overlap"), text.overlap(F.col("explanation"), F.array("evidence")).alias("exact"))
    sinks.faithfulness(detailed, detailed.agg(F.round(F.avg("exact"), 4).alias("mean")), {"mode": "kg_only"}, path)
    mode = json.loads(s.read.text(f"{path}/metadata").first().value)["mode"]
    back = readers.json_lines(s, f"{path}/detailed", detailed.schema).join(F.broadcast(s.read.schema("mean double").json(f"{path}/summary")))
    return back.select("user_id", "movie_id", "evidence_overlap", "mean", F.lit(mode).alias("mode"))


@query("SELECT n_nationkey, CASE WHEN k = 0 THEN 'base' ELSE 'capped' END AS variant FROM nation, (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR n_nationkey % 2 = 0")
def variant_paths(s, d):
    """Experiments write next to each other, a path per variant."""
    base, nation = _path(s, "variants"), readers.parquet(s, d, "nation").select("n_nationkey")
    sinks.with_backup(nation, base, "base")
    sinks.with_backup(nation.filter("n_nationkey % 2 = 0"), base, "capped")
    return s.read.parquet(base)


# ---------------------------------------------------------------- registries and templates


@query("""SELECT * FROM (VALUES ('V1', ['cf_score', 'kg_recall_score']), ('V2', ['cf_score', 'kg_recall_score', 'content_similarity', 'popularity', 'vote_count']),
('V3', ['cf_score', 'kg_recall_score', 'content_similarity', 'popularity', 'vote_count', 'kg_a', 'kg_b']), ('V3e', ['cf_score', 'kg_recall_score', 'content_similarity', 'popularity', 'vote_count', 'kg_emb_x']),
('V4', ['cf_score', 'kg_recall_score', 'content_similarity', 'popularity', 'vote_count', 'kg_a', 'kg_b', 'kg_emb_x'])) t(variant, names)""")
def feature_registry(s, d):
    """Each variant's features among the columns of a frame; prefixes stand for all columns that have them."""
    columns = ["user_id", "item_id", "cf_score", "kg_recall_score", "content_similarity", "popularity", "vote_count", "kg_a", "kg_emb_x", "kg_b", "label"]
    return s.createDataFrame([(v, features.resolve(names, columns)) for v, names in features.FEATURE_SETS.items()], "variant string, names array<string>")


@query("""SELECT * FROM (VALUES ('hybrid', 'rag', 'graph,retrieved', 'kg_only'), ('kg_only', 'kg_only', 'graph', 'kg_only'), ('retrieval_only', 'retrieval_only', 'retrieved', 'kg_only')) t(name, kept_in, takes, reference)""")
def mode_registry(s, d):
    """The evidence modes, and the reference table chosen where two weaker ones exist."""
    base, nation = _path(s, "runs"), readers.parquet(s, d, "nation")
    for table in ("prompt_only", "retrieval_only", "kg_only"):
        sinks.overwrite(nation, f"{base}/explanations_{table}")
    chosen = explain.reference_path(s, base).rsplit("_", 2)
    rows = [(n, m.table, ",".join(m.takes), "_".join(chosen[-2:])) for n, m in explain.MODES.items()]
    return s.createDataFrame(rows, "name string, kept_in string, takes string, reference string")


@query("SELECT conv_id, turn, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS shown FROM conversations")
def text_shorten(s, d):
    return readers.parquet(s, d, "conversations").select("conv_id", "turn", S.shorten(F.col("text")).alias("shown"))


@query("""SELECT p_partkey, 'Numbered passages:' || chr(10) || '(1) ' || p_name || chr(10) || '(2) ' || p_type || chr(10) || chr(10) || 'Movie in question: ' || p_name || chr(10) || 'This user likes: "' || p_name || '"; "' || p_brand || '".' || chr(10) || 'Say why the movie fits, by passages alone; cite them as (1), (2) and so on.' AS grounded,
'Movie in question: ' || p_name || ' (' || p_type || ')' || chr(10) || 'This user likes: "' || p_name || '"; "' || p_brand || '".' || chr(10) || 'Say why the movie fits.' AS plain FROM part""")
def prompt_texts(s, d):
    p, titles = readers.parquet(s, d, "part"), F.array("p_name", "p_brand")
    passages = F.array(F.struct(F.col("p_name").alias("text")), F.struct(F.col("p_type").alias("text")))
    return p.select("p_partkey", explain.rag_prompt(titles, F.col("p_name"), passages).alias("grounded"), explain.plain_prompt(titles, F.col("p_name"), F.array("p_type")).alias("plain"))
