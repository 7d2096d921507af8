"""Sources: delimited interaction files, metadata JSON, JSON lines, vectors, Parquet."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATINGS = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("movie_id", T.LongType()), T.StructField("rating", T.IntegerType()), T.StructField("timestamp", T.LongType())])
MOVIES = T.StructType([T.StructField("movie_id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("genres", T.StringType())])
USERS = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("gender", T.StringType()), T.StructField("age", T.IntegerType()), T.StructField("occupation", T.IntegerType()), T.StructField("zip_code", T.StringType())])
_NAMED = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("job", T.StringType())]))
METADATA_JSON = T.StructType([
    T.StructField("movie_id", T.LongType()), T.StructField("tmdb_id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("year", T.IntegerType()),
    T.StructField("genres", T.ArrayType(T.StringType())), T.StructField("actors", T.ArrayType(T.StringType())), T.StructField("directors", T.ArrayType(T.StringType())),
    T.StructField("overview", T.StringType()), T.StructField("tagline", T.StringType()), T.StructField("release_date", T.StringType()),
    T.StructField("vote_average", T.DoubleType()), T.StructField("vote_count", T.LongType()), T.StructField("popularity", T.DoubleType()),
])
CREDITS_JSON = T.StructType([T.StructField("cast", _NAMED), T.StructField("crew", _NAMED)])

#: Score columns in order of preference.
SCORE_COLUMNS = ("pred_score", "score", "final_score", "rank_score", "cf_score")


def parquet(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = "::", encoding: str = "ISO-8859-1") -> DataFrame:
    """Headerless delimited files with an explicit schema."""
    return spark.read.csv(path, schema=schema, sep=sep, encoding=encoding, header=False, quote="")


def ratings(spark: SparkSession, path: str) -> DataFrame:
    return delimited(spark, path, RATINGS)


def users(spark: SparkSession, path: str) -> DataFrame:
    return delimited(spark, path, USERS)


#: A year in brackets at the end of a title, and what a clean title leaves out.
YEAR, YEAR_SUFFIX = r"\((\d{4})\)$", r"\s*\(\d{4}\)$"


def title_year(title: Column) -> Column:
    """The four digits in closing brackets, null without any."""
    return F.nullif(F.regexp_extract(title, YEAR, 1), F.lit(""))


def clean_title(title: Column) -> Column:
    return F.regexp_replace(title, YEAR_SUFFIX, "")


def movies(spark: SparkSession, path: str) -> DataFrame:
    raw = delimited(spark, path, MOVIES)
    return raw.withColumn("year", title_year(F.col("title"))).withColumn("clean_title", clean_title(F.col("title")))


def present(c: Column) -> Column:
    """Null for null, empty and the literal 'nan'."""
    return F.when(~c.isin("", "nan"), c)


def csv_with_header(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def metadata_directory(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per file."""
    return spark.read.schema(METADATA_JSON).json(path, multiLine=True)


def credits_lists(cast: Column, crew: Column, top: int = 5) -> tuple[Column, Column]:
    """Names of the first ``top`` cast members, and of the crew whose job is Director."""
    actors = F.slice(F.transform(cast, lambda c: c["name"]), 1, top)
    directors = F.transform(F.filter(crew, lambda c: c["job"] == "Director"), lambda c: c["name"])
    return actors, directors


def json_lines(spark: SparkSession, path: str, schema: T.StructType, drop_malformed: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed ones raise or are dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED" if drop_malformed else "FAILFAST")


def vectors_npy(spark: SparkSession, vectors_path: str, ids_path: str) -> DataFrame:
    """(id, vector) from two NPY files on a path that the driver can read."""
    v, ids = np.load(vectors_path), np.load(ids_path)
    rows = [(int(i), [float(x) for x in row]) for i, row in zip(ids, v, strict=True)]
    return spark.createDataFrame(rows, "id long, vector array<double>")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def optional(spark: SparkSession, path: str | None) -> DataFrame | None:
    """None where there is no such table; features that come from it default to zero."""
    return spark.read.parquet(path) if path and exists(spark, path) else None


def required(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that exists, in order of preference."""
    return next((p for p in paths if exists(spark, p)), None)


def standard_scores(df: DataFrame) -> DataFrame:
    """(user_id, movie_id, cf_score, kg_recall_score): the first other column is the score."""
    other = [c for c in df.columns if c not in ("user_id", "movie_id", "kg_recall_score")]
    if not other:
        raise ValueError("no score column")
    kg = F.col("kg_recall_score") if "kg_recall_score" in df.columns else F.lit(0.0)
    return df.select("user_id", "movie_id", F.col(other[0]).alias("cf_score"), kg.alias("kg_recall_score"))


def ranked_recommendations(df: DataFrame, k: int) -> DataFrame:
    """Top ``k`` per user by ``rank`` if there is one, else by the first known score column."""
    from pyspark.sql import Window

    if "rank" in df.columns:
        return df.filter(F.col("rank") <= k)
    score = next((c for c in SCORE_COLUMNS if c in df.columns), None)
    if score is None:
        raise ValueError("neither a rank nor a known score column")
    w = Window.partitionBy("user_id").orderBy(F.desc(score), "movie_id")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
