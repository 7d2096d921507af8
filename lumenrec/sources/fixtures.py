"""Views of the star-schema tables as interactions, item metadata, vectors and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrec.operators import prep
from lumenrec.sources.readers import parquet
from lumenrec.sources.workspace import stored


def interactions_raw(spark: SparkSession, d: str, over: float | None = None) -> DataFrame:
    """Every order line; ``over`` keeps quantities above it, a filter that reaches the scan."""
    orders = parquet(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = parquet(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    if over is not None:
        lines = lines.filter(F.col("l_quantity") > over)
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"),
        F.ceil(F.col("l_quantity") / 10).cast("int").alias("rating"), F.col("o_orderdate").alias("ts"),
    )


def interactions(spark: SparkSession, d: str) -> DataFrame:
    """Positive interactions, one row per pair with its first time."""
    liked = prep.positive(interactions_raw(spark, d, over=30.0), 4)  # ceil(quantity / 10) >= 4 is quantity > 30
    return liked.groupBy("user_id", "item_id").agg(F.min("ts").alias("ts"))


def split(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, item_id, ts, split): stored once per session, most queries start here."""
    return stored(spark, d, "split", lambda: prep.time_split(prep.k_core(interactions(spark, d))))


def part_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    return split(spark, d).filter(F.col("split") == name).drop("split")


def train(spark: SparkSession, d: str) -> DataFrame:
    return part_of(spark, d, "train")


def metadata(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, title, genres[], actors[], director, decade, vote_count)."""
    lines = parquet(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    votes = lines.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("vote_count"), F.slice(F.array_sort(F.collect_set("l_suppkey")), 1, 5).alias("actors")
    )
    part = parquet(spark, d, "part")
    return part.join(votes, part.p_partkey == votes.l_partkey, "left").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"),
        F.concat(F.array("p_type"), F.split("p_name", " ")).alias("genres"),
        F.transform(F.coalesce("actors", F.array().cast("array<bigint>")), lambda a: a.cast("string")).alias("actors"),
        F.col("p_brand").alias("director"), (F.floor(F.col("p_size") / 10) * 10).cast("int").alias("decade"),
        F.coalesce("vote_count", F.lit(0)).alias("vote_count"),
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, vector array<double>)."""
    return parquet(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vector"))


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns with the user turn just before: (user_id, movie_id, explanation, evidence)."""
    c = parquet(spark, d, "conversations")
    said = c.filter("role = 'assistant'").select(F.col("conv_id").alias("user_id"), F.col("turn").alias("movie_id"), F.col("text").alias("explanation"))
    asked = c.filter("role = 'user'").select(F.col("conv_id").alias("user_id"), (F.col("turn") + 1).alias("movie_id"), F.col("text").alias("evidence"))
    return said.join(asked, ["user_id", "movie_id"])
