"""Exact dedup by a tree merge of digest runs, in DataFrame operations only.

Every input partition reduces its rows to one run: a row for each distinct
digest with the smallest identifier and a row count.  Runs then meet in
binomial rounds: in each round ``fan_in`` neighbouring runs exchange their rows
by digest, are sorted, and merge to one run that keeps the smallest identifier.
After ceil(log_fan_in(runs)) rounds one run is left, spread over the cluster by
digest.  Every level-0 run then takes its digests' verdict from the last one:
a digest meets one row per run there at most, however many copies it has.

A digest counts as the same text only together with its byte length and an
independent 64-bit hash, so each level verifies what it merges.  A group of
copies sends at most one row per run to a merge, however large it is.

Defined results: null text equals empty text; an empty table gives no rows; of
rows that repeat both identifier and text exactly one is kept; a null
identifier sorts after all others; columns beside id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, one_space, quoted, row_keys, text_or_empty, without

_KEY = ("digest", "n_bytes", "proof")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 256, pos_col: str | None = None) -> DataFrame:
    """One narrow row per document: run, id, position (``pos_col``, or a number), digest, length, second hash."""
    text = F.encode(one_space(text_or_empty(quoted(text_col))), "UTF-8")
    keyed = docs.select(
        F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"),
        F.col(quoted(id_col)).alias("id"),
        (F.monotonically_increasing_id() if pos_col is None else F.col(quoted(pos_col))).alias("pos"),
        text.alias("t"),
    )
    return keyed.select(
        "run", "id", "pos",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.octet_length("t").alias("n_bytes"),
        F.xxhash64("t").alias("proof"),
    )


def local_runs(rows: DataFrame) -> DataFrame:
    """Level 0: each run holds a digest once.  Spark combines before the exchange."""
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("pos")))
    return rows.groupBy("run", *_KEY).agg(best.alias("best"), F.count(F.lit(1)).alias("n"))


def merge_round(level: DataFrame, fan_in: int) -> DataFrame:
    """Neighbouring runs exchange rows by digest; a sorted merge keeps the smallest id."""
    moved = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
    same = Window.partitionBy("run", *_KEY)
    in_order = same.orderBy("best")
    return (
        moved.withColumn("total", F.sum("n").over(same))
        .withColumn("place", F.row_number().over(in_order))
        .filter("place = 1")
        .select("run", *_KEY, "best", F.col("total").alias("n"))
    )


def tree_merge(level: DataFrame, runs: int, fan_in: int) -> DataFrame:
    while runs > 1:
        level = merge_round(level, fan_in)
        runs = -(-runs // fan_in)
    return level.select(*_KEY, F.col("best").alias("root"), F.col("n").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 256, fan_in: int = 16, pos_col: str | None = None) -> DataFrame:
    """A row per document: id, keep_id, group_size, kept, sha256 (binary), pos; rows with equal id and text counted once as kept."""
    if runs < 1 or fan_in < 2:
        raise ValueError("runs must be at least 1 and fan_in at least 2")
    rows = cut(digest_rows(docs, id_col, text_col, runs, pos_col), "digests")
    level = local_runs(rows)
    roots = tree_merge(level, runs, fan_in)
    down = level.select("run", *_KEY).join(roots, list(_KEY))
    return rows.join(down, ["run", *_KEY]).select(
        "id",
        F.col("root.id").alias("keep_id"),
        "group_size",
        F.col("id").eqNullSafe(F.col("root.id")).__and__(F.col("pos") == F.col("root.pos")).alias("kept"),
        "digest",
        "pos",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``exact_groups`` keeps, with all their columns.

    Only the keys of the dropped rows travel: the identifier, or a stored row
    number where identifiers are null or repeat.
    """
    rows, key = row_keys(docs, id_col)
    dropped = cut(exact_groups(rows, id_col, text_col, pos_col=key).filter("NOT kept").select("pos"), "dropped")
    return without(rows, key, dropped).select(*[F.col(quoted(c)) for c in docs.columns])
