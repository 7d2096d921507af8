"""Filtering, k-core, time split, histories, identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenrec.sources.workspace import drop, store


def positive(df: DataFrame, least: int = 4) -> DataFrame:
    return df.filter(F.col("rating") >= least)


#: Dropped users or items that may be broadcast.
BROADCAST_KEYS = 1_000_000


def k_core(df: DataFrame, user_min: int = 10, item_min: int = 5) -> DataFrame:
    """Users with ``user_min`` rows, then items with ``item_min``, until nothing changes.

    Rows are counted once for each side.  A round takes what its dropped keys' rows
    count off the other side, so rows are neither dealt nor written anew for it; only
    keys travel.  All tables are in the shared folder: plans stay short, and a lost
    executor costs no earlier round.
    """
    rows = store(df.filter("user_id IS NOT NULL AND item_id IS NOT NULL"), "rows")
    sides = (("user_id", user_min), ("item_id", item_min))
    left = {key: store(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "counts") for key, _ in sides}
    gone: dict[str, list[DataFrame]] = {key: [] for key, _ in sides}

    def keys(few: DataFrame, n: int) -> DataFrame:
        return F.broadcast(few) if n <= BROADCAST_KEYS else few

    changed = True
    while changed:  # keys only go, so the fixpoint comes
        changed = False
        for (key, least), (other, _) in (sides, sides[::-1]):
            few = store(left[key].filter(F.col("n") < least).select(key), "few")
            n = few.count()
            gone[key].append(few)
            if not n:
                continue
            changed = True
            lost = rows.join(keys(few, n), key, "left_semi").groupBy(other).agg(F.count(F.lit(1)).alias("lost"))
            new = {
                key: left[key].filter(F.col("n") >= least),
                other: left[other].join(lost, other, "left").select(other, (F.col("n") - F.coalesce("lost", F.lit(0))).alias("n")),
            }
            for k, counts in new.items():
                before, left[k] = left[k], store(counts, "counts")
                drop(before)
    out = rows
    for key, few in gone.items():
        every = reduce(DataFrame.union, few)
        out = out.join(keys(every, every.count()), key, "left_anti")
    out = store(out.select(df.columns), "k-core")
    for t in (rows, *left.values(), *gone["user_id"], *gone["item_id"]):
        drop(t)
    return out


def time_split(df: DataFrame, train: float = 0.7, val: float = 0.1) -> DataFrame:
    """Adds ``split``: per user by (ts, item_id), shares as truncated double products."""
    w = Window.partitionBy("user_id")
    place = F.row_number().over(w.orderBy("ts", "item_id"))
    n = F.count(F.lit(1)).over(w)
    n_train = F.floor(n * F.lit(float(train)))
    n_val = F.greatest(F.lit(1), F.floor(n * F.lit(float(val))))
    n_val = F.when(n_train + n_val >= n, F.greatest(F.lit(1), n - n_train - 1)).otherwise(n_val)
    return (
        df.withColumn("rn", place)
        .withColumn("nt", n_train)
        .withColumn("nv", n_val)
        .withColumn("split", F.when(F.col("rn") <= F.col("nt"), "train").when(F.col("rn") <= F.col("nt") + F.col("nv"), "val").otherwise("test"))
        .drop("rn", "nt", "nv")
    )


def last_n(df: DataFrame, n: int | None) -> DataFrame:
    """The last ``n`` rows per user with ``age`` 1 for the newest; all rows without ``n``."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("item_id"))
    out = df.withColumn("age", F.row_number().over(w))
    return out if n is None else out.filter(F.col("age") <= n)


def histories(df: DataFrame, n: int) -> DataFrame:
    """(user_id, history[]) oldest first, at most ``n`` items."""
    rows = last_n(df, n)
    packed = F.array_sort(F.collect_list(F.struct((-F.col("age")).alias("a"), "item_id")))
    return rows.groupBy("user_id").agg(F.transform(packed, lambda s: s["item_id"]).alias("history"))


def normalise_id(c: Column) -> Column:
    """Whole numbers given as int, float or text become bigint; anything else raises."""
    x = F.trim(c.cast("string")).try_cast("double")
    bad = x.isNull() | F.isnan(x) | (x != F.floor(x))
    said = F.concat(F.lit("not a whole id: "), F.coalesce(c.cast("string"), F.lit("null")))
    return F.when(bad, F.raise_error(said).cast("bigint")).otherwise(x.cast("bigint"))


def top_per_user(df: DataFrame, score: str, n: int, digits: int = 6, item: str = "item_id") -> DataFrame:
    """Adds ``rank``; ties of the rounded score go by ascending item."""
    w = Window.partitionBy("user_id").orderBy(F.desc(F.round(score, digits)), item)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def popularity(df: DataFrame) -> DataFrame:
    return df.groupBy("item_id").agg(F.count(F.lit(1)).alias("popularity"))


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """1-based position in a total order, without a single-partition window.

    Rows are range-partitioned and ranked inside partitions; the partitions'
    sizes (one row each) give the offsets.
    """
    parts = store(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("__o", before).select("__p", "__o")
    return parts.withColumn("__r", inside).join(F.broadcast(offsets), "__p").withColumn(name, F.col("__r") + F.col("__o")).drop("__p", "__r", "__o")


def user_hash_split(users: DataFrame, share: float = 0.2, salt: str = ":42") -> DataFrame:
    """(user_id, is_val): the first share of users in the order of a salted hash."""
    keyed = users.select("user_id").distinct().withColumn("h", F.md5(F.encode(F.concat(F.col("user_id").cast("string"), F.lit(salt)), "UTF-8")))
    ranked = global_rank(keyed, ["h", "user_id"], "rk")
    n = keyed.count()
    return ranked.select("user_id", (F.col("rk") <= int(n * share)).alias("is_val"))
