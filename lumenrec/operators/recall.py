"""Candidate generation: item-item collaborative filtering, vectors, merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrec.functions import vectors as V
from lumenrec.operators import prep
from lumenrec.sources.workspace import append, drop, reread, store, table


def co_occurrence(train: DataFrame) -> DataFrame:
    """(a, b, n) for a < b: users who have both.  Pair counts combine before the shuffle."""
    pairs = train.select("user_id", "item_id").distinct()
    left = pairs.withColumnRenamed("item_id", "a")
    right = pairs.withColumnRenamed("item_id", "b")
    return left.join(right, "user_id").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def item_cosine(train: DataFrame) -> DataFrame:
    """(a, b, n, sim) for a < b; sim = n / sqrt(d_a d_b)."""
    d = train.select("user_id", "item_id").distinct().groupBy("item_id").agg(F.count(F.lit(1)).alias("d"))
    da, db = d.select(F.col("item_id").alias("a"), F.col("d").alias("da")), d.select(F.col("item_id").alias("b"), F.col("d").alias("db"))
    return co_occurrence(train).join(da, "a").join(db, "b").select("a", "b", "n", (F.col("n") / F.sqrt(F.col("da") * F.col("db"))).alias("sim"))


#: Entries of a list that travels as one row.
CHUNK = 1024
#: Entries that a task sums at once.
SUM_ENTRIES = 2_000_000
#: Entries that the similarities of a pass have, and the most passes: beyond, the disk of a pass is a fixed share of the whole.
PASS_ENTRIES, PASSES = 50_000_000, 8


def _cut(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, an array for each column): lists by key of at most CHUNK entries, in order of the first column."""
    numbered = rows.withColumn("__c", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(columns[0])) - 1) / CHUNK))
    packed = numbered.groupBy(key, "__c").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("__l"))
    return packed.select(key, *[F.col("__l")[c].alias(c) for c in columns])


def _groups(batches: Iterator[pa.RecordBatch], key: str, entries: str) -> Iterator[pa.Table]:
    """Batches in order of ``key``, joined to tables of whole keys with SUM_ENTRIES list entries or a little more."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            if n > SUM_ENTRIES:
                cut = int(np.searchsorted(part.column(key).to_numpy(), held[-1].column(key)[-1].as_py(), "right"))
                if cut < part.num_rows:
                    yield pa.Table.from_batches([*held, part.slice(0, cut)])
                    held, n, part = [], 0, part.slice(cut)
            held.append(part)
            n += len(part.column(entries).flatten())
    if held:
        yield pa.Table.from_batches(held)


def _flat(t: pa.Table, name: str) -> np.ndarray:
    return pc.list_flatten(t.column(name)).to_numpy()


def _spans(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal neighbours: where each run begins, and each place's number of its run."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _order(group: np.ndarray, ids: np.ndarray, low: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The stable order by (group, id), and where each new pair begins in it."""
    if len(ids) and span * (int(group.max()) + 1) < 1 << 62:
        code = group * span + (ids - low)
        order = np.argsort(code, kind="stable")
        return order, _spans(code[order])[0]
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (i[1:] != i[:-1])
    return order, np.flatnonzero(new)


def _lists(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """values[start : start + size] for each start."""
    ends = np.cumsum(sizes)
    take = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values[take]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, users, near, sims) from (user_id, item_id, d, near, dn) in order of items."""
    for t in _groups(batches, "item_id", "near"):
        user, item, d = (t.column(c).to_numpy() for c in ("user_id", "item_id", "d"))
        size = pc.list_value_length(t.column("near")).to_numpy()
        near, dn = _flat(t, "near"), _flat(t, "dn")
        first, group = _spans(item)
        other = np.flatnonzero(near != np.repeat(item, size))
        g, near, dn = np.repeat(group, size)[other], near[other], dn[other]
        low = int(near.min()) if len(near) else 0
        order, new = _order(g, near, low, int(near.max()) - low + 1 if len(near) else 1)
        g, near, dn = g[order][new], near[order][new], dn[order][new]
        n = np.diff(np.append(new, len(order)))
        sims = n / np.sqrt((d[first][g] * dn).astype(float))
        # a user's list may come in parts: each user counts once for an item
        whole = np.ones(len(user), bool)
        whole[1:] = (user[1:] != user[:-1]) | (item[1:] != item[:-1])
        users, of = user[whole], group[whole]
        places = np.arange(len(first))
        nu, nn = np.bincount(of, minlength=len(first)), np.bincount(g, minlength=len(first))
        u0, n0 = np.searchsorted(of, places), np.searchsorted(g, places)
        pu, pn = -(-nu // CHUNK), -(-nn // CHUNK)
        row = np.repeat(places, pu * pn)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(pu * pn) - pu * pn, pu * pn)
        au, an = inner // np.maximum(pn[row], 1) * CHUNK, inner % np.maximum(pn[row], 1) * CHUNK
        ids = item[first]
        for at in range(0, len(row), 4096):
            r, x, y = row[at : at + 4096], au[at : at + 4096], an[at : at + 4096]
            short = np.minimum(nn[r] - y, CHUNK)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[r]), _lists(users, u0[r] + x, np.minimum(nu[r] - x, CHUNK)), _lists(near, n0[r] + y, short), _lists(sims, n0[r] + y, short)], names=["item_id", "users", "near", "sims"]
            )


def neighbours(train: DataFrame) -> DataFrame:
    """(item_id, users[], near[], sims[]), stored: each item's users and its neighbours with their similarity.

    Users send their lists to their items, which count them, so item pairs are
    never rows.  Lists are of at most CHUNK entries; longer ones take several rows,
    each part of the users with each part of the neighbours.
    """
    seen = train.select(F.col("user_id").cast("bigint").alias("user_id"), F.col("item_id").cast("bigint").alias("item_id")).distinct()
    d = seen.groupBy("item_id").agg(F.count(F.lit(1)).alias("d"))
    rows = store(seen.join(d, "item_id").select("user_id", "item_id", "d"), "degrees")
    own = _cut(rows, "user_id", "item_id", "d").select("user_id", F.col("item_id").alias("near"), F.col("d").alias("dn"))
    sent = rows.join(own, "user_id").repartition("item_id").sortWithinPartitions("item_id", "user_id")
    out = store(sent.mapInArrow(_count, "item_id bigint, users array<bigint>, near array<bigint>, sims array<double>"), "neighbours")
    drop(rows)
    return out


def _best_of(n: int):
    """(user_id, item_id, score, rank): the ``n`` best sums of each user; rounded to 6 digits, half up, then by ascending id."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "user_id", "near"):
            user, item = (t.column(c).to_numpy() for c in ("user_id", "item_id"))
            near, sims = _flat(t, "near"), _flat(t, "sims")
            first, group = _spans(user)
            low = min(int(near.min()), int(item.min()))
            span = max(int(near.max()), int(item.max())) - low + 1
            known = pa.table({"g": group, "i": item}).group_by(["g", "i"]).aggregate([])
            # what the user has enters with a sum below zero
            g = np.concatenate([np.repeat(group, pc.list_value_length(t.column("near")).to_numpy()), known.column("g").to_numpy()])
            ids = np.concatenate([near, known.column("i").to_numpy()])
            order, new = _order(g, ids, low, span)
            score = np.add.reduceat(np.concatenate([sims, np.full(known.num_rows, -np.inf)])[order], new)
            g, ids = g[order][new], ids[order][new]
            fresh = score > 0
            g, ids, score = g[fresh], ids[fresh], score[fresh]
            if not len(g):
                continue
            micro = score * 1e6
            down = np.floor(micro)
            down = (down + (micro - down >= 0.5)).astype(np.int64)
            top = int(down.max())
            order, _ = _order(g, top - down, 0, top + 1)
            g = g[order]
            start, run = _spans(g)
            place = np.arange(len(g)) - start[run]
            kept = place < n
            order = order[kept]
            made = pa.RecordBatch.from_arrays([pa.array(user[first][g[kept]]), pa.array(ids[order]), pa.array(score[order]), pa.array(place[kept] + 1)], names=["user_id", "item_id", "score", "rank"])
            for at in range(0, made.num_rows, 65536):
                yield made.slice(at, 65536)

    return best


def item_cf(train: DataFrame, n: int = 100) -> DataFrame:
    """Top ``n`` per user, stored; where fewer have a score, unseen items follow with score 0 by ascending id.

    Scores are summed a share of the users at a time where there are many, so that
    only that share's similarities lie on disk.  The zero-scored items of a user lie
    among the first n + |seen| + |scored| of the catalogue, so only that stretch is
    generated.
    """
    spark, near = train.sparkSession, neighbours(train)
    entries = near.agg(F.coalesce(F.sum(F.size("users").cast("bigint") * F.size("near")), F.lit(0))).first()[0]
    passes = min(PASSES, max(1, -(-entries // PASS_ENTRIES)))
    path, schema = table(spark, "cf"), T.StructType([T.StructField(c, T.LongType() if c != "score" else T.DoubleType()) for c in ("user_id", "item_id", "score", "rank")])
    for k in range(passes):
        share = F.lit(k)
        users = F.filter("users", lambda u: F.pmod(F.xxhash64(u), F.lit(passes)) == share)  # noqa: B023
        sent = near.select(F.explode(users).alias("user_id"), "item_id", "near", "sims").repartition("user_id").sortWithinPartitions("user_id", "item_id")
        append(sent.mapInArrow(_best_of(n), schema), path)
    drop(near)
    top = reread(spark, path, schema)
    seen = train.select("user_id", "item_id").distinct()
    per_user = seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_seen"))
    have = top.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_have"))
    lack = store(per_user.join(have, "user_id", "left").withColumn("n_have", F.coalesce("n_have", F.lit(0))).filter(F.col("n_have") < n), "lack")
    if lack.isEmpty():
        return top
    catalogue = prep.global_rank(seen.select("item_id").distinct(), ["item_id"], "place")
    stretch = lack.select("user_id", "n_have", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_seen") + n)).alias("place"))
    fill = stretch.join(catalogue, "place").join(seen, ["user_id", "item_id"], "left_anti").join(top.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    w = Window.partitionBy("user_id").orderBy("item_id")
    filled = fill.withColumn("rank", F.col("n_have") + F.row_number().over(w)).filter(F.col("rank") <= n)
    append(filled.select(F.col("user_id").cast("long").alias("user_id"), F.col("item_id").cast("long").alias("item_id"), F.lit(0.0).alias("score"), F.col("rank").cast("long").alias("rank")), path)
    return reread(spark, path, schema)


def item_idf(train: DataFrame) -> DataFrame:
    """(item_id, idf) = ln(users / (count + 1))."""
    n = train.agg(F.count_distinct("user_id").alias("n_users"))
    counts = train.groupBy("item_id").agg(F.count_distinct("user_id").alias("c"))
    return counts.join(F.broadcast(n)).select("item_id", F.log(F.col("n_users") / (F.col("c") + 1)).alias("idf"))


def profiles(train: DataFrame, vectors: DataFrame, max_history: int | None = 20, idf: bool = False, decay: bool = False, normalise: bool = True) -> DataFrame:
    """(user_id, profile): mean of the unit vectors of the last items, weighted if asked.

    The history is cut first and then reduced to items with a vector.  Decay is
    exp(-2 (1 - p)) with p from 0 (oldest) to 1 (newest) over what is left.
    """
    hist = prep.last_n(train, max_history).join(vectors.select("item_id", V.unit(F.col("vector")).alias("vector")), "item_id")
    hist = hist.withColumn("w", F.lit(1.0))
    if idf:
        hist = hist.join(item_idf(train), "item_id").withColumn("w", F.col("w") * F.col("idf"))
    if decay:
        w = Window.partitionBy("user_id")
        n, place = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(F.desc("age")))
        p = F.when(n > 1, (place - 1) / (n - 1)).otherwise(F.lit(1.0))
        hist = hist.withColumn("w", F.col("w") * F.exp(-2.0 * (1.0 - p)))
    mean = V.mean_vectors(hist, "user_id", "vector", "w")
    return mean.select("user_id", (V.unit(F.col("mean")) if normalise else F.col("mean")).alias("profile"))


def vector_recall(train: DataFrame, vectors: DataFrame, n: int = 50, max_history: int | None = 20, idf: bool = False, decay: bool = False) -> DataFrame:
    """(user_id, item_id, score, rank): cosine of the profile with every unseen item."""
    asked = profiles(train, vectors, max_history, idf, decay).select(F.col("user_id").alias("q"), F.col("profile").alias("vector"))
    items = vectors.select("item_id", V.unit(F.col("vector")).alias("vector"))
    seen = train.select(F.col("user_id").alias("q"), "item_id").distinct().join(vectors.select("item_id"), "item_id", "left_semi")
    return V.top_inner_products(asked, items, n, seen).withColumnRenamed("q", "user_id")


def merge_routes(cf: DataFrame, kg: DataFrame, n_cf: int = 70, n_kg: int = 50, n_total: int = 100, cf_only_users: bool = False) -> DataFrame:
    """Full outer merge of two ranked routes, then the CF part by score, then KG-only, cut at ``n_total``.

    (user_id, item_id, cf_score, kg_score, source, rank).  With ``cf_only_users``
    users without any KG row take ``n_total`` CF rows.
    """
    none = F.lit(None).cast("double")
    left = cf.filter(F.col("rank") <= (max(n_cf, n_total) if cf_only_users else n_cf))
    left = left.select("user_id", "item_id", F.col("score").alias("cf"), none.alias("kg"), F.col("rank").cast("long").alias("place"))
    right = kg.filter(F.col("rank") <= n_kg).select("user_id", "item_id", none.alias("cf"), F.col("score").alias("kg"), F.lit(None).cast("long").alias("place"))
    # dealt by user once: the sums and the windows below need no other exchange
    both = left.unionByName(right).repartition("user_id").groupBy("user_id", "item_id").agg(F.max("cf").alias("cf"), F.max("kg").alias("kg"), F.min("place").alias("place"))
    if cf_only_users:
        has = F.max(F.col("kg").isNotNull()).over(Window.partitionBy("user_id"))
        own = F.col("place") <= F.when(has, n_cf).otherwise(n_total)
        both = both.withColumn("cf", F.when(own, F.col("cf"))).filter("cf IS NOT NULL OR kg IS NOT NULL")
    merged = both.select(
        "user_id", "item_id", F.coalesce("cf", F.lit(0.0)).alias("cf_score"), F.coalesce("kg", F.lit(0.0)).alias("kg_score"),
        F.when(F.col("kg").isNull(), "cf").when(F.col("cf").isNull(), "kg").otherwise("both").alias("source"),
    )
    late = (F.col("source") == "kg").cast("int")
    w = Window.partitionBy("user_id").orderBy(late, F.desc(F.round(F.when(late == 1, F.col("kg_score")).otherwise(F.col("cf_score")), 6)), "item_id")
    return merged.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n_total)


def compensated_kg(cf: DataFrame, kg: DataFrame, n_cf: int = 70, n_kg: int = 50, n_total: int = 100, cap: int = 200) -> DataFrame:
    """KG rows, more than ``n_kg`` until the union with the CF rows reaches ``n_total``, at most ``cap``."""
    # users without KG rows give none: their CF rows need not travel
    own = cf.filter(F.col("rank") <= n_cf).select("user_id", "item_id", F.lit(1).alias("in_cf")).join(kg.select("user_id").distinct(), "user_id", "left_semi")
    n = own.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_cf"))
    rows = kg.filter(F.col("rank") <= cap).join(own, ["user_id", "item_id"], "left").join(n, "user_id")
    w = Window.partitionBy("user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col("in_cf").isNull(), 1).otherwise(0)).over(w), F.lit(0))
    return (
        rows.withColumn("fresh", before)
        .filter((F.col("rank") <= n_kg) | (F.col("n_cf") + F.col("fresh") < n_total))
        .select("user_id", "item_id", "score", "rank")
    )


def source_breakdown(candidates: DataFrame) -> DataFrame:
    """(source, n, pct, n_items): share of each source among the candidates."""
    by = candidates.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("n_items"))
    return by.select("source", "n", (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("pct"), "n_items")


def label(candidates: DataFrame, positives: DataFrame) -> DataFrame:
    """Adds ``label``: 1 where the pair is a positive.

    A user's positives are one row, so candidates are dealt by user, as the windows
    that follow need them.
    """
    pos = positives.groupBy("user_id").agg(F.collect_set("item_id").alias("p"))
    known = F.coalesce(F.array_contains("p", F.col("item_id")), F.lit(False))
    return candidates.join(pos, "user_id", "left").withColumn("label", known.cast("int")).drop("p")
