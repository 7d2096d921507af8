"""SimHash near-dedup with a generalised pigeonhole search.

Fingerprints: A-Z lowered, words between ASCII white space, ``width``-word
shingles with repeats, XXH64 (seed 42); a bit is 1 if set in over half the
hashes.  A text without words has fingerprint zero.

Search for all pairs of distinct fingerprints at ``radius`` or fewer differing
bits, exact:

1. Bits are grouped so that correlated ones meet in one partition (statistics
   over all fingerprints), and a dynamic programme gives each partition an own
   threshold t_i with sum t_i = radius - m + 1 (-1: not probed), minimising the
   estimated cost of candidates and probes; the number m of partitions is the
   cheapest one.  By the generalised pigeonhole principle a linked pair is within
   t_i on some partition i.
2. Probe: each fingerprint emits its partition value's neighbours such that two
   values within t_i share a key.  The fingerprints of a key beyond ``block`` are
   dealt into blocks, and each pair of blocks is a join key of its own, so no
   task holds a hot key whole.
3. Verify: pairs under a key with ``radius`` or fewer differing bits are links.
   At most 2,081 distinct 64-bit values are within 4 bits of one another, so
   dense groups have links in proportion to their size.

Components over the links give each document the smallest doc_id that it
reaches.

Defined results: null text is empty text; an empty table gives no rows; rows
that repeat stay repeated and share a component; a null doc_id is larger than
any other; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted, row_keys, text_or_empty, without
from .components import components

SEED = 42
_STEP = 1 << 16


def fingerprint(text: str, width: int = 4) -> int:
    """The 64-bit fingerprint of one text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hash64 = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    for k in range(0, len(starts), _STEP):
        spans = zip(starts[k : k + _STEP].tolist(), ends[k : k + _STEP].tolist(), strict=True)
        h = np.array([hash64(joined[s:e], SEED) for s, e in spans], dtype="<u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * set_bits > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, key_col: str | None = None) -> DataFrame:
    """(id, fp bigint, key): fp holds the unsigned fingerprint's bits, key is ``key_col`` or the id."""
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(key_col or id_col)).alias("key"), text_or_empty(quoted(text_col)).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), width) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), batch.column(1)], names=["id", "fp", "key"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "key")}
    return rows.mapInArrow(run, f"id {kinds['id']}, fp bigint, key {kinds['key']}")


# ---------------------------------------------------------------- planning


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """(count, 64 x 64 joint counts of set bits) over all distinct fingerprints.

    Tasks send 64 rows of 64 numbers each; Spark adds them up.
    """

    def run(batches):
        joint, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            v = batch.column(0).to_numpy().view(np.uint64)
            bits = ((v[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            joint += (bits.T @ bits).astype(np.int64)
            n += len(v)
        i, j = np.divmod(np.arange(4096), 64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, 64)), pa.array(np.append(j, 0)), pa.array(np.append(joint.ravel(), n))], names=["i", "j", "c"]
        )

    rows = distinct.mapInArrow(run, "i bigint, j bigint, c bigint").groupBy("i", "j").agg(F.sum("c").alias("c")).collect()
    joint, n = np.zeros((64, 64)), 0
    for i, j, c in rows:
        if i == 64:
            n = int(c)
        else:
            joint[i, j] = c
    return n, joint


def group_bits(n: int, joint: np.ndarray, parts: int) -> list[list[int]]:
    """Greedy grouping: each partition grows by the bit most correlated with it."""
    p = np.diag(joint) / max(n, 1)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    cov = joint / max(n, 1) - np.outer(p, p)
    corr = np.abs(np.divide(cov, spread, out=np.zeros_like(cov), where=spread > 0))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    sizes = [64 // parts + (k < 64 % parts) for k in range(parts)]
    for size in sizes:
        own = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < size:
            nxt = max(left, key=lambda b: (corr[b, own].sum(), -b))
            own.append(nxt)
            left.remove(nxt)
        groups.append(sorted(own))
    return groups


def keys_per_row(bits: int, threshold: int) -> int:
    """Keys that one fingerprint emits for a partition (see ``key_masks``)."""
    if threshold < 0:
        return 0
    r, odd = divmod(threshold, 2)
    return bits * sum(comb(bits - 1, k) for k in range(r + 1)) if odd else sum(comb(bits, k) for k in range(r + 1))


#: What a probe row costs (made, shuffled, sorted) in units of one candidate pair compared.
PROBE_COST = 30.0


def allocate(n: int, joint: np.ndarray, groups: list[list[int]], radius: int) -> tuple[float, list[int]]:
    """(estimated cost, thresholds) by dynamic programming over partitions and the threshold budget."""
    same = np.diag(joint) / max(n, 1)
    agree = same**2 + (1 - same) ** 2
    budget = radius - len(groups) + 1

    def cost(group: list[int], t: int) -> float:
        if t < 0:
            return 0.0
        within = np.zeros(len(group) + 1)
        within[0] = 1.0
        for b in group:  # distribution of the number of differing bits
            within[1:] = within[1:] * agree[b] + within[:-1] * (1 - agree[b])
            within[0] *= agree[b]
        return n * n / 2 * within[: t + 1].sum() + PROBE_COST * n * keys_per_row(len(group), t)

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for t in range(-1, radius + 1):
                if (now := total + cost(group, t)) < step.get(used + t, (np.inf, []))[0]:
                    step[used + t] = (now, [*chosen, t])
        best = step
    return best[budget]


def plan(n: int, joint: np.ndarray, radius: int, parts: int | None = None) -> tuple[list[list[int]], list[int]]:
    """(bit groups, thresholds); of one to ``radius`` + 1 partitions the cheapest number, unless it is given."""
    tried = []
    for m in range(1, radius + 2) if parts is None else [parts]:
        groups = group_bits(n, joint, m)
        cost, thresholds = allocate(n, joint, groups, radius)
        tried.append((cost, groups, thresholds))
    return min(tried, key=lambda t: t[0])[1:]


def key_masks(bits: list[int], threshold: int) -> list[tuple[int, int, int]]:
    """(tag, bits to clear, bits to flip) whose keys two values within ``threshold`` must share.

    For an even threshold 2r both values reach a common centre by r flips or
    fewer.  For an odd one a cleared bit takes the odd difference: the pair
    shares the key with that bit cleared and a common centre of the others.
    """
    r, odd = divmod(threshold, 2)
    out = []
    for c in bits if odd else [None]:
        clear = 0 if c is None else 1 << c
        rest = [b for b in bits if b != c]
        for k in range(r + 1):
            out += [(0 if c is None else c + 1, clear, sum(1 << b for b in flips)) for flips in combinations(rest, k)]
    return out


# ---------------------------------------------------------------- search


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _variants(masks: list[tuple[int, int, int, int]]):
    """Explodable array of (tag, key) of the column ``fp``: ((fp & keep) ^ flip)."""
    return F.explode(
        F.transform(
            F.array(*[F.struct(F.lit(tag).alias("tag"), F.lit(_signed(keep)).alias("keep"), F.lit(_signed(flip)).alias("flip")) for tag, keep, flip in masks]),
            lambda m: F.struct(m["tag"].alias("tag"), F.col("fp").bitwiseAND(m["keep"]).bitwiseXOR(m["flip"]).alias("key")),
        )
    )


_ROWS_PER_TASK = 16_384


def _spread(df: DataFrame, n: int) -> DataFrame:
    """Rows over enough tasks for what is about to be emitted from each of them."""
    return df.repartition(1 + n // _ROWS_PER_TASK, "fp")


def links(distinct: DataFrame, radius: int = 4, parts: int | None = None, block: int = 4096) -> DataFrame:
    """(a, b), a < b: all pairs within ``radius`` bits, repeated where several keys find one."""
    n, joint = bit_statistics(distinct)
    masks = []
    for k, (group, t) in enumerate(zip(*plan(n, joint, radius, parts), strict=True)):
        inside = sum(1 << b for b in group)
        if t >= 0:
            masks += [(k * 128 + tag, inside & ~clear, flip) for tag, clear, flip in key_masks(group, t)]
    probes = _spread(distinct, n).select("fp", _variants(masks).alias("k")).select("fp", "k.tag", "k.key")
    size = probes.groupBy("tag", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    hot = cut(size.select("tag", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "hot")
    left = probes.select("tag", "key", F.col("fp").alias("a"))
    right = probes.select("tag", "key", F.col("fp").alias("b"))
    if hot.isEmpty():
        pairs = left.join(right, ["tag", "key"])
    else:
        # A fingerprint of block i meets blocks j >= i from the left and j <= i from the right.
        def dealt(side: DataFrame, fp: str, from_left: bool) -> DataFrame:
            last = F.coalesce("blocks", F.lit(1)) - 1
            own = F.pmod(F.xxhash64(fp), last + 1).cast("int")
            other = F.explode(F.sequence(own, last) if from_left else F.sequence(F.lit(0), own)).alias("other")
            rows = side.join(hot, ["tag", "key"], "left").select("tag", "key", fp, own.alias("own"), other)
            return rows.select("tag", "key", fp, *[F.col(c).alias(x) for c, x in zip(("own", "other") if from_left else ("other", "own"), ("i", "j"), strict=True)])

        pairs = dealt(left, "a", True).join(dealt(right, "b", False), ["tag", "key", "i", "j"])
    near = pairs.filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    both = near if not hot.isEmpty() else near.filter("a < b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, parts: int | None = None, key_col: str | None = None) -> DataFrame:
    """A row per document: id, fp (bigint bits), component_id, and ``key_col`` as ``key`` if it is given."""
    rows = cut(fingerprints(docs, id_col, text_col, width, key_col), "fingerprints")
    per_fp = cut(rows.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    labels = components(links(per_fp.select("fp"), radius, parts))
    rooted = per_fp.join(labels, per_fp.fp == labels.v, "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    low = rooted.groupBy("label").agg(F.min("low").alias("component_id"))
    return rows.join(rooted.join(low, "label").select("fp", "label", "component_id"), "fp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, parts: int | None = None) -> DataFrame:
    """A row per document: id, fp (bigint bits), component_id."""
    return near_rows(docs, id_col, text_col, width, radius, parts).select("id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays: the one with the smallest id, all columns.

    A null id is larger than any other.  Of rows that share the smallest id, null
    or not, the first stored one stays.  Only the keys of the dropped rows travel:
    the identifier, or a stored row number where identifiers are null or repeat.
    """
    rows, key = row_keys(docs, id_col)
    found = cut(near_rows(rows, id_col, text_col, key_col=key).select("label", "id", "key"), "near")
    stays = found.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("s")).select(F.col("s.key").alias("kept"))
    dropped = cut(found.join(stays, found["key"] == stays["kept"], "left_anti").select("key"), "dropped")
    return without(rows, key, dropped).select(*[F.col(quoted(c)) for c in docs.columns])
