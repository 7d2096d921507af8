"""Toxicity by a factorization machine over hashed terms.

Terms of a text: its distinct lower-case words, the words' first three to seven
letters (stems), and stems that two or four distinct words share, hashed to
2**20 slots.  The machine has a bias, a weight per slot and a ``rank``-vector per
slot, so that pairs of terms interact.  Two kinds of slots enter it, at the
significance that leaves noise out over all slots and pairs:

* slots whose class counts differ by ``z`` standard deviations;
* both words of a pair that toxic rows share more often than either word's own
  share of toxic rows tells: chance would do so for any pair at all with a
  probability below ``chance`` (Chernoff's bound, over all pairs).  So an insult
  and a group mention enter even where each alone says nothing.  This test alone
  counts rows with one word-triple sketch (near copies, as a rule) once, since
  copies are no independent evidence; all of them train the machine.

Training rows: a bounded sample of labelled rows (``max_rows``, by hash of the
id) outside the held-out fold; rows of one class with the same slots count once.
Class counts are added up by Spark; only the sample's words and its chosen slots
reach the driver.  Every row's whole text is scored.

Defined results: null and empty texts get the bias's score; without training
rows of both classes every score is the share of toxic rows (0 without any);
an empty table gives no rows; rows that repeat are scored each; labels with a
null id or null class are ignored; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, remove, table, text_or_empty

SLOTS = 1 << 20
PREFIXES = (3, 4, 5, 6, 7)
#: A stem makes a further term once this many distinct words share it.
LEVELS = (2, 4)
_STEP = 0x9E377
_WORD = re.compile(r"[^\W_]+")
_CACHE_WORDS = 100_000
_SLICE = 256  # rows featurised at a time, which bounds a worker's memory
LEAST = 5  # rows that a term or a pair must be in to be tested


def word_slots(word: str) -> tuple[int, ...]:
    """The word's slot and those of its stems (which carry a mark of their own)."""
    raw = word.encode("utf-8", "surrogatepass")
    out = [crc32(raw) % SLOTS]
    if len(raw) == len(word):
        out += [crc32(b"\x00", crc32(raw[:n])) % SLOTS for n in PREFIXES if len(word) > n]
    else:
        out += [crc32(b"\x00", crc32(word[:n].encode("utf-8", "surrogatepass"))) % SLOTS for n in PREFIXES if len(word) > n]
    return tuple(out)


def level_slots(slot: int) -> list[int]:
    """The slot itself and its slots for each level."""
    return [(slot + k * _STEP) % SLOTS for k in range(len(LEVELS) + 1)]


def text_slots(tokens: list[str]) -> np.ndarray:
    """Sorted slots of a text."""
    count = Counter(s for w in set(tokens) for s in word_slots(w))
    out = [level_slots(s)[k] for s, n in count.items() for k, least in enumerate((1, *LEVELS)) if n >= least]
    return np.unique(np.array(out, np.int32))


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def pair_slots(toxic: list[np.ndarray], clean: list[np.ndarray], chance: float) -> np.ndarray:
    """Slots of word pairs that toxic rows share beyond what either word alone tells.

    Rows are bits, so a pair's counts are the ones of two bit strings' conjunction.
    """
    n1, n = len(toxic), len(toxic) + len(clean)
    if not n1 or n1 == n:
        return np.zeros(0, np.int64)
    flat = np.concatenate(toxic)
    slots = np.flatnonzero(np.bincount(flat, minlength=SLOTS) >= LEAST)
    place = np.full(SLOTS, -1)
    place[slots] = np.arange(len(slots))

    def bits(rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(slots), -(-len(rows) // 64) * 8), np.uint8)
        for r, own in enumerate(rows):
            at = place[own]
            out[at[at >= 0], r >> 3] |= 1 << (r & 7)
        return out.view(np.uint64)

    ones, zeros = bits(toxic), bits(clean)
    d1 = np.bitwise_count(ones).sum(1, dtype=np.int64)
    share = np.maximum(d1 / (d1 + np.bitwise_count(zeros).sum(1, dtype=np.int64)), n1 / n)
    chosen = np.zeros(len(slots), bool)
    need = np.log(max(1, len(slots) * (len(slots) - 1) / 2) / chance)
    for a in range(len(slots) - 1):
        both = np.bitwise_count(ones[a] & ones[a + 1 :]).sum(1, dtype=np.int64)
        own = np.minimum(np.maximum(share[a], share[a + 1 :]), 1 - 1e-9)
        able = np.flatnonzero((both >= LEAST) & (-both * np.log(own) >= need))  # if no clean row has both
        if len(able):
            all_ = both[able] + np.bitwise_count(zeros[a] & zeros[a + 1 + able]).sum(1, dtype=np.int64)
            r, q = own[able], np.minimum(both[able] / all_, 1 - 1e-12)
            apart = q * np.log(q / r) + (1 - q) * np.log((1 - q) / (1 - r))
            hit = able[(q > r) & (all_ * apart >= need)]
            if len(hit):
                chosen[a] = True
                chosen[a + 1 + hit] = True
    return slots[chosen]


def sketch(tokens: list[str]) -> int:
    """The smallest hash of the text's word triples."""
    return min(crc32(" ".join(tokens[k : k + 3]).encode("utf-8", "surrogatepass")) for k in range(max(1, len(tokens) - 2)))


def _once(sketches: np.ndarray, heads: list[np.ndarray]) -> list[np.ndarray]:
    """One row's words of each sketch, the first in order."""
    return [heads[i] for i in sorted(np.unique(sketches, return_index=True)[1])]


@dataclass
class Machine:
    """Bias, slot -> row, weights (k), vectors (k, rank)."""

    bias: float
    rows: dict[int, int]
    weight: np.ndarray
    vectors: np.ndarray

    def score(self, index: list[int]) -> float:
        raw = self.bias
        if index:
            v = self.vectors[index]
            raw += self.weight[index].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def fit(x: np.ndarray, y: np.ndarray, rank: int = 8, epochs: int = 30, rate: float = 0.02, decay: float = 1e-3, seed: int = 7, least_steps: int = 3000, drop_rows: float = 0.5, keep: float = 0.15):
    """Adam on the log loss of 0/1 rows ``x``; returns bias, weights, vectors.  Few rows are passed more often.

    Half of the rows of a batch lose most of their terms at random, so that one
    telling term suffices where training texts hold several.
    """
    rng = np.random.default_rng(seed)
    n, k = x.shape
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    par = [np.array([np.log(base / (1 - base))]), np.zeros(k), rng.normal(0, 0.02, (k, rank))]
    m1, m2, step = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par], 0
    epochs = max(epochs, -(-least_steps // max(1, -(-n // 256))))
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            pick = order[at : at + 256]
            xb, yb = x[pick].astype(np.float64), y[pick]  # x is 0/1 in bytes
            thin = rng.random(len(pick)) < drop_rows
            xb[thin] *= rng.random((int(thin.sum()), k)) < keep
            told = (yb == 0) | ~thin | xb.any(axis=1)  # a toxic row that lost all its terms says nothing
            xb, yb = xb[told], yb[told]
            s = xb @ par[2]
            raw = par[0] + xb @ par[1] + 0.5 * (s**2 - (xb**2) @ (par[2] ** 2)).sum(1)
            g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - yb) / max(1, len(yb))
            grads = [
                np.array([g.sum()]),
                xb.T @ g + decay * par[1] / 10,
                xb.T @ (g[:, None] * s) - ((xb**2).T @ g)[:, None] * par[2] + decay * par[2],
            ]
            step += 1
            for i, d in enumerate(grads):
                m1[i] = 0.9 * m1[i] + 0.1 * d
                m2[i] = 0.999 * m2[i] + 0.001 * d * d
                par[i] = par[i] - rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
    return float(par[0][0]), par[1], par[2]


def _gathered(rows: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """Numbers and slot lists of at most ``max_rows`` rows, in an order of their own, without a Python object per slot."""
    got = rows.toArrow().combine_chunks()
    if not got.num_rows:
        return np.zeros(0, np.int64), []
    lists = got.column(1).chunk(0)
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    y = got.column(0).to_numpy()
    own = [np.sort(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    order = sorted(range(len(y)), key=lambda i: (y[i], own[i].tobytes()))
    return y[order], [own[i] for i in order]


def train(
    docs: DataFrame, labels: DataFrame, max_rows: int = 16_384, z: float = 5.3, chance: float = 1e-6, id_col: str = "doc_id", text_col: str = "text"
) -> Machine:
    """Fit on ``labels`` (id, toxic), at most ``max_rows`` of them."""
    sample = (
        labels.filter("id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_rows)
    )
    texts = docs.select(F.col(quoted(id_col)).alias("doc"), text_or_empty(quoted(text_col)).alias("t"))
    joined = texts.join(F.broadcast(sample), texts.doc == sample.id).select("toxic", "t")  # bounded by max_rows

    def lists(rows: list[np.ndarray]) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, rows)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, _SLICE):
                part = batch.slice(k, _SLICE)
                y, near, heads, slots = [], [], [], []
                for label, t in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    tokens = words(t.as_py())
                    y.append(int(label))
                    near.append(sketch(tokens))
                    heads.append(np.unique(np.array([word_slots(w)[0] for w in set(tokens)], np.int32)))
                    slots.append(text_slots(tokens))
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(near, pa.int64()), lists(heads), lists(slots)], names=["y", "near", "heads", "slots"])

    made, path = table(joined.mapInArrow(features, "y int, near bigint, heads array<int>, slots array<int>"), "toxic-sample")
    rows, path2 = table(made.groupBy("y", "slots").agg(F.min("near").alias("near"), F.min("heads").alias("heads")), "toxic-rows")
    remove(docs.sparkSession, path)
    n, n1 = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n or not 0 < n1 < n:
        share = n1 / n if n else 0.0
        logit = float(np.log(share / (1 - share))) if 0 < share < 1 else (30.0 if share else -30.0)
        return Machine(logit, {}, np.zeros(0), np.zeros((0, 1)))
    p = n1 / n
    counts = rows.select("y", F.explode("slots").alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("d"), F.sum("y").alias("d1"))
    gap = F.abs(F.col("d1") - F.col("d") * p) / F.sqrt(F.col("d") * F.lit(p * (1 - p)))
    alone = {r.slot for r in counts.filter((F.col("d") >= LEAST) & (gap >= z)).select("slot").collect()}
    classes = []
    for kind in (1, 0):
        near, heads = _gathered(rows.filter((F.col("y") > 0) == bool(kind)).select("near", "heads"))
        classes.append(_once(near, heads))
    paired = pair_slots(*classes, chance)
    chosen = sorted(alone | set(paired.tolist()))
    if not chosen:
        return Machine(float(np.log(p / (1 - p))), {}, np.zeros(0), np.zeros((0, 1)))
    del classes, heads, paired
    place = np.array(chosen)
    keep = F.array_intersect("slots", F.array(*[F.lit(s) for s in chosen]).cast("array<int>"))
    y, slots = _gathered(rows.select("y", keep.alias("slots")))
    remove(docs.sparkSession, path2)
    x = np.zeros((len(y), len(chosen)), np.uint8)
    for i, own in enumerate(slots):
        x[i, np.searchsorted(place, own)] = 1
    bias, weight, vectors = fit(x, y.astype(np.float64))
    return Machine(bias, {s: i for i, s in enumerate(chosen)}, weight, vectors)


class Scorer:
    """Scores texts; remembers the model rows of words met before, up to a bound."""

    def __init__(self, machine: Machine):
        self.machine, self.known = machine, {}
        self.roots = {(x - k * _STEP) % SLOTS for x in machine.rows for k in range(len(LEVELS) + 1)}

    def __call__(self, text: str) -> float:
        rows, known, roots, hit = self.machine.rows, self.known, self.roots, Counter()
        for w in set(words(text)):
            found = known.get(w)
            if found is None:
                if len(known) >= _CACHE_WORDS:
                    known.clear()
                found = known[w] = tuple(s for s in word_slots(w) if s in roots)
            if found:
                hit.update(found)
        index = {rows[x] for s, n in hit.items() for x, least in zip(level_slots(s), (1, *LEVELS), strict=True) if n >= least and x in rows}
        return self.machine.score(sorted(index))


_LAST: list[Scorer] = []


def scorer_of(machine: Machine) -> Scorer:
    """The worker's scorer: tasks that follow one another share the words met."""
    if not _LAST or _LAST[0].machine is not machine:
        _LAST[:] = [Scorer(machine)]
    return _LAST[0]


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row, from the text alone."""
    rows = docs.select(F.col(quoted(id_col)).alias("id"), text_or_empty(quoted(text_col)).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # a few thousand numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared.value)
        for batch in batches:
            out = [scorer(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def held_out(id_column: Column) -> Column:
    """The held-out fold: crc32 of the id as text, modulo 5, is 0."""
    return F.pmod(F.crc32(F.encode(id_column.cast("string"), "UTF-8")), F.lit(5)) == 0


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), F.col("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows whose score is below ``threshold``, all columns; scored in one pass over the rows.

    The text travels through Python once more here: the verdict is computed next
    to the row, so nothing has to be joined or shuffled.
    """
    machine = train(docs, training_labels(labels), id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared.value)
        for batch in batches:
            fine = [scorer(t.as_py() or "") < threshold for t in batch.column(at)]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
