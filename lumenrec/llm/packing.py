"""Best-fit packing of documents into fixed-length sequences.

1. Tokenise: a document is its ids plus the end id.  Documents over ``size`` are
   cut into pieces of exactly ``size``, the first piece taking the rest.  Places
   and lengths are written to the shared folder, tokens never travel.
2. Full pieces are sequences of their own.  The others are dealt into groups of
   about ``group_rows`` by a hash of their stored row number, so rows that repeat
   spread too; each group is packed in one bounded task.
3. In a group: best-fit decreasing, then swap-based local search.  Underfull
   bins exchange one piece for one, one for two, two for one, or move one or two,
   always such that the sum of squared fills grows, so that the emptiest bins
   drain and vanish.  The search ends when no exchange of any two underfull bins
   gains, or when no packing can have fewer bins.

More groups cost less than one extra sequence each.

Defined results: a null or empty text is its end id alone; rows that repeat are
packed each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_bpe
from .common import cut, quoted, text_or_empty

SIZE, END_ID = 1024, 2


def cut_points(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; the first takes the rest."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, row), a row per piece; ``row`` numbers the pieces of all partitions."""
    rows = docs.select(F.col(quoted(id_col)).alias("id"), text_or_empty(quoted(text_col)).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                ids = np.append(byte_bpe.ids(t.as_py()), np.uint32(end_id)).astype("<u4")
                for k, (s, n) in enumerate(cut_points(len(ids), size)):
                    at.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(crc32(ids[s : s + n].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(crc, pa.int64()), pa.array(np.arange(row, row + len(at)))],
                names=["id", "piece", "start", "length", "ids_crc32", "row"],
            )
            row += len(at)

    return rows.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, row bigint")


# ---------------------------------------------------------------- one group


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Best-fit decreasing; bit ``r`` of ``open_`` says that a bin with ``r`` left exists."""
    bins: list[list[int]] = []
    by_left: list[list[int]] = [[] for _ in range(size + 1)]
    open_ = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_ >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = by_left[left].pop()
            if not by_left[left]:
                open_ &= ~(1 << left)
            bins[b].append(i)
        else:
            b, left = len(bins), size
            bins.append([i])
        left -= n
        by_left[left].append(b)
        open_ |= 1 << left
    return bins


class Search:
    """Swap-based local search over the underfull bins of a group.

    A taker gives nothing, one piece or two pieces and takes one or two pieces of
    one donor, such that its fill grows by at most its gap.  Donors are all
    underfull bins that the taker's new fill exceeds, so the sum of squared fills
    grows with every exchange and the search ends by itself.  Lengths are bits of
    an integer: ``one`` holds the lengths of donors' pieces, ``two`` the sums of
    two pieces of one donor, so the best exchange is a shift and a mask for each
    length that the taker could give.  No exchange is left out.
    """

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], size: int):
        self.length = lengths.tolist()
        self.size = size
        self.bins = bins
        self.fill = [sum(self.length[i] for i in b) for b in bins]
        self.count = sum(map(bool, bins))

    def _sums(self, b: int) -> tuple[int, int]:
        """Bits of the bin's lengths and of its sums of two pieces."""
        one = two = 0
        for i in self.bins[b]:
            n = self.length[i]
            two |= one << n
            one |= 1 << n
        return one, two

    def _enter(self, b: int) -> None:
        """Offers the bin's lengths and sums as a donor's."""
        self.version[b] = self.version.get(b, 0) + 1
        tag = (self.fill[b], b, self.version[b])
        for kind, bits in enumerate(self._sums(b)):
            self.open[kind] |= bits
            while bits:
                low = bits & -bits
                heappush(self.where[kind].setdefault(low.bit_length() - 1, []), tag)
                bits ^= low

    def _donor(self, kind: int, n: int, taker: int, limit: int) -> int | None:
        """The emptiest donor with a piece (a sum) of ``n`` whose fill is below ``limit``; stale entries go."""
        heap = self.where[kind].get(n, [])
        aside = []
        found = None
        while heap:
            fill, b, version = heap[0]
            if self.version.get(b) != version:
                heappop(heap)
            elif fill >= limit:
                break
            elif b == taker:
                aside.append(heappop(heap))
            else:
                found = b
                break
        for tag in aside:
            heappush(heap, tag)
        if not heap:
            self.open[kind] &= ~(1 << n)
        return found

    def _give(self, taker: int) -> list[tuple[int, int]]:
        """(kind, sum) of what the taker could give: nothing, a piece, two pieces."""
        one, two = self._sums(taker)
        out = [(0, 0)]
        for kind, bits in ((1, one), (2, two)):
            while bits:
                low = bits & -bits
                out.append((kind, low.bit_length() - 1))
                bits ^= low
        return out

    def _best(self, taker: int) -> tuple[int, int, int, int, int] | None:
        """(gain, give kind, give sum, take kind, donor and sum) of the best exchange."""
        gap = self.size - self.fill[taker]
        best, chosen = 0, None
        for given, own in self._give(taker):
            for kind in (0, 1) if given < 2 else (0,):  # two for two is not a move of this search
                reach = self.open[kind] & ((1 << own + gap + 1) - 1)
                while (n := reach.bit_length() - 1) - own > best:
                    donor = self._donor(kind, n, taker, self.fill[taker] + n - own)
                    if donor is not None:
                        best, chosen = n - own, (given, own, kind, n, donor)
                        break
                    reach &= ~(1 << n)
            if best == gap:
                break
        return chosen

    def _pick(self, b: int, kind: int, total: int) -> list[int]:
        """A piece (kind 0), or two, of the bin with that total length."""
        if kind == 0:
            return [next(i for i in self.bins[b] if self.length[i] == total)]
        seen: dict[int, int] = {}
        for i in self.bins[b]:
            if (other := seen.get(total - self.length[i])) is not None:
                return [other, i]
            seen[self.length[i]] = i
        raise AssertionError("no two pieces of that sum")

    def _exchange(self, taker: int, given: int, own: int, kind: int, n: int, donor: int) -> None:
        give = self._pick(taker, given - 1, own) if given else []
        take = self._pick(donor, kind, n)
        for b, out, into in ((taker, give, take), (donor, take, give)):
            for i in out:
                self.bins[b].remove(i)
            self.bins[b] += into
        self.fill[taker] += n - own
        self.fill[donor] -= n - own
        if not self.bins[donor]:
            self.count -= 1
            self.version[donor] += 1
        else:
            self._enter(donor)
        if self.fill[taker] < self.size:
            self._enter(taker)
        else:
            self.version[taker] += 1

    def run(self) -> list[list[int]]:
        least = -(-sum(self.length) // self.size)
        gained = True
        while gained and self.count > least:
            gained = False
            self.open, self.where, self.version = [0, 0], ({}, {}), {}
            under = sorted((b for b in range(len(self.bins)) if self.bins[b] and self.fill[b] < self.size), key=lambda b: self.fill[b])
            for b in under:
                self._enter(b)
            for taker in reversed(under):
                while self.bins[taker] and self.fill[taker] < self.size and (found := self._best(taker)):
                    self._exchange(taker, *found)
                    gained = True
        return [b for b in self.bins if b]


def pack(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(bin number, offset) of each piece."""
    bins = best_fit(lengths, size)
    if len(bins) > -(-int(lengths.sum()) // size):
        bins = Search(lengths, bins, size).run()
    number, offset = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
    for k, b in enumerate(bins):
        at = 0
        for i in b:
            if number[i] >= 0:
                raise RuntimeError(f"piece {i} was placed twice")
            number[i], offset[i] = k, at
            at += int(lengths[i])
        if at > size:
            raise RuntimeError(f"a sequence of {at} tokens")
    if (number < 0).any():
        raise RuntimeError(f"{int((number < 0).sum())} pieces were not placed")
    return number, offset


# ---------------------------------------------------------------- all groups


def pack_documents(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, group_rows: int = 40_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece.

    Row numbers are fixed by the stored table, so a lost task deals alike again.
    """
    rows = cut(pieces(docs, size, end_id, id_col, text_col), "pieces")
    kept = ["id", "piece", "start", "length", "ids_crc32"]
    full = rows.filter(F.col("length") == size).select(*kept, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    partial = rows.filter(F.col("length") < size)
    groups = max(1, -(-partial.count() // group_rows))
    dealt = partial.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups))).drop("row")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        number, offset = pack(pdf["length"].to_numpy(), size)
        pdf["sequence_id"] = (pdf["g"].to_numpy() << 32) + number
        pdf["offset"] = offset
        return pdf.drop(columns="g")

    return full.unionByName(dealt.groupBy("g").applyInPandas(run, full.schema))
