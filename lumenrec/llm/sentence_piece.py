"""SentencePiece encoding and decoding by a batched numpy Viterbi.

The model is a byte-fallback BPE model.  Its encoding has a Viterbi form: a
sequence of pieces is the BPE encoding of its text exactly if each piece is one
by itself and each neighbouring pair stays apart when encoded together, and each
prefix of a word has one such last piece.  So one pass over a word's positions
finds, among the pieces that end there, the one that is compatible with the best
piece before it.  Its ids are the library's.

Words of equal length advance together.  Rolling hashes of substrings probe the
sorted keys of all pieces of that length; compatibility of the hits is looked up
in a table of piece pairs; a vectorised maximum over candidate lengths stores
the backpointer.  Each word met is kept, up to a bound, as its ids, for all tasks
of a worker.  A long word is first cut between neighbours that no piece holds
side by side, which no merge can cross.

Text is prefixed with one space, spaces become U+2581, and words begin at spaces;
line ends and tabs, which no piece holds, also part words.  Runs of spaces,
whose pieces tie in score, follow the library's leftmost rule.

Defined results: null and empty texts have no pieces; a literal U+2581 reads
back as a space, as in the library; characters outside the vocabulary become
byte pieces; an empty table gives no rows; rows that repeat are done each; other
columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, text_or_empty

SPACE = "▁"
_UNITS = re.compile(f"{SPACE}+(?={SPACE})|{SPACE}?[^{SPACE}\n\t]+|[\n\t]|{SPACE}")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_UNKNOWN = -2  # a character outside the vocabulary
_KEPT_WORDS = 300_000
_LONG = 64  # characters beyond which a word is cut at sure borders
_SLICE = 1024  # rows whose new words are encoded together


@dataclass
class Vocabulary:
    pieces: list[str]  # by id; '' for control pieces
    fallback: list[int]  # id of each byte's piece
    rank: np.ndarray  # merge order; -1 for single characters
    left: np.ndarray  # the pair whose merge makes a piece
    right: np.ndarray
    keys: list[np.ndarray]  # by length: sorted hashes
    ids: list[np.ndarray]  # by length: ids in that order
    pair_keys: np.ndarray  # sorted left * V + right of all pairs that join to a piece
    pair_rank: np.ndarray
    neighbours: frozenset[str]  # characters that stand side by side in some piece

    @property
    def size(self) -> int:
        return len(self.pieces)


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """(n, L + 1) hashes of all prefixes of the rows, modulo 2**64."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * _PRIME + (codes[:, j].astype(np.uint64) + np.uint64(1))
    return out


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    for k in range(n):
        out[k + 1 :] *= _PRIME  # arrays wrap silently
    return out


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, (n, L)."""
    raw = "".join(words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, "<u4").reshape(len(words), -1)


def greedy(symbols: list[str], order: dict[str, tuple[float, int]]) -> list[str]:
    """Plain merging, best score first, leftmost on ties; for table building and runs of spaces."""
    symbols = list(symbols)
    while True:
        best = None
        for k in range(len(symbols) - 1):
            at = order.get(symbols[k] + symbols[k + 1])
            if at is not None and (best is None or at[0] > best[0]):
                best = (at[0], k)
        if best is None:
            return symbols
        k = best[1]
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]


@functools.lru_cache(2)
def load(path: str | None = None) -> Vocabulary:
    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    n = sp.vocab_size()
    pieces, fallback, score = [], [0] * 256, {}
    for i in range(n):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            fallback[int(p[3:5], 16)] = i
        if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            pieces.append("")
        else:
            pieces.append(p)
            score[p] = (sp.get_score(i), i)
    number = {p: i for p, (_, i) in score.items()}
    rank = np.full(n, -1, np.int64)
    merged = [p for p in score if len(p) > 1]
    for k, p in enumerate(sorted(merged, key=lambda p: (-score[p][0], score[p][1]))):
        rank[number[p]] = k
    left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    pairs: dict[int, int] = {}
    for p in merged:
        if set(p) == {SPACE}:
            continue
        i = number[p]
        others = {q: score[q] for a in range(len(p)) for b in range(a + 2, len(p) + 1) if (q := p[a:b]) in score and q != p}
        parts = greedy(list(p), others)
        if len(parts) == 2 and parts[0] in number and parts[1] in number:
            left[i], right[i] = number[parts[0]], number[parts[1]]
        else:
            rank[i] = 1 << 40  # no merge ever makes this piece
            continue
        for k in range(1, len(p)):
            a, b = number.get(p[:k]), number.get(p[k:])
            if a is not None and b is not None:
                pairs[a * n + b] = i
    made = np.array(sorted(pairs), np.int64)
    keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for length in range(1, max(map(len, pieces)) + 1):
        own = [i for i, p in enumerate(pieces) if len(p) == length and rank[i] < 1 << 40]
        h = prefix_hashes(_codes([pieces[i] for i in own]))[:, -1] if own else np.zeros(0, np.uint64)
        by = np.argsort(h)
        if len(np.unique(h)) != len(h):
            raise ValueError("two pieces share a hash")
        keys.append(h[by])
        ids.append(np.array(own, np.int64)[by])
    return Vocabulary(pieces, fallback, rank, left, right, keys, ids, made, rank[[pairs[k] for k in made.tolist()]], frozenset(p[k : k + 2] for p in pieces for k in range(len(p) - 1)))


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.words: dict[str, bytes] = {}
        self.runs: dict[int, bytes] = {}
        self.space_order = {p: (-1.0, i) for i, p in enumerate(vocabulary.pieces) if p and set(p) == {SPACE} and len(p) > 1}
        self.number = {p: i for i, p in enumerate(vocabulary.pieces) if p}
        self.lone_space = np.array([self.number[SPACE]], "<u2").tobytes()
        self.bytes_of = [p.replace(SPACE, " ").encode() for p in vocabulary.pieces]
        for b, i in enumerate(vocabulary.fallback):
            self.bytes_of[i] = bytes([b])
        bits = 20
        self.memo_mask = (1 << bits) - 1
        self.memo_key = np.full(1 << bits, -1, np.int64)
        self.memo_value = np.zeros(1 << bits, bool)

    # -------------------------------------------------- compatibility

    def _joined_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.v.size + b
        at = np.searchsorted(self.v.pair_keys, key)
        at[at == len(self.v.pair_keys)] = 0
        return np.where(self.v.pair_keys[at] == key, self.v.pair_rank[at], 1 << 50)

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pair stays apart: no merge across its border at any time.

        Going back in time, the piece that was made last is taken apart first;
        the neighbours at the border then existed until that merge, so a joining
        merge of lower rank (of equal rank too, if it stands further left) would
        have come before it.
        """
        v = self.v
        ok = self._joined_rank(a, b) == 1 << 50
        live = np.flatnonzero(ok & ((v.rank[a] >= 0) | (v.rank[b] >= 0)))
        a, b = a.copy(), b.copy()
        while len(live):
            x, y = a[live], b[live]
            rx, ry = v.rank[x], v.rank[y]
            undo_left = rx > ry
            limit = np.where(undo_left, rx, ry + 1)
            x2, y2 = np.where(undo_left, v.right[x], x), np.where(undo_left, y, v.left[y])
            fine = self._joined_rank(x2, y2) >= limit
            ok[live] = fine
            a[live], b[live] = x2, y2
            live = live[fine & ((v.rank[x2] >= 0) | (v.rank[y2] >= 0))]
        return ok

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_apart`` through a direct-mapped memo of pairs met before."""
        ok = (a < 0) | (b < 0)  # a start or an unknown character never joins
        todo = np.flatnonzero(~ok)
        if len(todo):
            key = a[todo] * self.v.size + b[todo]
            slot = (key * 0x2545F491 >> 12) & self.memo_mask
            known = self.memo_key[slot] == key
            out = self.memo_value[slot]
            if not known.all():
                fresh, back = np.unique(key[~known], return_inverse=True)
                value = self._apart(fresh // self.v.size, fresh % self.v.size)
                out[~known] = value[back]
                at = (fresh * 0x2545F491 >> 12) & self.memo_mask
                self.memo_key[at], self.memo_value[at] = fresh, value
                keep = self.memo_key[at] == fresh  # of pairs in one slot the last stays, with its value
                self.memo_value[at[keep]] = value[keep]
            ok[todo] = out
        return ok

    # -------------------------------------------------- Viterbi

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of words of one length, their pieces from right to left and how many (-2 - code point: unknown character)."""
        v, n = self.v, len(words)
        codes = _codes(words)
        length = codes.shape[1]
        h, power = prefix_hashes(codes), _powers(len(v.keys))
        last = np.full((n, length + 1), -1, np.int64)
        back = np.zeros((n, length + 1), np.int32)
        for j in range(1, length + 1):
            reach = np.zeros(n, np.int32)
            for k in range(1, min(j, len(v.keys) - 1) + 1):
                sub = h[:, j] - h[:, j - k] * power[k]
                keys = v.keys[k]
                if not len(keys):
                    continue
                at = np.searchsorted(keys, sub)
                at[at == len(keys)] = 0
                hit = keys[at] == sub
                ids = np.where(hit, v.ids[k][at], _UNKNOWN if k == 1 else -1)
                hit = np.flatnonzero(hit) if k > 1 else np.arange(n)
                if not len(hit):
                    continue
                fits = hit[self.compatible(last[hit, j - k], ids[hit])]
                fits = fits[k > reach[fits]]  # the vectorised maximum
                reach[fits] = k
                last[fits, j] = ids[fits]
            back[:, j] = reach
            if not reach.all():
                raise AssertionError("a prefix without an encoding")
        found = np.zeros((n, length), np.int64)  # pieces from the right end, in reverse
        count = np.zeros(n, np.int64)
        place = np.full(n, length, np.int64)
        live = np.arange(n)
        step = 0
        while len(live):
            at = place[live]
            got = last[live, at]
            found[live, step] = np.where(got == _UNKNOWN, -2 - codes[live, at - 1].astype(np.int64), got)
            count[live] += 1
            place[live] = at - back[live, at]
            live = live[place[live] > 0]
            step += 1
        return found, count

    def _segments(self, word: str) -> list[str]:
        """The word cut wherever no piece holds both neighbours."""
        near = self.v.neighbours
        cuts = [0, *[k for k in range(1, len(word)) if word[k - 1 : k + 1] not in near], len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, words: list[str]) -> None:
        cut = {w: self._segments(w) for w in words if len(w) > _LONG}
        fresh = {w for w in words if w not in cut}.union(*cut.values()).difference(self.words)
        by_length: dict[int, list[str]] = {}
        for w in fresh:
            by_length.setdefault(len(w), []).append(w)
        for length, same in by_length.items():
            step = max(1, min(20_000, (1 << 21) // (length + 1)))
            for k in range(0, len(same), step):
                self._keep(same[k : k + step], *self.viterbi(same[k : k + step]))
        for w, parts in cut.items():
            self.words[w] = b"".join([self.words[x] for x in parts])

    def _keep(self, words: list[str], found: np.ndarray, count: np.ndarray) -> None:
        """Stores each word's ids as bytes, and checks that the pieces spell the words."""
        width = found.shape[1]
        column = count[:, None] - 1 - np.arange(width)
        inside = column >= 0
        flat = np.take_along_axis(found, np.maximum(column, 0), axis=1)[inside]  # left to right, word after word
        ends = np.cumsum(count)
        spelled = b"".join([self.bytes_of[t] if t >= 0 else chr(-2 - t).encode("utf-8", "surrogatepass") for t in flat.tolist()])
        if spelled != "".join(words).replace(SPACE, " ").encode("utf-8", "surrogatepass"):
            raise AssertionError("a hash collision: the pieces do not spell the words")
        packed = np.maximum(flat, 0).astype("<u2").tobytes()
        known, before = self.words, 0
        for w, end in zip(words, ends.tolist(), strict=True):
            known[w] = packed[2 * before : 2 * end]
            before = end
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(flat < 0), side="right")).tolist():
            out: list[int] = []
            for t in flat[ends[k] - count[k] : ends[k]].tolist():
                out += [t] if t >= 0 else [self.v.fallback[b] for b in chr(-2 - t).encode("utf-8", "surrogatepass")]
            known[words[k]] = np.array(out, "<u2").tobytes()

    def _run(self, n: int) -> bytes:
        """Ids of ``n`` spaces."""
        if n not in self.runs:
            longest = max(map(len, self.space_order), default=1)
            head, rest = [], n
            while rest > 4 * longest:  # far from the end the leftmost rule makes whole longest runs
                head.append(SPACE * longest)
                rest -= longest
            parts = head + greedy([SPACE] * rest, self.space_order)
            self.runs[n] = np.array([self.number[p] for p in parts], "<u2").tobytes()
        return self.runs[n]

    # -------------------------------------------------- texts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint16 ids of each text."""
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        split = [_UNITS.findall(t) for t in marked]
        known = self.words
        if len(known) > _KEPT_WORDS:
            known.clear()
        seen: set[str] = set()
        for units in split:
            seen.update(units)
        seen.difference_update(known)
        self._learn([w for w in seen if w.strip(SPACE)])
        known[SPACE] = self.lone_space
        return [
            np.frombuffer(self._with_runs(units) if SPACE * 2 in t else b"".join([known[w] for w in units]), "<u2")
            for t, units in zip(marked, split, strict=True)
        ]

    def _with_runs(self, units: list[str]) -> bytes:
        """Ids of a text that has runs of spaces."""
        parts: list[bytes] = []
        gap = 0
        for w in units:
            if not w.strip(SPACE):
                gap += len(w)
                continue
            ids = self.words[w]
            if gap:
                if w[0] == SPACE and ids[:2] == self.lone_space:  # the word left its space to the run
                    parts.append(self._run(gap + 1))
                    ids = ids[2:]
                else:
                    parts.append(self._run(gap))
                gap = 0
            parts.append(ids)
        if gap:
            parts.append(self._run(gap))
        return b"".join(parts)

    def decode(self, ids: np.ndarray) -> str:
        spelled = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return spelled.removeprefix(b" ").decode("utf-8", "replace")


_LAST: list[Encoder] = []


def encoder_of(vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder: tasks that follow one another share the words met."""
    for made in _LAST:
        if made.v is vocabulary:
            return made
    _LAST[:] = [Encoder(vocabulary), *_LAST[:1]]
    return _LAST[0]


def encode_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, pieces array<int>) for every row."""
    rows = docs.select(F.col(quoted(id_col)).alias("id"), text_or_empty(quoted(text_col)).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(load(path))  # the vocabulary: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, _SLICE):
                part = batch.slice(k, _SLICE)
                ids = encoder.encode(part.column(1).to_pylist())
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "pieces"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, pieces array<int>")


def decode_table(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(id, n_pieces, ids_crc32, decoded_bytes, decoded_sha256), read back from the pieces."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            out = []
            for ids in batch.column(1):
                ids = ids.values.to_numpy()
                text = encoder.decode(ids).encode("utf-8", "surrogatepass")
                out.append((len(ids), crc32(ids.astype("<u4").tobytes()), len(text), hashlib.sha256(text).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["id", "n_pieces", "ids_crc32", "decoded_bytes", "decoded_sha256"],
            )

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "pieces").mapInArrow(run, f"id {kind}, n_pieces bigint, ids_crc32 bigint, decoded_bytes bigint, decoded_sha256 string")
