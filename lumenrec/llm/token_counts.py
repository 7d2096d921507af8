"""Token counts of whole texts, huge ones by overlapping chunks.

A text up to ``chunk`` characters is encoded as it is.  A longer one is encoded
in overlapping chunks with offsets, and the chunks are spliced at proven stable
common boundaries:

* In the earlier chunk a pre-token boundary at p is that of the whole text if p
  lies before the chunk's last pre-token and at least a special string's length
  before its end: pre-tokens are matched left to right, and a match looks at
  most one character past its end.
* If the later chunk has a pre-token boundary at the same p, its tokens from p
  on are those of the whole text, because pre-tokenisation keeps no state across
  boundaries and no token crosses one.

The first such p in the overlap splices the two.  Where there is none (one word
fills the overlap) the overlap doubles, up to the whole unsettled text; from
there the chunk doubles too.

Defined results: null text is empty and has no tokens; special strings inside a
text count as the library's default has it; an empty table gives no rows; rows
that repeat are counted each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Encoding, Tokenizer

from .byte_bpe import SPECIAL, library
from .common import quoted, text_or_empty

CHUNK, OVERLAP, LIMIT = 32_768, 256, 1024
_BATCH_CHARS = 400_000


def _boundaries(encoding: Encoding, shift: int) -> dict[int, int]:
    """Position in the text -> index of the first token there, at pre-token starts.

    A special string has no word number; it bounds pre-tokens on both sides.
    """
    words, offsets = encoding.word_ids, encoding.offsets
    out, before = {}, object()
    for k, w in enumerate(words):
        if w is None or w != before:
            out[offsets[k][0] + shift] = k
        before = w if w is not None else object()
    return out


def count_long(text: str, tok: Tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text by resynchronised chunks; two chunks are held at a time."""
    if not 0 < overlap < chunk:
        raise ValueError("overlap must be positive and less than chunk")
    total, first = 0, 0  # tokens settled so far; first token of ``now`` that is not settled
    start, end = 0, min(chunk, len(text))
    now = tok.encode(text[start:end], add_special_tokens=False)
    while end < len(text):
        marks = _boundaries(now, start)
        stable = min(max(marks, default=start), end - len(SPECIAL))
        width = overlap
        while True:
            begin = max(end - width, start)
            ahead = chunk if begin > start else max(chunk, end - start)  # without any boundary chunks double, so the work stays linear
            until = min(end + ahead, len(text))
            after = tok.encode(text[begin:until], add_special_tokens=False)
            later = _boundaries(after, begin)
            low = begin + len(SPECIAL) if begin > start else begin  # a special string may straddle the cut
            common = [p for p in later if low <= p <= stable and marks.get(p, -1) >= first]
            if common or begin == start:
                break
            width *= 2
        if begin == start and not common:  # no boundary at all: the longer chunk replaces this one
            end, now = until, after
            continue
        p = min(common)
        total += marks[p] - first
        first, start, end, now = later[p], begin, until, after
    return total + len(now.ids) - first


def counts(docs: DataFrame, limit: int = LIMIT, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row."""
    rows = docs.select(F.col(quoted(id_col)).alias("id"), text_or_empty(quoted(text_col)).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = library(tokenizer_path)
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            held: list[tuple[int, str]] = []
            chars = 0

            def flush():
                nonlocal chars
                done = tok.encode_batch_fast([t for _, t in held], add_special_tokens=False)
                for (i, _), e in zip(held, done, strict=True):
                    n[i] = len(e)
                held.clear()
                chars = 0

            for i, t in enumerate(batch.column(1)):
                text = t.as_py()
                if len(text) > CHUNK:
                    n[i] = count_long(text, tok)
                elif text:
                    held.append((i, text))
                    chars += len(text)
                    if chars >= _BATCH_CHARS:
                        flush()
            flush()
            size = pa.compute.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
