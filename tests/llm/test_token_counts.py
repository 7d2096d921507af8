import random

from lumenrec.llm import token_counts
from lumenrec.llm.byte_bpe import library

PARTS = ["the ", "ab", "  ", "\n\n", "x" * 40, "<|endoftext|>", "<|endof", "é", "漢字", "'s ", "123", "!!", "\t ", " " * 30, "😀", "'ll"]


def test_spliced_counts_equal_whole_counts():
    tok, r = library(), random.Random(3)
    for _ in range(600):
        s = "".join(r.choice(PARTS) for _ in range(r.randint(0, 120)))
        n = len(tok.encode(s, add_special_tokens=False).ids)
        for chunk, overlap in ((64, 16), (100, 40), (30, 5)):
            assert token_counts.count_long(s, tok, chunk, overlap) == n


def test_one_endless_word():
    tok = library()
    for s in ("a" * 3000, " " * 2000, "ab" * 999 + " end"):
        assert token_counts.count_long(s, tok, 64, 16) == len(tok.encode(s, add_special_tokens=False).ids)


def test_work_is_linear_without_boundaries():
    class Counting:
        def __init__(self):
            self.tok, self.chars = library(), 0

        def encode(self, text, **kw):
            self.chars += len(text)
            return self.tok.encode(text, **kw)

    for n in (4_000, 32_000):
        tok, text = Counting(), "a" * n
        assert token_counts.count_long(text, tok, 64, 16) == len(library().encode(text, add_special_tokens=False).ids)
        assert tok.chars < 16 * n


def test_table(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "héllo <|endoftext|>", 1), (3, "héllo <|endoftext|>", 1), (None, "word another " * 20_000, 1)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = sorted(((r.id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.counts(d).collect()), key=str)
    tok = library()
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    assert token_counts.counts(spark.createDataFrame([], d.schema)).count() == 0
