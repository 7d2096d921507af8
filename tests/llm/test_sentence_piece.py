import hashlib
import random

import public_tokenizers
import sentencepiece

from lumenrec.llm import sentence_piece as S

LIB = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
PARTS = ["the", "ing", " ", "  ", "   ", "a", "Ab", "é", "漢", "日本", "😀", "\n", "\t", "1", "23", "...", "▁", "x", " " * 17, "=", "==", "tion", "　", "пр", "ив", " " * 40]


def test_ids_equal_the_library_s():
    r, enc = random.Random(1), S.Encoder(S.load())
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    texts += ["".join(r.choice("abcdeinorstuTEA,.'12") for _ in range(r.randint(1, 14))) + " " + "".join(r.choice("étionsaruqp-") for _ in range(9)) for _ in range(4000)]
    texts += [" " * n + "x" * (n % 7) for n in range(120)] + ["abc" * 3000]
    texts += ["".join(r.choice(a) for _ in range(n)) for a in ("QWERTYUIOPasdfghjklzxcvbnm0123456789+/", "漢字仮名交文", "étionsaruqp-", "日a", "ab") for n in (65, 300, 4000)]  # long words
    for t, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == LIB.encode(t), t[:80]
        assert enc.decode(ids) == LIB.decode(ids.tolist())


def test_table(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "Grüße an alle\n", 1), (3, "Grüße an alle\n", 1), (None, "some words " * 30_000, 1)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, pieces int")
    got = sorted(((r.id, r.n_pieces, r.decoded_sha256) for r in S.decode_table(S.encode_table(d)).collect()), key=str)
    assert got == sorted(((i, len(LIB.encode(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows), key=str)
    assert S.decode_table(S.encode_table(spark.createDataFrame([], d.schema))).count() == 0
