"""SentencePiece encoding against the library's ids, decoding as an exact round trip."""

import random

import public_tokenizers
import pytest
import sentencepiece

from veilgrid.llm import piece_viterbi as V

SF = "/root/testdata/sf0.001"
MODEL = "piece_bpe_32k.model"
ODD = [
    "", " ", "   ", "a", " a", "a ", "  a  b   c ", "Hello world", "naïve façade œuvre ß", "日本語のテキスト", "emoji 😀👍🏽 x", "tabs\tand\nnewlines\r\n",
    "x" * 100, "ab" * 200, "aaaaaaa bbbbbbbb", "▁literal▁sign▁", "<s> </s> <unk> <0x0A>", "\x00\x01", "ﬁ ﬂ Å", "كيف حالك", "1234567890 3.14159", "é ñ",
    "https://example.com/path?query=1&x=2#frag", "def f(x):\n    return x ** 2\n", "#" * 77, " ".join("!?" * k for k in range(1, 9)),
]


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))


@pytest.fixture(scope="module")
def coder():
    return V.Coder(V.load(MODEL))


@pytest.mark.parametrize("text", ODD)
def test_ids_are_the_librarys(sp, coder, text):
    ids = coder.encode([text])[0]
    assert ids.tolist() == sp.encode(text)
    assert coder.pieces.decode(ids) == sp.decode(ids.tolist()) == text.replace("▁", " ")


def test_random_texts(sp, coder):
    rng = random.Random(8)
    pieces = [sp.id_to_piece(i).replace("▁", " ") for i in range(300, 32000)]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 12))) for _ in range(1500)]
    texts += ["".join(rng.choices("abcdeéß ñ –中\n", k=rng.randrange(40))) for _ in range(500)]
    for t, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == sp.encode(t), repr(t)
        assert coder.pieces.decode(ids) == t


def test_whole_table(spark, sp):
    import zlib

    import numpy as np

    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    got = V.op9_sentencepiece(spark, SF).toPandas().set_index("doc_id").loc[docs.index]
    want = sp.encode(list(docs.text))
    assert list(got.n_pieces) == list(map(len, want))
    assert list(got.ids_crc32) == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]
    assert got.round_trip.all()


def test_edge_cases(spark, sp):
    rows = [(1, None), (2, ""), (None, "a null id"), (3, "twice"), (3, "twice"), (4, "long text " * 20_000), (5, "y" * 30_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    got = V.encode_decode(df, with_ids=True).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    assert sorted((str(r.id), len(r.ids)) for r in got) == sorted((str(i), len(sp.encode(t or ""))) for i, t in rows)
    assert {r.decoded for r in got if r.id == 3} == {"twice"} and [r.n_pieces for r in got if r.id == 1] == [0]
    assert V.encode_decode(df.limit(0)).count() == 0
