"""Token counts against the library, and what the cache does."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilgrid.llm import token_cache as T
from veilgrid.llm.common import shared_path

SF = "/root/testdata/sf0.001"
ODD = ["", "  a  b ", "It's <|startoftext|> here<|endoftext|>", "É é ΑΣ σ", "a\x1cb\x1d c", "x y z​w\u0085v", "12,5 !!! …", "日本 語", "\tTab\nline\r\n", None]


def library(texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_counts_equal_the_librarys(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, content string")
    got = {r.id: (r.n_bytes, r.n_tokens) for r in T.count_tokens(docs).collect()}
    assert got == {i: (len((t or "").encode()), n) for i, (t, n) in enumerate(zip(ODD, library(ODD), strict=True))}


def test_random_words_have_the_librarys_counts():
    import random

    rng = random.Random(4)
    chars = [chr(c) for c in [*range(33, 127), *range(0xA1, 0x250), 0x3A3, 0x3C3, 0x300, 0x301, 0x1E9E, 0x2019, 0x4E2D]] + ["'s", "'LL", "<|endoftext|>", "<|"] + list("etaoin'.") * 40
    texts = [" ".join("".join(rng.choices(chars, k=rng.randrange(1, 9))) for _ in range(30)) for _ in range(400)]
    assert T.WordCounter("word_bpe_49k.json").counts(texts) == library(texts)
    every = [chr(c) for c in range(0x21, 0x250) if c not in range(0x7F, 0xA1)]
    assert T.WordCounter("word_bpe_49k.json").counts(every + [f"a{c}b" for c in every]) == library(every + [f"a{c}b" for c in every])


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    got = T.op7_token_counts(spark, SF).toPandas().set_index("doc_id").loc[docs.index]
    assert list(got.n_tokens) == library(docs.text)
    assert list(got.over_limit) == [n > 2048 for n in got.n_tokens]


def test_cache_is_read_and_appended(spark):
    path = shared_path(spark, "test-cache")
    one = spark.createDataFrame([(1, "a b"), (2, "a  b\n"), (2, "a  b\n"), (None, "c")], "doc_id long, text string")
    assert T.count_tokens(one, cache_path=path).count() == 4
    first = spark.read.parquet(path)
    assert first.count() == 2  # distinct normalised contents
    # A stored count is believed, and only misses are appended.
    told = first.withColumn("n_tokens", F.col("n_tokens") + 100)
    other = shared_path(spark, "test-cache")
    told.write.parquet(other)
    two = spark.createDataFrame([(1, "a b"), (5, "new words")], "doc_id long, text string")
    got = {r.id: r.n_tokens for r in T.count_tokens(two, cache_path=other).collect()}
    assert got == {1: 102, 5: 2} and spark.read.parquet(other).count() == 3
    # Another tokenizer version shares the cache without seeing its counts.
    assert {r.n_tokens for r in T.count_tokens(two.limit(1), tokenizer="byte_bpe_50k.json", cache_path=other).collect()} == {2}


def test_empty_table(spark):
    assert T.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
