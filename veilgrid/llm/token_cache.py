"""Token counts through a digest cache.

A text's normalised content (runs of ASCII white space are one space, ends
trimmed: the tokenizer drops white space, so its count stays the same) and the
tokenizer version are digested. Counts known to the cache are joined; only
distinct contents that miss are encoded, and their counts are appended.

Inside a task a content is cut where the tokenizer never joins, and each
distinct unit is encoded once by the library; a text's count is the sum over
its units.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.common import read, shared_path, staged

MEMO_WORDS = 500_000
CACHE_SCHEMA = "tokenizer_digest string, content_digest string, n_tokens long"


def tokenizer_digest(tokenizer: str) -> str:
    """Digest of the tokenizer's file and of the library version that reads it."""
    import public_tokenizers
    import tokenizers

    with open(public_tokenizers.path(tokenizer), "rb") as f:
        return hashlib.sha256(tokenizers.__version__.encode() + b"\n" + f.read()).hexdigest()


class WordCounter:
    """Counts the tokens of texts, encoding each distinct unit once.

    A text is cut at white space into words. A word of plain Latin characters
    is cut further into the units that the tokenizer's own pattern gives (it
    never joins across units either); many units go to the library in one
    text, where each ends with a token that closes a word. Any other word goes
    to the library as it is.
    """

    def __init__(self, tokenizer: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        path = public_tokenizers.path(tokenizer)
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = self.tok.get_vocab()
        closes = spec["model"].get("end_of_word_suffix") or None
        self.closing = np.zeros(max(vocab.values()) + 1, bool)
        self.closing[[i for t, i in vocab.items() if closes and t.endswith(closes)]] = True
        self.pattern = None
        if closes and [x["type"] for x in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]:
            split = spec["pre_tokenizer"]["pretokenizers"][0]
            if split["behavior"] == "Removed" and split["invert"]:
                self.pattern = regex.compile(split["pattern"]["Regex"])
        # Characters that the normaliser only puts into lower case, and Python alike.
        self.plain = regex.compile(r"[!-~\xa1-\u012f\u0131-\u01c3\u01cd-\u01f0\u01f4-\u024f]+").fullmatch
        self.words: dict[str, int] = {}
        self.units: dict[str, int] = {}

    def _library(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for at in range(0, len(texts), 2000):
            out += [len(e.ids) for e in self.tok.encode_batch_fast(texts[at : at + 2000], add_special_tokens=False)]
        return out

    def _learn_units(self, units: list[str]) -> None:
        groups = [units[at : at + 500] for at in range(0, len(units), 500)]
        for some in (groups[at : at + 20] for at in range(0, len(groups), 20)):
            for group, e in zip(some, self.tok.encode_batch_fast([" ".join(g) for g in some], add_special_tokens=False), strict=True):
                ends = np.nonzero(self.closing[np.array(e.ids, np.int64)])[0]
                counts = np.diff(ends, prepend=-1).tolist() if len(ends) == len(group) else self._library(group)
                self.units.update(zip(group, counts, strict=True))

    def _learn_words(self, words: list[str]) -> None:
        cut = {w: self.pattern.findall(w.lower()) for w in words if self.pattern and self.plain(w) and "<|" not in w}
        self._learn_units(list(set().union(*cut.values()) - self.units.keys()))
        known = self.units.__getitem__
        self.words.update((w, sum(map(known, x))) for w, x in cut.items())
        rest = [w for w in words if w not in cut]
        self.words.update(zip(rest, self._library(rest), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        # str.split also parts at the four separators below; a text that has one goes to the library whole.
        whole = [any(c in t for c in "\x1c\x1d\x1e\x1f") for t in texts]
        words = [[t] if w else t.split() for t, w in zip(texts, whole, strict=True)]
        if len(self.words) > MEMO_WORDS:
            self.words.clear()
            self.units.clear()
        self._learn_words(list(set().union(*words) - self.words.keys()))
        known = self.words.__getitem__
        return [sum(map(known, w)) for w in words]


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "word_bpe_49k.json",
    cache_path: str | None = None,
) -> DataFrame:
    """(id, n_bytes, n_tokens) for every row; null text counts as empty, repeated rows are kept.

    ``cache_path`` names a Parquet cache to read and append to (a fresh one in
    the shared folder if None). An empty table gives an empty result. Only
    the two named columns are read.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    path = cache_path or shared_path(spark, "token-cache")
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))
    keyed = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), content.alias("content"))
    keyed = keyed.withColumn("content_digest", F.sha2("content", 256))
    narrow = staged(keyed.select("id", "n_bytes", "content_digest"), "token-digests")

    def cache() -> DataFrame:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(path)
        return rows.where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for b in batches:
            counter = counter or WordCounter(tokenizer)
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                n = counter.counts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], ["content_digest", "n_tokens"])

    # An append of no rows makes the cache exist before its first read.
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)
    distinct = keyed.groupBy("content_digest").agg(F.first("content").alias("content"))
    misses = distinct.join(cache(), "content_digest", "left_anti")
    fresh = misses.select("content_digest", "content").mapInArrow(run, "content_digest string, n_tokens long")
    fresh.select(F.lit(version).alias("tokenizer_digest"), "content_digest", "n_tokens").write.mode("append").parquet(path)
    # Written first, so that nothing but shuffled scans meets in the join and a hot digest's rows can be split.
    known = staged(cache(), "token-counts")
    return narrow.join(known, "content_digest").select("id", "n_bytes", "n_tokens")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    out = count_tokens(read(spark, sf_dir, "documents"), tokenizer="word_bpe_49k.json")
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
