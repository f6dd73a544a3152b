"""Packing: ids against the library, every constraint, totals against the lower bound, edge cases."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veilgrid.llm import packing as P

SF = "/root/testdata/sf0.01"
ODD = ["", "a", "Hello  world\n\n x\t", "naïve café — “quotes” €5 ½", "日本語 テキスト", "x<|endoftext|>y", "\x1c\x1d \x85 end", "ªº²³¹ 𝒳 ǅ ʰ", "'s't're 'LL", "е́ кириллица", "1234 56,7"]


@pytest.mark.parametrize("text", ODD)
def test_ids_are_the_librarys(text):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert P.Encoder("byte_bpe_50k").ids(text) == tok.encode(text, add_special_tokens=False).ids


def test_random_plain_texts_have_the_librarys_ids():
    tok, enc, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), P.Encoder("byte_bpe_50k"), random.Random(3)
    chars = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(0xA0, 0x250), *range(0x2010, 0x2060), *range(0x20A0, 0x20C0)]]
    for _ in range(300):
        text = "".join(rng.choices(chars, k=rng.randrange(60)))
        assert enc.ids(text) == tok.encode(text, add_special_tokens=False).ids, repr(text)


def check(rows, texts, caps):
    """rows: (id, piece, start, length, crc, sequence, offset); texts: id to ids."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r[0], []).append(r)
        by_seq.setdefault(r[5], []).append(r)
    assert set(by_doc) == set(texts)
    for k, ids in texts.items():
        at = 0
        for n, (_, piece, start, length, crc, _, _) in enumerate(sorted(by_doc[k], key=lambda r: r[1])):
            assert (piece, start) == (n, at) and 1 <= length <= caps[0] and (length == caps[0] or n == 0)
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r[6]):
            assert r[6] == at
            at += r[3]
        assert at <= caps[0] and len(rs) <= caps[1] and sum(r[3] ** 2 for r in rs) <= caps[2]
    return len(by_seq)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.itertuples()}
    rows = [tuple(r) for r in P.op6_best_fit_packing(spark, SF).collect()]
    used = check(rows, texts, (1024, 1024, 1024 * 1024))
    assert used <= math.ceil(sum(map(len, texts.values())) / 1024) * 1.01 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("caps", [(50, 50, 2500), (50, 3, 2500), (50, 50, 900)])
def test_every_capacity_holds(rule, caps):
    rng = random.Random(4)
    most = min(caps[0], math.isqrt(caps[2]))
    histogram = {n: rng.randrange(1, 40) for n in range(1, most + 1)}
    states = P.best_fit(histogram, caps, rule=rule)
    placed = {}
    for s in states:
        assert sum(n * c for n, c in s.held) <= caps[0] and sum(c for _, c in s.held) <= caps[1]
        assert sum(n * n * c for n, c in s.held) <= caps[2]
        for n, c in s.held:
            placed[n] = placed.get(n, 0) + c * s.bins
    assert placed == histogram
    bound = max(
        sum(n * c for n, c in histogram.items()) / caps[0],
        sum(histogram.values()) / caps[1],
        sum(n * n * c for n, c in histogram.items()) / caps[2],
    )
    assert sum(s.bins for s in states) <= 1.25 * bound + 1


def test_too_small_a_capacity_is_an_error():
    with pytest.raises(ValueError):
        P.best_fit({40: 1}, (50, 50, 900))


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "a null id"), (3, "twice"), (3, "twice"), (4, "long " * 3000)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, rank int")
    got = P.pack(docs).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in got) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sorted(r.length for r in got if r.id in (1, 2)) == [1, 1]
    assert sum(r.id == 3 for r in got) == 2 and sum(r.id is None for r in got) == 1
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert P.pack(docs.limit(0)).count() == 0
