"""Spelling variants: brute force over small vocabularies, crowded chunks, edge cases."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilgrid.llm import spelling_chunks as S


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows):
    n = Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(S.UPPER, S.LOWER))
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def plain_variants(n):
    out = {}
    for w in n:
        m = [x for x in n if near(w, x)]
        top = min(m, key=lambda x: (-n[x], x), default=None)
        out[w] = (top if top is not None and n[top] >= 2 * n[w] else None, len(m))
    rows = set()
    for w, (form, k) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n[w], k, n[form] if form is not None else None))
    return rows


def test_corpus_equals_brute_force(spark):
    rng = random.Random(3)
    stems = ["colour", "Étagère", "strasse", "naïveté", "reading", "leading", "planet", "planes"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(12):
            w = rng.choice(stems)
            if rng.random() < 0.4:
                p = rng.randrange(len(w))
                w = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("aeé") + w[p:], w[:p] + rng.choice("aeé") + w[p + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", "-", "_1", "\n"]).join(words)))
    rows += [(None, "colour colour colour"), (500, None), (501, ""), (502, "the cat sat"), (503, "x" * 50_000 + " " + "×÷×÷×÷ " * 3)]
    rows += [rows[0], rows[0], rows[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    got = {tuple(r) for r in S.variants(S.corpus_words(docs)).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = plain_variants(plain_words(rows))
    assert got == want and any(r[1] != r[2] for r in want if r[1])


@pytest.mark.parametrize("max_pairs", [1, 4, 4096])
def test_crowded_chunks_lose_no_pair(spark, max_pairs):
    words = ["".join(w) + "tion" for w in itertools.product("abc", repeat=3)] + ["".join(w) + "tion" for w in itertools.product("ab", repeat=4)]
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "abababa", "bababab", "z" * 3000, "z" * 3001, "z" * 1500 + "y" + "z" * 1499]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = sorted(tuple(sorted(r)) for r in S.near_pairs(df, max_pairs=max_pairs).collect())
    assert got == sorted(tuple(sorted(p)) for p in itertools.combinations(words, 2) if near(*p))


def test_long_chain_of_forms_and_ties(spark):
    words = [("aaaaa" + "b" * i, 3 * 2**i) for i in range(9)] + [("ccccc", 5), ("ccccd", 10), ("cccce", 10)]
    got = {r.word: r for r in S.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert all(got[w].root == "aaaaa" + "b" * 8 for w, _ in words[:9]) and got["ccccc"].form == "ccccd" and got["ccccd"].form is None


def test_empty_table(spark):
    assert S.variants(S.corpus_words(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
