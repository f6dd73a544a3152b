"""SimHash near-duplicates: fingerprints by the definition, components by brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilgrid.llm import simhash_vp as S
from veilgrid.llm.common import connected_components

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    """The definition, bit by bit."""
    import re

    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(ids, fps, most):
    """Smallest id reachable, per row."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                root[find(i)] = find(j)
    low = {}
    for i, x in enumerate(ids):
        low[find(i)] = min(low.get(find(i), x), x)
    return [low[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c", "a b c d", "A B C D a b c d", "x\x1cy z w v É É", "w " * 5000])
def test_fingerprint_is_the_definition(text):
    assert S.fingerprint(text) == plain_fingerprint(text)


def test_whole_table_equals_brute_force(spark):
    got = S.op4_simhash_near_dedup(spark, SF).toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id")
    fps = [plain_fingerprint(t) for t in docs.text]
    assert list(got.fingerprint) == [f"{f:016x}" for f in fps]
    assert list(got.component_id) == brute(list(docs.doc_id), fps, 4)


def test_tree_and_chunks_lose_no_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base[rng.integers(0, 300, 500)] ^ (np.uint64(1) << rng.integers(0, 63, 500).astype(np.uint64))
    near ^= np.uint64(1) << rng.integers(0, 63, 500).astype(np.uint64)
    fps = np.unique(np.concatenate([base, near]))
    want = {(i, j) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}
    for depth in (0, 2, 5):
        tree = S.build_tree(fps[::7], depth)
        seen = set()
        for _, home, guest in S.route(tree, fps, 4):
            vals = np.concatenate([home, guest])
            for i, j in S.close_pairs(vals, np.arange(len(vals)), np.arange(len(home)), 4, leaf=8):
                a, b = np.searchsorted(fps, vals[i]), np.searchsorted(fps, vals[j])
                seen |= {(max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True) if x != y}
        assert seen == want
    homes = np.concatenate([h for _, h, _ in S.route(S.build_tree(fps, 4), fps, 4)])
    assert sorted(homes.tolist()) == fps.tolist()


def test_shards_and_chunks_on_spark_equal_brute_force(spark):
    rows = [(i, f"common text number {i % 40} with words " + "z " * (i % 3) + f"{i % 7}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r.id: (r.fp, r.component_id) for r in S.components(docs, shard_rows=8, sample_rows=64).collect()}
    fps = [plain_fingerprint(t) for _, t in rows]
    assert [one[i][1] for i in range(400)] == brute(list(range(400)), fps, 4)


@pytest.mark.parametrize("cuts", [1, 3])
def test_chunks_and_pieces_lose_no_pair(cuts):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base[:200] ^ np.uint64(5), base[:50] ^ np.uint64(7 << 40)]))
    want = {(i, j) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}
    tree = S.build_tree(fps[::5], 3)
    tasks: dict = {}
    for part in np.array_split(fps, 4):  # four tasks deal, each its part
        for rows in S.deal_shards(tree, part, 4, {leaf: (cuts, 2 * cuts) for leaf in range(8)}):
            for leaf, chunk, piece, home, guest in rows:
                got = tasks.setdefault((leaf, chunk, piece), ([], []))
                got[0].append(home)
                got[1].append(guest)
    assert len(tasks) == 8 * cuts * 2 * cuts
    seen = set()
    for home, guest in tasks.values():
        home, guest = (np.frombuffer(b"".join(x), np.uint64) for x in (home, guest))
        vals = np.unique(np.concatenate([home, guest]))
        for i, j in S.close_pairs(vals, np.arange(len(vals)), np.searchsorted(vals, np.unique(home)), 4):
            a, b = np.searchsorted(fps, vals[i]), np.searchsorted(fps, vals[j])
            seen |= {(max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True) if x != y}
    assert seen == want


def test_guests_in_pieces_on_spark_equal_brute_force(spark):
    rows = [(i, f"common text number {i % 40} with words " + "z " * (i % 3) + f"{i % 7}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r.id: r.component_id for r in S.components(docs, shard_rows=4, sample_rows=16, guest_rows=8).collect()}
    assert [one[i] for i in range(400)] == brute(list(range(400)), [plain_fingerprint(t) for _, t in rows], 4)


def test_rows_that_share_an_id_with_other_texts_stay(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue white black pink")
    rows = [(5, a, "x", 1), (5, b, "y", 2), (5, b, "y", 2), (5, b, "z", 3), (6, a, "w", 4), (7, c, "v", 5), (7, None, "u", 6), (8, "", "t", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, nth long")
    kept = S.keep_one(docs).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted([(5, a), (5, b), (7, c), (7, "")])
    assert {tuple(r) for r in S.keep_one(docs.repartition(3)).collect()} == {tuple(r) for r in kept}


def test_nulls_repeats_and_extra_columns(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "", "c"), (3, "some words in a text here", "d"), (3, "some words in a text here", "d"), (None, "lonely words " * 9, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.id is None, r.id, r.component_id) for r in S.components(docs).collect()), key=str)
    assert got == sorted([(False, 1, 1), (False, 2, 1), (True, None, 1), (False, 3, 3), (False, 3, 3), (True, None, None)], key=str)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None", "None"]
    assert S.components(docs.limit(0)).count() == 0 and S.keep_one(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 7), (2000, 2001), (2001, 2000)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    want = {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(200)} | {2000: 2000, 2001: 2000}
    assert got == want
    assert connected_components(edges.where(F.lit(False)), "a", "b").count() == 0
