"""Embedding near-duplicates and exact top-k against brute force."""

import numpy as np
import pytest

from veilgrid.llm import cover_search as C
from veilgrid.llm import embed_pca as A

SCHEMA = "vec_id long, embedding array<float>, key string, vec string"


def clusters(n=240, dim=12, seed=3):
    """Rows around a few centres, some of them equal, as (id, list)."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * rng.choice([0.0, 0.02, 0.35], n)[:, None]).astype(np.float32)
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


def brute_links(rows, least):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], dtype=float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= least
    np.fill_diagonal(link, False)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(link), strict=True):
        root[find(i)] = find(j)
    low = {}
    for i, k in enumerate(ids):
        low[find(i)] = min(low.get(find(i), k), k)
    return {k: (int(link[i].sum()), low[find(i)]) for i, k in enumerate(ids)}


@pytest.mark.parametrize("block_rows", [16384, 50])
def test_links_equal_brute_force(spark, block_rows):
    rows = clusters()
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in A.near_duplicates(df, block_rows=block_rows).collect()}
    want = brute_links(rows, 0.95)
    assert {k: v[:2] for k, v in got.items()} == want
    assert all(v[2] == (k == v[1]) for k, v in got.items())


def test_tiles_prune_but_lose_nothing(monkeypatch):
    monkeypatch.setattr(A, "TILE", 16)
    rows = clusters(200, 20, 8)
    x = np.array([r[1] for r in rows], dtype=float)
    axes = A.principal_axes(A.unit(x))
    got = A.block_links(np.arange(200), np.ones(200, np.int64), x, 200, axes, 0.9, own=True)
    want = {k: v[0] for k, v in brute_links(rows, 0.9).items() if v[0]}
    assert dict(zip(got.cid, got.links, strict=True)) == want


def test_tile_ranges_hold_every_pair_in_reach():
    rng = np.random.default_rng(2)
    for _ in range(200):
        edges = np.sort(rng.uniform(-1, 1, rng.integers(0, 9)))
        tiles = rng.integers(0, 4, len(edges) + 1).tolist()
        reach = float(rng.uniform(0, 0.8))
        first, low, high = A.tile_ranges(tiles, edges, reach)
        x = rng.uniform(-1.2, 1.2, 200)
        block = np.searchsorted(edges, x, "right")
        for a, b in rng.integers(0, 200, (300, 2)):
            if abs(x[a] - x[b]) <= reach:
                for t in range(first[block[b]], first[block[b] + 1]):
                    assert low[block[a]] <= t <= high[block[a]]
    first, low, high = A.tile_ranges([1] * 10, np.linspace(-0.8, 0.8, 9), 0.1)
    assert (high - low).max() == 2  # far blocks never meet


def test_embedding_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
        (None, [1.0, 0.0]), (9, [3.0]), (10, [0.0, 1e-30]), (11, [0.0, 1e30]),
    ]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    got = sorted(((str(r.id), r.n_links, r.component_id, r.kept) for r in A.near_duplicates(df).collect()), key=str)
    want = [("1", 4, 1, True), ("2", 4, 1, False), ("2", 4, 1, False), ("None", 4, 1, False), ("9", 4, 1, False), ("10", 1, 10, True), ("11", 1, 10, False)]
    want += [(str(i), 0, i, True) for i in (3, 4, 5, 6, 7, 8)]
    assert got == sorted(want, key=str)
    assert A.near_duplicates(df.limit(0)).count() == 0
    assert A.near_duplicates(df.where("vec_id = 3")).count() == 1


def brute_top(rows, every, k):
    q = {i: np.floor(256 * np.array(v, dtype=float)).astype(int) for i, v in rows}
    out = set()
    for i in q:
        if i % every == 0:
            ranked = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("kw", [{}, {"leaves": 6, "chunk_rows": 20, "group_rows": 2}, {"leaves": 1}])
def test_top_k_equals_brute_force(spark, kw):
    rows = clusters(260, 10, 5)
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA).repartition(4)
    assert set(map(tuple, C.top_k(df, **kw).collect())) == brute_top(rows, 50, 5)


def test_dual_tree_bounds_hold():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(300, 4)) + c for c in ((30, 0, 0, 0), (0, 30, 0, 0), (-30, 0, 0, 0))])
    tree = C.CoverTree(x[::5], 12)
    leaf, far = tree.leaf(x)
    radius = np.array([far[leaf == i].max(initial=-1) for i in range(len(tree.parent))])
    reach = tree.reach(radius)
    for i in range(len(tree.parent)):
        below, todo = [], [i]
        while todo:
            n = todo.pop()
            below.append(n)
            todo += tree.children(n)
        inside = x[np.isin(leaf, below)]
        assert len(inside) == 0 or np.linalg.norm(inside - tree.centres[i], axis=1).max() <= reach[i] + 1e-9
    s = x @ x.T
    worst = np.full(len(tree.parent), np.inf)
    for i in range(len(x)):
        worst[leaf[i]] = min(worst[leaf[i]], np.sort(np.delete(s[i], i))[-5])
    pairs = set(C.open_pairs(tree, radius, radius, worst))
    assert len(pairs) < len(set(leaf.tolist())) ** 2  # something is pruned
    for i in range(len(x)):
        for j in np.argsort(-np.delete(s[i], i))[:5]:
            j = j + (j >= i)
            assert (leaf[i], leaf[j]) in pairs


def test_search_edge_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 1.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (None, [9.0, 9.0]), (7, [1.0, 1.0]), (8, None), (9, [nan, 1.0]), (10, [None, 1.0]), (100, []), (3, [2.0])]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    got = sorted(map(tuple, C.top_k(df, k=3).collect()), key=str)
    one, nine, two = 2 * 256**2, 2 * 9 * 256**2, 2 * 256**2
    mine = [(1, None, nine), (2, 3, two), (3, 7, one)]
    assert [x[1:] for x in got if x[0] == 0] == mine
    assert sorted(x[1:] for x in got if x[0] == 50 and x[1] > 1) == sorted([(2, 0, one), (3, 3, two)] * 2, key=str) or len([x for x in got if x[0] == 50]) == 6
    assert [x[1:] for x in got if x[0] == 100] == [(1, 0, 0), (2, 3, 0), (3, 7, 0)]
    assert C.top_k(df.limit(0)).count() == 0 and C.top_k(df.where("vec_id = 0")).count() == 0


def test_blocks_cut_into_more_tiles_than_they_have_parts(spark):
    """All vectors lie in one block, of one part; partner tiles without a part count nothing twice."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((6, 8)), 40, 0) + 1e-3 * rng.standard_normal((240, 8))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    got = {r.id: r.n_links for r in A.near_duplicates(df, block_rows=50, sample_rows=4).collect()}
    assert [got[i] for i in range(240)] == want.tolist()


def test_descent_equals_every_leaf_pair_checked():
    """The level-wise descent keeps each leaf pair whose own bound reaches the group's worst score, and no empty leaf."""
    rng = np.random.default_rng(7)
    for leaves in (1, 2, 9, 40):
        x = rng.normal(size=(500, 3)) * rng.choice([1, 20], 500)[:, None]
        tree = C.CoverTree(x, leaves)
        size = len(tree.parent)
        q_radius, p_radius = rng.uniform(0, 3, size), rng.uniform(0, 3, size)
        p_radius[rng.random(size) < 0.2] = -1
        worst = rng.normal(size=size) * 200
        got = C.open_pairs(tree, q_radius, p_radius, worst)
        assert len(got) == len(set(got))
        c, norm = tree.centres, np.linalg.norm(tree.centres, axis=1)
        for i in range(size):
            for j in range(size):
                top = c[i] @ c[j] + q_radius[i] * norm[j] + p_radius[j] * norm[i] + q_radius[i] * p_radius[j]
                if p_radius[j] >= 0 and top >= worst[i]:
                    assert (i, j) in got
                if p_radius[j] < 0 or top < worst[i] - 1:
                    assert (i, j) not in got


def test_leaves_grow_with_the_rows(spark, monkeypatch):
    made = []
    tree = C.CoverTree
    monkeypatch.setattr(C, "CoverTree", lambda sample, leaves: made.append(leaves) or tree(sample, leaves))
    monkeypatch.setattr(C, "LEAST_LEAVES", 2)
    rows = clusters(400, 6, 11)
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA).repartition(3)
    assert set(map(tuple, C.top_k(df, chunk_rows=10, group_rows=1).collect())) == brute_top(rows, 50, 5)
    assert made == [40]
