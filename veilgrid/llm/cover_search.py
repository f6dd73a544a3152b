"""Exact top-k by inner product: a dual-tree search over cover trees.

A cover tree is built on a bounded sample: farthest-first centres, whose
insertion distances give the nested levels. All rows, queries and data alike,
go to their nearest leaf, and every node's covering radius is then taken over
all rows, so bounds hold for every row. The score of a query in node Q and a
row in node P is at most ``<q, p> + r_Q |p| + r_P |q| + r_Q r_P`` for the
centres q, p. A first round scores each query group against its most promising
leaf, which gives the group's worst kth score; the dual-tree descent then
prunes every node pair whose bound stays below it. A second round scores what
is left. Rows lie in bounded chunks of a leaf; queries travel to the chunks.

The tree grows with the table: a leaf for each ``chunk_rows`` rows, at least 32
and at most ``MOST_LEAVES``, since the pairs of leaves are walked on the driver and
broadcast as rows of four numbers (2^20 at most). Beyond that a leaf has more chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.llm.common import read, staged

LEAST_LEAVES = 32
MOST_LEAVES = 1024


class CoverTree:
    """Nested centres: node i joins at the level of its insertion distance, below its nearest earlier centre."""

    def __init__(self, sample: np.ndarray, leaves: int):
        sample = np.unique(sample, axis=0) if len(sample) else sample
        picks, parent = [], []
        if len(sample):
            near, owner = np.full(len(sample), np.inf), np.zeros(len(sample), np.int64)
            at = int(np.argmin(np.linalg.norm(sample - sample.mean(0), axis=1)))
            while len(picks) < min(leaves, len(sample)):
                parent.append(int(owner[at]))
                d = np.linalg.norm(sample - sample[at], axis=1)
                closer = d < near
                near[closer], owner[closer] = d[closer], len(picks)
                picks.append(at)
                at = int(np.argmax(near))
                if near[at] <= 0:
                    break
        self.centres = sample[picks] if len(sample) else np.zeros((1, sample.shape[1]))
        self.parent = parent or [0]

    def leaf(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest centre, distance to it) per row."""
        half = (self.centres * self.centres).sum(1) / 2
        at = [(half - rows[k : k + 2048] @ self.centres.T).argmin(1) for k in range(0, len(rows), 2048)]
        at = np.concatenate([np.zeros(0, np.int64), *at])
        return at, np.linalg.norm(rows - self.centres[at], axis=1)

    def reach(self, radius: np.ndarray) -> np.ndarray:
        """Covering radius of each node with all nodes below it, from the leaves' own radii."""
        out = radius.copy()
        for i in range(len(out) - 1, 0, -1):
            step = np.linalg.norm(self.centres[i] - self.centres[self.parent[i]])
            if out[i] >= 0:
                out[self.parent[i]] = max(out[self.parent[i]], step + out[i])
        return out

    def children(self, i: int) -> list[int]:
        return [j for j in range(1, len(self.parent)) if self.parent[j] == i]


def open_pairs(tree: CoverTree, q_radius: np.ndarray, p_radius: np.ndarray, worst: np.ndarray) -> list[tuple[int, int]]:
    """Leaf pairs (query leaf, data leaf) that the dual descent cannot prune; a radius below 0 marks an empty leaf.

    Node pairs descend together, a level of pairs at a time. A node stands for
    itself and all below it (whole) or for its own rows alone.
    """
    parent = np.array(tree.parent[1:], dtype=np.int64)
    kids = np.argsort(parent, kind="stable") + 1
    count = np.bincount(parent, minlength=len(tree.parent))
    start = np.cumsum(count) - count
    q_all, p_all = tree.reach(q_radius), tree.reach(p_radius)
    low = worst.copy()
    for i in range(len(low) - 1, 0, -1):
        low[tree.parent[i]] = min(low[tree.parent[i]], low[i])
    product, norm = tree.centres @ tree.centres.T, np.linalg.norm(tree.centres, axis=1)

    def below(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in x, child) for every child of every node of x."""
        place = np.repeat(np.arange(len(x)), count[x])
        first = np.cumsum(count[x]) - count[x]
        return place, kids[start[x][place] + np.arange(len(place)) - first[place]]

    out = []
    q, p = np.zeros(1, np.int64), np.zeros(1, np.int64)
    q_whole, p_whole = np.ones(1, bool), np.ones(1, bool)
    while len(q):
        rq, rp = np.where(q_whole, q_all[q], q_radius[q]), np.where(p_whole, p_all[p], p_radius[p])
        # The largest inner product of points within the radii of their centres, rounded up.
        top = product[q, p] + rq * norm[p] + rp * norm[q] + rq * rp
        top += 1e-9 * (np.abs(top) + 1) + 1e-6
        keep = (rq >= 0) & (rp >= 0) & (top >= np.where(q_whole, low[q], worst[q]))
        q, p, q_whole, p_whole, rq, rp = (x[keep] for x in (q, p, q_whole, p_whole, rq, rp))
        p_open = p_whole & (count[p] > 0)
        by_q = q_whole & (count[q] > 0) & (~p_open | (rq >= rp))
        by_p = ~by_q & p_open
        settled = ~by_q & ~by_p
        out += zip(q[settled].tolist(), p[settled].tolist(), strict=True)
        at_q, q_kids = below(q[by_q])
        at_p, p_kids = below(p[by_p])
        no, yes = (lambda x: np.zeros(len(x), bool)), (lambda x: np.ones(len(x), bool))
        q, p, q_whole, p_whole = (
            np.concatenate([q[by_q], q_kids, q[by_p], q[by_p][at_p]]),
            np.concatenate([p[by_q], p[by_q][at_q], p[by_p], p_kids]),
            np.concatenate([no(q[by_q]), yes(q_kids), q_whole[by_p], q_whole[by_p][at_p]]),
            np.concatenate([p_whole[by_q], p_whole[by_q][at_q], no(p[by_p]), yes(p_kids)]),
        )
    return out


def seed_pairs(tree: CoverTree, q_radius: np.ndarray, p_count: np.ndarray, k: int) -> list[tuple[int, int]]:
    """For every query leaf the data leaf of largest centre product that alone can give k results, or the nearest to that."""
    enough = p_count > k if (p_count > k).any() else p_count > 0
    asked = np.nonzero(q_radius >= 0)[0]
    product = np.where(enough, tree.centres[asked] @ tree.centres.T, -np.inf)
    return list(zip(asked.tolist(), product.argmax(1).tolist(), strict=True))


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Several batches as one, so that a leaf gets few and long parts."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    return np.lexsort((ids, -scores))[:k]


def chunk_best(qid: np.ndarray, qrow: np.ndarray, qvec: np.ndarray, pid: np.ndarray, prow: np.ndarray, pvec: np.ndarray, k: int) -> list[tuple]:
    """(query row, query id, ids, scores) of each query's k best in one chunk, itself aside."""
    exact = max(np.abs(qvec).max(initial=0), 1) * max(np.abs(pvec).max(initial=0), 1) * pvec.shape[1] < 2**53
    out = []
    for at in range(0, len(qid), 1024):
        a = qvec[at : at + 1024]
        s = (a @ pvec.T).astype(np.int64) if exact else a.astype(np.int64) @ pvec.astype(np.int64).T
        for i in range(len(a)):
            row = s[i]
            if len(row) > 4 * (k + 1):
                # The (k+1)th score bounds what can be among the best once the query's own row is taken out.
                cand = np.nonzero(row >= np.partition(row, len(row) - k - 1)[len(row) - k - 1])[0]
            else:
                cand = np.arange(len(row))
            cand = cand[prow[cand] != qrow[at + i]]
            top = cand[best(pid[cand], row[cand], k)]
            if len(top):
                out.append((int(qrow[at + i]), int(qid[at + i]), pid[top], row[top]))
    return out


def top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    every: int = 50,
    k: int = 5,
    scale: int = 256,
    leaves: int | None = None,
    sample_rows: int = 4096,
    chunk_rows: int = 8192,
    group_rows: int = 16_384,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each row whose id is divisible by ``every``, among all other rows.

    Components become floor(scale * x); scores are integer inner products, a
    tie goes to the smaller id. Vectors that are null, or hold null or
    non-finite components, take no part; a shorter vector counts as padded
    with zeros. A row with a null id is a candidate with id null that loses
    ties, never a query. Rows that repeat an id are rows of their own: each is
    a candidate for the other, and each is a query. An empty table gives an
    empty result; other columns are not read. ``leaves`` follows from the number
    of rows unless given. The sample only shapes the tree; it has ``sample_rows``
    rows, or 16 a leaf where that is more.
    """
    spark = vectors.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    clean = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(vec_col).isNotNull() & clean).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.transform(vec, lambda x: F.floor(x * scale).cast("double")).alias("vec")
    )
    rows = staged(rows, "search-rows")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n, dim, asked, large = rows.agg(
        F.count(F.lit(1)), F.max(F.size("vec")), F.count(F.when(F.col("id") % every == 0, 1)), F.max(F.abs(F.array_max(F.concat(F.transform("vec", lambda x: F.abs(x)), F.array(F.lit(0.0))))))
    ).first()
    if not n or not asked:
        return empty
    kind = np.int16 if large < 2**15 - 1 else np.float64

    def padded(lists) -> np.ndarray:
        out = np.zeros((len(lists), dim))
        for i, v in enumerate(lists):
            out[i, : len(v)] = v
        return out

    leaves = leaves or min(MOST_LEAVES, max(LEAST_LEAVES, n // chunk_rows))
    picked = rows.select("vec").orderBy(F.xxhash64("row")).limit(max(sample_rows, 16 * leaves)).collect()
    tree = CoverTree(padded([r.vec for r in picked]), leaves)
    no_id = np.iinfo(np.int64).max

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            row = b.column("row").to_numpy()
            ids = b.column("id").fill_null(no_id).to_numpy()
            vecs = padded([x.values.to_numpy(zero_copy_only=False) for x in b.column("vec")])
            leaf, far = tree.leaf(vecs)
            query = (ids % every == 0) & (ids != no_id)
            out = []
            for c in np.unique(leaf):
                for asks in (False, True):
                    mine = np.nonzero((leaf == c) & (query if asks else True))[0]
                    for at in range(0, len(mine), 1024):
                        m = mine[at : at + 1024]
                        out.append((int(c), asks, len(m), float(far[m].max()), row[m].tobytes(), ids[m].tobytes(), vecs[m].astype(kind).tobytes()))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], ["leaf", "asks", "n", "far", "rows", "ids", "vecs"])

    packed = rows.mapInArrow(route, "leaf int, asks boolean, n long, far double, rows binary, ids binary, vecs binary")
    packed = staged(packed.withColumn("part", F.monotonically_increasing_id()), "search-leaves")
    stats = packed.groupBy("leaf", "asks").agg(F.max("far").alias("far"), F.sum("n").alias("n")).collect()
    size = len(tree.parent)
    p_radius, q_radius, p_count, q_count = np.full(size, -1.0), np.full(size, -1.0), np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r in stats:
        (q_radius if r.asks else p_radius)[r.leaf] = r.far
        (q_count if r.asks else p_count)[r.leaf] = r.n
    # Chunks and query groups are dealt by the packed part, so that a leaf that holds most rows spreads over many tasks.
    chunks = np.maximum(1, -(-p_count // chunk_rows))
    spread = F.pmod(F.xxhash64("part"), F.lit(1 << 30)).cast("int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))

    def schedule(pairs: list[tuple[int, int]]) -> DataFrame:
        """Rows (leaf, chunk, grp, asks, ...) of the data chunks and the queries that go to them.

        A data leaf has as many query groups as the queries of its open pairs
        fill. Both broadcast tables are bounded by the tree: a row a pair of
        leaves and a row a leaf.
        """
        q, p = (np.array(x) for x in zip(*pairs, strict=True))
        asked = np.bincount(p, weights=q_count[q], minlength=size).astype(np.int64)
        groups = np.maximum(1, -(-asked // group_rows))
        to = spark.createDataFrame([(int(a), int(c), int(chunks[c]), int(groups[c])) for a, c in pairs], "leaf int, to int, chunks int, groups int")
        open_data = spark.createDataFrame([(int(c), int(chunks[c]), int(groups[c])) for c in np.unique(p)], "leaf int, chunks int, groups int")
        data = packed.where(~F.col("asks")).join(F.broadcast(open_data), "leaf")
        data = data.select("leaf", (spread % F.col("chunks")).alias("chunk"), upto("groups").alias("grp"), F.lit(False).alias("asks"), "rows", "ids", "vecs")
        asks = packed.where(F.col("asks")).join(F.broadcast(to), "leaf")
        asks = asks.select(F.col("to").alias("leaf"), upto("chunks").alias("chunk"), (spread % F.col("groups")).alias("grp"), F.lit(True).alias("asks"), "rows", "ids", "vecs")
        return data.union(asks)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        side = []
        for asks in (True, False):
            part = pdf[pdf["asks"] == asks]
            r, i = (np.frombuffer(b"".join(part[c]), np.int64) for c in ("rows", "ids"))
            side += [i, r, np.frombuffer(b"".join(part["vecs"]), kind).reshape(len(r), dim).astype(float)]
        found = chunk_best(*side, k) if len(side[0]) and len(side[3]) else []
        return pd.DataFrame(found, columns=["row", "query_id", "ids", "scores"])

    def scored(pairs: list[tuple[int, int]], name: str) -> DataFrame:
        out = schedule(pairs).groupBy("leaf", "chunk", "grp").applyInPandas(search, "row long, query_id long, ids array<long>, scores array<long>")
        return staged(out, name)

    seeds = seed_pairs(tree, q_radius, p_count, k)
    first = scored(seeds, "search-seeds")

    def ranked(found: DataFrame) -> DataFrame:
        flat = found.select("row", "query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("row", "query_id", F.col("x.ids").alias("id"), F.col("x.scores").alias("score"))
        return flat.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)

    # Each query group's worst kth score: one number per leaf comes to the driver.
    kth = ranked(first).where(F.col("rank") == k).select("row", "score")
    parts = packed.where("asks").select("leaf", "rows")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = [np.frombuffer(x.as_py(), np.int64) for x in b.column("rows")]
            leaf = np.repeat(b.column("leaf").to_numpy(), [len(x) for x in r])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *r])), pa.array(leaf.astype(np.int32))], ["row", "leaf"])

    of = parts.mapInArrow(unpack, "row long, leaf int")
    worst = np.full(size, np.inf)
    for r in of.join(kth, "row", "left").groupBy("leaf").agg(F.min("score").alias("low"), F.count("score").alias("have"), F.count(F.lit(1)).alias("all")).collect():
        worst[r.leaf] = float(r.low) if r.have == r["all"] else -np.inf
    scored_already = set(seeds)
    rest = [x for x in open_pairs(tree, q_radius, p_radius, worst) if x not in scored_already]
    found = first.union(scored(rest, "search-rest")) if rest else first
    out = ranked(found)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("id") != no_id, F.col("id")).alias("vec_id"), "score")


def op5_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


ORACLE_OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, p.vec_id AS vec_id, CAST(list_dot_product(q.e, p.e) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
