"""Embedding near-duplicates by a PCA-ordered tiled comparison.

Equal vectors become one class first (a group of copies that holds a third of
the rows is combined before anything is compared). Vectors are rotated to the
principal axes of a bounded sample, so that the leading dimensions carry most
of a product. Blocks are ranges of the first axis; two blocks meet in one task
unless they lie too far apart on it. A tile accumulates the leading dimensions
first, bounds the rest by the product of the
suffix norms (Cauchy-Schwarz), and goes on only with pairs whose bound still
reaches the threshold. Survivors are checked on the unrotated vectors in
double precision. A task returns, per class, the number of linked rows and one
root per connected group, never all pairs; connected components join the
groups.

All pairs of classes within reach are compared, as the contract asks, so work
can grow with the square of their number; blocks of ``block_rows`` vectors keep
a task at a few dozen MB and the shuffle at (number of blocks in reach) x input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.common import connected_components, read, staged
from veilgrid.llm.simhash_vp import Forest

TILE = 1024
SLACK = 1e-9


def usable(vec: str):
    """The vector holds only finite components, at least one of them not zero."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col(vec).isNotNull() & ok & F.exists(vec, lambda x: x != 0), F.lit(False))


def principal_axes(vectors: np.ndarray) -> np.ndarray:
    """Orthogonal columns, by falling variance."""
    values, axes = np.linalg.eigh(vectors.T @ vectors)
    return axes[:, np.argsort(-values)]


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; the largest component is scaled first, so that squares neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(1, keepdims=True, initial=np.finfo(float).tiny)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def reach_of(least: float) -> float:
    """Unit vectors with a product of at least ``least`` are no farther apart than this, on any axis."""
    return math.sqrt(max(0.0, 2 - 2 * least)) + SLACK


def tile_ranges(tiles: list[int], edges: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per block of ``tiles`` tiles: its first tile (and the number of all at the end), and the first and last tile in reach of it.

    Block k holds the values from edges[k - 1] to edges[k] of the first axis.
    """
    first = np.concatenate([[0], np.cumsum(tiles)])
    lower, upper = np.concatenate([[-np.inf], edges]), np.concatenate([edges, [np.inf]])
    near = lower[None, :] - upper[:, None] <= reach  # block of the column not too far above that of the row
    near &= near.T
    low = np.array([first[np.nonzero(row)[0].min()] for row in near])
    high = np.array([first[np.nonzero(row)[0].max() + 1] - 1 for row in near])
    return first, low, np.maximum(low, high)


def tile_links(x: np.ndarray, y: np.ndarray, xr: np.ndarray, yr: np.ndarray, cuts: list[int], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit rows of x and y with a product of at least ``least``; xr and yr are the rotated rows."""
    part = xr[:, : cuts[0]] @ yr[:, : cuts[0]].T
    alive = None
    for lo, hi in zip(cuts, [*cuts[1:], xr.shape[1]], strict=True):
        if lo >= xr.shape[1]:
            break
        rest = np.linalg.norm(xr[:, lo:], axis=1), np.linalg.norm(yr[:, lo:], axis=1)
        if alive is None:
            open_ = part + rest[0][:, None] * rest[1][None, :] >= least - SLACK
            share = np.count_nonzero(open_)
            if share == 0:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            if share * 8 <= open_.size:
                alive = np.nonzero(open_)
                part = part[alive]
            else:
                part += xr[:, lo:hi] @ yr[:, lo:hi].T
                continue
        else:
            keep = part + rest[0][alive[0]] * rest[1][alive[1]] >= least - SLACK
            alive, part = (alive[0][keep], alive[1][keep]), part[keep]
        part = part + np.einsum("ij,ij->i", xr[alive[0], lo:hi], yr[alive[1], lo:hi])
    if alive is None:
        alive = np.nonzero(part >= least - SLACK)
    else:
        alive = alive[0][part >= least - SLACK], alive[1][part >= least - SLACK]
    exact = np.concatenate([np.zeros(0)] + [np.einsum("ij,ij->i", x[alive[0][k : k + 65536]], y[alive[1][k : k + 65536]]) for k in range(0, len(alive[0]), 65536)])
    return alive[0][exact >= least], alive[1][exact >= least]


def block_links(ids: np.ndarray, mult: np.ndarray, vecs: np.ndarray, split: int, axes: np.ndarray, least: float, own: bool) -> pd.DataFrame:
    """Links of rows [0, split) with rows [split, n); of all rows among each other if they are one tile, ``own``."""
    vecs = unit(vecs)
    rot = vecs @ axes
    order = np.concatenate([np.argsort(rot[:split, 0]), split + np.argsort(rot[split:, 0])])
    ids, mult, vecs, rot = ids[order], mult[order], vecs[order], rot[order]
    n = len(ids)
    forest, links = Forest(n), np.zeros(n, np.int64)
    cuts = sorted({max(1, rot.shape[1] // 4), max(1, rot.shape[1] // 2)})
    reach = reach_of(least)
    for i in range(0, split, TILE):
        a = slice(i, min(i + TILE, split))
        for j in range(i if own else split, n, TILE):
            b = slice(j, min(j + TILE, n))
            if rot[b.start, 0] - rot[a.stop - 1, 0] > reach or rot[a.start, 0] - rot[b.stop - 1, 0] > reach:
                continue
            p, q = tile_links(vecs[a], vecs[b], rot[a], rot[b], cuts, least)
            p, q = p + i, q + j
            if own and i == j:
                p, q = p[p < q], q[p < q]
            links += np.bincount(p, mult[q], n).astype(np.int64) + np.bincount(q, mult[p], n).astype(np.int64)
            forest.link(p, q)
    hit = np.nonzero(links)[0]
    return pd.DataFrame({"cid": ids[hit], "links": links[hit], "root": ids[forest.roots(hit)]})


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    least: float = 0.95,
    block_rows: int = 16_384,
    sample_rows: int = 8192,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    n_links counts the other rows of cosine >= ``least``; component_id is the
    smallest id reachable by links; kept marks the rows that carry it.
    Vectors that are null, empty, zero, or hold a null or non-finite component
    link with nothing. A shorter vector counts as padded with zeros. Rows that
    repeat an id are rows of their own; a null id is never a component's id
    unless it has no other. An empty table gives an empty result; other
    columns are not read. ``sample_rows`` bounds the sample for the axes, which
    bear on speed alone.
    """
    spark = vectors.sparkSession
    single = dict(vectors.dtypes)[vec_col] == "array<float>"
    src = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    key = F.when(usable("vec"), F.sha2(F.col("vec").cast("array<double>").cast("string"), 256))
    rows = staged(src.select("id", "vec", key.alias("key")), "vectors")
    classes = rows.where("key is not null").groupBy("key").agg(F.first("vec").alias("vec"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("mult"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    n, dim = classes.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not n:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    kind = np.float32 if single else np.float64

    def padded(lists) -> np.ndarray:
        out = np.zeros((len(lists), dim), kind)
        for i, v in enumerate(lists):
            out[i, : len(v)] = v
        return out

    picked = classes.select("vec").orderBy(F.xxhash64("cid")).limit(sample_rows).collect()
    known = unit(padded([r.vec for r in picked]).astype(float))
    axes = principal_axes(known)
    # Blocks are ranges of the first axis, about as large as the sample says.
    edges = np.quantile(known @ axes[:, 0], np.linspace(0, 1, math.ceil(n / block_rows) + 1)[1:-1])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cid, mult = (b.column(c).to_numpy() for c in ("cid", "mult"))
            vecs = padded([x.values.to_numpy(zero_copy_only=False) for x in b.column("vec")])
            at = np.searchsorted(edges, unit(vecs.astype(float)) @ axes[:, 0], "right")
            out = []
            for k in np.unique(at):
                mine = np.nonzero(at == k)[0]
                for m in (mine[x : x + 1024] for x in range(0, len(mine), 1024)):
                    out.append((int(k), len(m), cid[m].tobytes(), mult[m].tobytes(), vecs[m].tobytes()))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["block", "n", "cids", "mults", "vecs"])

    packed = classes.select("cid", "mult", "vec").mapInArrow(deal, "block int, n long, cids binary, mults binary, vecs binary")
    packed = staged(packed.withColumn("part", F.monotonically_increasing_id()), "vector-blocks")
    held = {r.block: r.n for r in packed.groupBy("block").agg(F.sum("n").alias("n")).collect()}
    first, low, high = tile_ranges([math.ceil(held.get(k, 0) / block_rows) for k in range(len(edges) + 1)], edges, reach_of(least))
    number = lambda xs: F.array(*[F.lit(int(x)) for x in xs])
    of_block = lambda xs: F.element_at(number(xs), F.col("block") + 1)
    # A block that holds more than its share is cut into several tiles; tiles of blocks out of reach never meet.
    spread = F.pmod(F.xxhash64("part"), of_block(np.maximum(1, np.diff(first)))).cast("int")
    tiles = packed.withColumn("own", of_block(first[:-1]) + spread)
    tiles = tiles.withColumn("other", F.explode(F.sequence(of_block(low), of_block(high))))
    dealt = tiles.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cids", "mults", "vecs")

    def link(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # A tile may have got no part: what is left then is the other tile alone, which meets itself elsewhere.
        pdf = pdf.sort_values("own", kind="stable")
        size = pdf["cids"].map(len) // 8
        split = int(size[pdf["own"] == pdf["i"]].sum())
        ids, mult = (np.frombuffer(b"".join(pdf[c]), np.int64) for c in ("cids", "mults"))
        vecs = np.frombuffer(b"".join(pdf["vecs"]), kind).reshape(len(ids), dim).astype(float)
        return block_links(ids, mult, vecs, split, axes, least, own=bool(key[0] == key[1]))

    found = staged(dealt.groupBy("i", "j").applyInPandas(link, "cid long, links long, root long"), "vector-links")
    roots = connected_components(found, "cid", "root").withColumnRenamed("node", "cid")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    known = classes.select("key", "cid", "rep", "mult").join(roots, "cid", "left").join(links, "cid", "left")
    known = known.withColumn("component", F.coalesce("component", "cid"))
    first = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = known.join(first, "component").select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    usable_rows = rows.where("key is not null").join(of, "key").select("id", "n_links", "component_id")
    other = rows.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return usable_rows.union(other).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def op1_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every vector with its number of links and its component."""
    return near_duplicates(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


ORACLE_OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
cnt AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp USING (vec_id) LEFT JOIN cnt USING (vec_id)
"""
