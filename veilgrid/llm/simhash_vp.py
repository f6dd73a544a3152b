"""SimHash near-duplicates: exact pairs within a Hamming radius by vantage-point trees.

1. One pass gives each text its 64-bit fingerprint; equal fingerprints become
   one class (partial aggregation, so a group of copies that holds a third of
   the rows is combined before the shuffle).
2. The upper vantage-point tree is built on a bounded sample of fingerprints.
   It only steers the partitioning: every fingerprint is routed through it,
   has one home shard, and also visits the shards that the triangle bound
   ``|d(x, v) - d(y, v)| <= d(x, y)`` leaves open beyond a boundary.
3. Inside a shard a vantage-point recursion prunes branches by the same bound
   and compares the rest exactly. A shard returns a spanning forest of its
   links, never all pairs of a group.
4. Connected components join the forests.

Cost: 64-bit fingerprints of unrelated texts lie 32 +- 4 bits apart, so a
radius of 4 leaves a large part of every boundary open: one level halves a
shard and lets about 1.7 times as many visitors through. Comparisons grow
about as n^1.75; they are 8-byte XORs in numpy. Only the upper tree is paid
for in shuffled bytes, so beyond ``SHARDS`` shards these grow (up to
``MOST_HOME`` rows) before they get more; the recursion inside goes on from
there without a shuffle. At 10^9 classes that is 4,096 shards, 8 bytes x 10^9 x
1.7^12, about 5 TB shuffled. Visitors are counted per shard first and
dealt in pieces of about ``MOST_GUESTS``, so no task's input grows with the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.llm.common import connected_components, staged

PAIR_BLOCK = 1 << 20
SHARDS = 1024
MOST_HOME = 1 << 18
MOST_GUESTS = 1 << 20
MOST_SAMPLE = 1 << 20


def fingerprint(text: str | None, words_per_shingle: int = 4) -> int:
    """The text's SimHash as an unsigned 64-bit integer; 0 if it has no word."""
    joined = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not joined:
        return 0
    if len(joined) < words_per_shingle:
        spans, buf = [(0, None)], b" ".join(joined)
    else:
        size = np.fromiter(map(len, joined), np.int64, len(joined))
        ends = np.cumsum(size + 1) - 1
        buf = b" ".join(joined)
        spans = zip((ends - size).tolist(), ends[words_per_shingle - 1 :].tolist(), strict=False)
    h64 = xxhash.xxh64_intdigest
    hashes = np.array([h64(buf[s:e], 42) for s, e in spans], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words_per_shingle: int = 4) -> DataFrame:
    """(id, digest, fp): fp is the fingerprint's bits as a signed long, digest the text's xxhash64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words_per_shingle) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["id", "digest", "fp"])

    kind = dict(docs.dtypes)[id_col]
    text = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    return text.mapInArrow(run, f"id {kind}, digest long, fp long")


def build_tree(sample: np.ndarray, depth: int, pool: int = 16) -> tuple:
    """Nested (vantage, radius, inner, outer); a leaf is (share of the sample,)."""

    def grow(points: np.ndarray, left: int) -> tuple:
        if left == 0 or len(points) < 2:
            return (len(points),)
        best = None
        for v in points[np.linspace(0, len(points) - 1, min(pool, len(points))).astype(int)]:
            d = np.bitwise_count(points ^ v)
            spread = float(d.std())
            if best is None or spread > best[0]:
                best = (spread, v, d)
        _, v, d = best
        mu = int(np.median(d))
        if not (d > mu).any():
            mu -= 1
        if not (d <= mu).any():
            return (len(points),)
        return (v, mu, grow(points[d <= mu], left - 1), grow(points[d > mu], left - 1))

    return grow(sample, depth)


def leaves(tree: tuple) -> list[tuple]:
    return [tree] if len(tree) == 1 else leaves(tree[2]) + leaves(tree[3])


def route(tree: tuple, fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf number, home fingerprints, visiting fingerprints) for every leaf that gets any.

    A pair that a boundary parts is looked for once: the inner point visits
    the outer side. Points that already are visitors follow every open branch.
    """
    number = iter(range(len(leaves(tree))))

    def walk(node: tuple, home: np.ndarray, guest: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if len(node) == 1:
            yield next(number), home, guest
            return
        v, mu, inner, outer = node
        dh, dg = (np.bitwise_count(x ^ v).astype(np.int16) for x in (home, guest))
        yield from walk(inner, home[dh <= mu], guest[dg - radius <= mu])
        over = home[(dh <= mu) & (dh + radius > mu)]
        yield from walk(outer, home[dh > mu], np.concatenate([over, guest[dg + radius > mu]]))

    for leaf, home, guest in walk(tree, fps, fps[:0]):
        if len(home) or len(guest):
            yield leaf, home, guest


class Forest:
    """Union-find over numpy arrays."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if (s == r).all():
                return r
            r = s

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.roots(i), self.roots(j)
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def close_pairs(vals: np.ndarray, q: np.ndarray, d: np.ndarray, radius: int, leaf: int = 512) -> Iterator[tuple]:
    """Index arrays (i, j) of pairs of q x d at most ``radius`` bits apart, block by block."""
    if not len(q) or not len(d):
        return
    if len(d) > leaf and len(q) * len(d) > PAIR_BLOCK:
        v = vals[d[len(d) // 2]]
        dd, dq = (np.bitwise_count(vals[x] ^ v).astype(np.int16) for x in (d, q))
        mu = int(np.median(dd))
        if not (dd > mu).any():
            mu -= 1
        if (dd <= mu).any():
            yield from close_pairs(vals, q[dq - radius <= mu], d[dd <= mu], radius, leaf)
            yield from close_pairs(vals, q[dq + radius > mu], d[dd > mu], radius, leaf)
            return
    step = max(1, PAIR_BLOCK // len(d))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        i, j = np.nonzero(np.bitwise_count(vals[part][:, None] ^ vals[d][None, :]) <= radius)
        if len(i):
            yield part[i], d[j]


def shard_links(home: np.ndarray, guest: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, its root in the shard) for every fingerprint that links within the shard."""
    vals, at = np.unique(np.concatenate([home, guest]), return_inverse=True)
    d = np.unique(at[: len(home)])
    forest = Forest(len(vals))
    for i, j in close_pairs(vals, np.arange(len(vals)), d, radius):
        forest.link(i, j)
    r = forest.roots(np.arange(len(vals)))
    moved = r != np.arange(len(vals))
    return vals[moved], vals[r[moved]]


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 18) -> Iterator[np.ndarray]:
    """The fingerprints of several batches at once, so that a shard gets few and long parts."""
    held, n = [], 0
    for b in batches:
        held.append(b.column(0).to_numpy().view(np.uint64))
        n += b.num_rows
        if n >= rows:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def pieces(fps: np.ndarray, n: int) -> list[np.ndarray]:
    """``fps`` cut into n pieces by their own value."""
    if n == 1:
        return [fps]
    at = (fps * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(33)) % np.uint64(n)
    order = np.argsort(at, kind="stable")
    return np.split(fps[order], np.searchsorted(at[order], np.arange(1, n, dtype=np.uint64)))


def deal_shards(tree: tuple, fps: np.ndarray, radius: int, cuts: dict[int, tuple[int, int]]) -> Iterator[list[tuple]]:
    """Per shard its rows (leaf, chunk, piece, home, guests); ``cuts`` has a shard's numbers of chunks and of pieces.

    Home rows are cut into chunks, visitors into pieces, and every chunk meets
    every piece. A chunk's rows also visit the chunks before it.
    """
    for leaf, home, guest in route(tree, fps, radius):
        if leaf not in cuts:
            continue
        n, m = cuts[leaf]
        own = (home * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(n)
        rows = []
        for c in range(n):
            mine, visits = home[own == c], pieces(np.concatenate([guest, home[own > c]]), m)
            rows += [(leaf, c, p, mine.tobytes(), x.tobytes()) for p, x in enumerate(visits) if len(mine) or len(x)]
        if rows:
            yield rows


def labelled(
    docs: DataFrame, id_col: str, text_col: str, words_per_shingle: int, max_bits: int, shard_rows: int, sample_rows: int, guest_rows: int
) -> DataFrame:
    """(id, digest, fp, component, component_id): component is the component's own key, a fingerprint."""
    fps = staged(fingerprints(docs, id_col, text_col, words_per_shingle), "simhash")
    classes = staged(fps.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-classes")
    total = classes.count()
    home_rows = max(shard_rows, min(total // SHARDS, MOST_HOME))
    depth = max(0, math.ceil(math.log2(max(1, total) / home_rows)))
    rows = min(max(sample_rows, 16 << depth), MOST_SAMPLE)
    picked = classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(rows).collect()
    sample = np.array([r.fp for r in picked], dtype=np.int64).view(np.uint64)
    tree = build_tree(sample, depth)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches):
            cols = list(zip(*((leaf, len(home), len(guest)) for leaf, home, guest in route(tree, part, max_bits)), strict=True))
            kinds = [pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["leaf", "homes", "guests"])

    # One row a shard comes to the driver. A shard that no row calls home has no pair to look for.
    load = classes.select("fp").mapInArrow(count, "leaf int, homes long, guests long").groupBy("leaf").agg(F.sum("homes").alias("homes"), F.sum("guests").alias("guests"))
    cuts = {}
    for r in load.where("homes > 0").collect():
        chunks = math.ceil(r.homes / (4 * home_rows))
        cuts[r.leaf] = (chunks, max(1, math.ceil((r.guests + (r.homes if chunks > 1 else 0)) / guest_rows)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        for part in gathered(batches):
            for rows in deal_shards(tree, part, max_bits, cuts):
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["leaf", "chunk", "piece", "home", "guest"])

    def link(pdf):
        import pandas as pd

        home, guest = (np.frombuffer(b"".join(pdf[c]), np.uint64) for c in ("home", "guest"))
        a, b = shard_links(home, guest, max_bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = classes.select("fp").mapInArrow(deal, "leaf int, chunk int, piece int, home binary, guest binary")
    edges = dealt.groupBy("leaf", "chunk", "piece").applyInPandas(link, "a long, b long")
    linked = connected_components(edges, "a", "b")
    known = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("component")
    )
    first = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = known.join(first, "component").select("fp", "component", "component_id")
    return fps.join(of, "fp").select("id", "digest", "fp", "component", "component_id")


def components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_per_shingle: int = 4,
    max_bits: int = 4,
    shard_rows: int = 4096,
    sample_rows: int = 8192,
    guest_rows: int = MOST_GUESTS,
) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``.

    Texts whose fingerprints differ in at most ``max_bits`` bits are linked;
    component_id is the smallest id reachable. Null and word-less texts have
    fingerprint zero and link like any other. A null id never becomes a
    component's id unless the component has no other; repeated rows are kept.
    An empty table gives an empty result; columns other than the two named are
    not read. The sample shapes the tree and bears on speed alone; it has
    ``sample_rows`` rows, or 16 a shard where that is more, up to 2^20.
    """
    return labelled(docs, id_col, text_col, words_per_shingle, max_bits, shard_rows, sample_rows, guest_rows).select("id", "fp", "component_id")


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint (16 hex digits) and component."""
    from veilgrid.llm.common import read

    out = components(read(spark, sf_dir, "documents"), words_per_shingle=4, max_bits=4)
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that ``df`` has no column of."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_per_shingle: int = 4,
    max_bits: int = 4,
    shard_rows: int = 4096,
    sample_rows: int = 8192,
    guest_rows: int = MOST_GUESTS,
) -> DataFrame:
    """``docs`` with one document of each component: the one that has the smallest id.

    Rows are told apart by id and text: rows that share an id but not a
    component stay, one of each component. Where several texts of a component
    share its smallest id, the text of the smallest xxhash64 stays; of rows
    that repeat both, the one whose columns have the smallest xxhash64. Rows
    without an id all stay.
    """
    comp = labelled(docs, id_col, text_col, words_per_shingle, max_bits, shard_rows, sample_rows, guest_rows)
    heads = comp.where(F.col("id") == F.col("component_id")).groupBy("component", "id").agg(F.min("digest").alias("digest"))
    digest, nth = unused(docs, "digest"), unused(docs, "nth")
    heads = heads.select(F.col("id").alias(id_col), F.col("digest").alias(digest)).distinct()
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    kept = docs.withColumn(digest, F.xxhash64(text_col)).join(heads, [id_col, digest], "left_semi")
    one = Window.partitionBy(id_col, digest).orderBy(F.xxhash64(*hashed))
    kept = kept.withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1).select(*docs.columns)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
