"""Embedding whitening by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance V of all vectors come from products
V Q with a thin block Q alone; V itself is never formed. One product is one
pass over the table: every task adds up Xc'(Xc Q) of its centred rows, and the
sums meet in a shuffle, so the driver sees one block of dimensions x columns.
A round applies the Chebyshev polynomial that is small over the unwanted end
of the spectrum, from a lower bound (a Lanczos step rides along with every pass) to
the smallest Ritz value of the block, by its three-term recurrence; QR makes the block orthogonal, and Rayleigh-Ritz turns
it to eigenvector estimates. Rounds end when the residuals |V q - e q| of all
wanted vectors are certified below ``tolerance`` of the largest eigenvalue. A
block that does not get there in a few rounds grows, at the latest to all
dimensions, where one product is exact.

Vectors are integers and centred as such (x less the whole part of the mean,
then its fraction), so a large common offset costs no digits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.common import read, staged

BLOCK_ROWS = 4096
GROWTH = 1e8  # largest ratio by which one filter may raise one Ritz vector over another
TINY = 1e-13  # eigenvalues below this share of the largest count as zero


def finite(vec: str):
    """The vector is there and holds finite components only."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col(vec).isNotNull() & ok, F.lit(False))


def quantised(vec: str, scale: int = 64, offset: int = 1_000_000):
    """floor(scale * c) + offset of every component, as long; beyond 2^52 either way it stays there."""
    edge = float(2**52)
    whole = lambda c: F.floor(F.greatest(F.lit(-edge), F.least(F.lit(edge), F.lit(float(scale)) * c.cast("double"))))
    return F.transform(vec, lambda c: whole(c) + F.lit(offset).cast("long"))


def packed(vectors: DataFrame, dim: int) -> DataFrame:
    """(ids, rows, size): vectors in blocks, a matrix as bytes in the narrowest integers that hold its offsets from the block's minimum."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_ROWS):
                one = b.slice(lo, BLOCK_ROWS)
                lists = one.column("vec")
                length = np.diff(lists.offsets.to_numpy())
                block = np.zeros((len(length), dim), np.int64)
                block[np.arange(dim) < length[:, None]] = lists.flatten().to_numpy()
                base = int(block.min(initial=0)) if block.size == 0 else int(block.min())
                kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if k is np.int64 or int(block.max(initial=base)) - base <= np.iinfo(k).max)
                if kind is np.int64:
                    base = 0
                rows = (block - base).astype(kind).tobytes()
                cols = [pa.array([one.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([rows], pa.binary()), pa.array([base]), pa.array([np.dtype(kind).str])]
                yield pa.RecordBatch.from_arrays(cols, ["ids", "rows", "base", "kind"])

    return vectors.mapInArrow(pack, "ids array<long>, rows binary, base long, kind string")


def blocks_of(batch: pa.RecordBatch, dim: int) -> Iterator[np.ndarray]:
    for rows, base, kind in zip(*(batch.column(c) for c in ("rows", "base", "kind")), strict=True):
        block = np.frombuffer(rows.as_buffer(), np.dtype(kind.as_py())).astype(np.int64) + base.as_py()
        yield block.reshape(-1, dim)


def summed(blocks: DataFrame, dim: int, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all blocks of ``part(block)``, an array of ``shape``.

    A task adds up its blocks and hands on one row per line of the array; lines
    are summed by a shuffle on their number, so no node meets more than one
    line of each task, and the driver gets one array.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for block in blocks_of(b, dim):
                total += part(block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0], dtype=np.int32)), pa.array(list(total))], ["line", "row"])

    lines = blocks.select("rows", "base", "kind").mapInArrow(run, "line int, row array<double>")
    sums = F.array(*[F.sum(F.col("row")[k]) for k in range(shape[1])])
    out = np.zeros(shape)
    for r in lines.groupBy("line").agg(sums.alias("row")).collect():
        out[r.line] = r.row
    return out


def exact_sums(blocks: DataFrame, dim: int) -> list[int]:
    """Sums of every dimension, as Python integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dim
        for b in batches:
            for block in blocks_of(b, dim):
                # 4096 rows of 52 bits and a sign could leave a long: halves are summed apart.
                high, low = block >> 32, block & 0xFFFFFFFF
                total = [t + (int(h) << 32) + int(x) for t, h, x in zip(total, high.sum(0), low.sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array([str(t) for t in total])], ["line", "total"])

    lines = blocks.select("rows", "base", "kind").mapInArrow(run, "line int, total string")
    out = [0] * dim
    for r in lines.groupBy("line").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r.line] = int(r.total)
    return out


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: components by falling eigenvalue, numbered from 1."""

    n: int
    sums: list[int]
    axes: np.ndarray  # dimensions x components
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def centred(block: np.ndarray, whole: np.ndarray, fraction: np.ndarray) -> np.ndarray:
    return (block - whole).astype(float) - fraction


class WithFloor:
    """A product that also bounds the spectrum from below: one more column takes a Lanczos step in every pass."""

    def __init__(self, product: Callable[[np.ndarray], np.ndarray], dim: int, steps: int = 32):
        start = np.random.default_rng(11).standard_normal(dim)
        self.product, self.steps = product, min(steps, dim)
        self.basis, self.alpha, self.beta = [start / np.linalg.norm(start)], [], []

    def __call__(self, block: np.ndarray) -> np.ndarray:
        if len(self.alpha) == self.steps:
            return self.product(block)
        v = self.basis[-1]
        out = self.product(np.column_stack([block, v]))
        w = out[:, -1]
        self.alpha.append(float(v @ w))
        known = np.stack(self.basis, 1)
        for _ in range(2):
            w = w - known @ (known.T @ w)
        self.beta.append(float(np.linalg.norm(w)))
        if self.beta[-1] <= TINY * abs(self.alpha[-1]):
            self.steps = len(self.alpha)
        else:
            self.basis.append(w / self.beta[-1])
        return out[:, :-1]

    def floor(self) -> float:
        """The smallest Ritz value less the last residual; no eigenvalue is expected below. A wrong one costs rounds, not digits."""
        if len(self.alpha) < 2:
            return 0.0
        t = np.diag(self.alpha) + np.diag(self.beta[: len(self.alpha) - 1], 1) + np.diag(self.beta[: len(self.alpha) - 1], -1)
        return max(0.0, float(np.linalg.eigvalsh(t)[0]) - self.beta[len(self.alpha) - 1])


def filter_degree(top: float, wanted: float, low: float, cut: float, missing: float, most: int) -> int:
    """The degree that gains a factor of ``missing``, unless that raises the top vector over GROWTH times more than the last wanted one."""
    rate = lambda x: math.acosh(max(1.0, (2 * x - low - cut) / (cut - low)))
    spread = rate(top) - rate(wanted)
    enough = math.ceil(math.log(8 * max(1.0, missing)) / rate(wanted)) if rate(wanted) > 0 else most
    return max(2, min(most, enough, int(math.log(GROWTH) / spread) if spread > 0 else most))


def chebyshev(product: Callable[[np.ndarray], np.ndarray], block: np.ndarray, image: np.ndarray, top: float, low: float, cut: float, degree: int) -> np.ndarray:
    """p(V) block, where p is the Chebyshev polynomial of [low, cut], scaled to one at ``top``; ``image`` is V block."""
    half, mid = (cut - low) / 2, (cut + low) / 2
    sigma = first = half / (top - mid)
    before, now = block, (image - mid * block) * (sigma / half)
    for _ in range(degree - 1):
        nxt = 1 / (2 / first - sigma)
        before, now = now, (product(now) - mid * now) * (2 * nxt / half) - (sigma * nxt) * before
        sigma = nxt
    return now


def eigenpairs(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, oversample: int, tolerance: float, patience: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the ``wanted`` largest eigenvalues of a positive semidefinite operator, residuals certified."""
    width = min(dim, wanted + oversample)
    rng = np.random.default_rng(7)
    block = np.linalg.qr(rng.standard_normal((dim, width)))[0]
    product = WithFloor(product, dim) if width < dim else product
    for round_ in range(1, 100 * patience):
        image = product(block)
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)
        values, block, image = values[order], block @ turn[:, order], image @ turn[:, order]
        residual = np.linalg.norm(image - block * values, axis=0)[:wanted]
        if width == dim or residual.max() <= tolerance * max(values[0], 0.0):
            return values[:wanted], block[:, :wanted]
        if round_ % patience == 0:  # too close a spectrum at the block's end: a wider block moves the end away
            more = min(dim, width + max(oversample, width // 2))
            block = np.linalg.qr(np.concatenate([block, rng.standard_normal((dim, more - width))], 1))[0]
            width = more
            continue
        cut = values[-1]
        if cut <= TINY * values[0]:  # the rest of the spectrum is zero already
            block = np.linalg.qr(image)[0]
            continue
        low = product.floor()
        low = low if low < (1 - 1e-3) * cut else 0.0
        # the first rounds are short: their bounds are poor, and every pass improves the lower one
        missing = residual.max() / (tolerance * values[0])
        degree = filter_degree(values[0], values[wanted - 1], low, cut, missing, 8 if round_ <= 2 else 24)
        block = np.linalg.qr(chebyshev(product, block, image, values[0], low, cut, degree))[0]
    raise RuntimeError("subspace iteration did not settle")


def fit_blocks(blocks: DataFrame, n: int, dim: int, components: int, oversample: int | None, tolerance: float) -> Whitening:
    sums = exact_sums(blocks, dim)
    whole = np.array([s // n for s in sums], np.int64)
    fraction = np.array([(s % n) / n for s in sums])
    passes = [0]

    def product(q: np.ndarray) -> np.ndarray:
        passes[0] += 1

        def part(block: np.ndarray) -> np.ndarray:
            x = centred(block, whole, fraction)
            return x.T @ (x @ q)

        return summed(blocks, dim, part, q.shape) / n

    def squares(block: np.ndarray) -> np.ndarray:
        x = centred(block, whole, fraction)
        return np.stack([np.einsum("ij,ij->j", x, x), x.sum(0)])

    variance, rest = summed(blocks, dim, squares, (2, dim)) / n
    wanted = min(components, dim)
    values, axes = eigenpairs(product, dim, wanted, oversample if oversample is not None else max(8, wanted // 2), tolerance)
    there = values > TINY * max(values[0], 0.0)
    values, axes = values[there], axes[:, there]
    mean = rest @ axes / np.sqrt(values)  # of the whitened rows: rounding alone

    def spread(block: np.ndarray) -> np.ndarray:
        w = centred(block, whole, fraction) @ axes / np.sqrt(values) - mean
        return w.T @ w

    error = 0.0
    if len(values):
        error = float(np.abs(summed(blocks, dim, spread, (len(values),) * 2) / n - np.eye(len(values))).max())
    return Whitening(n, sums, axes, values, float(variance.sum()), error, passes[0])


def whiten(
    vectors: DataFrame, id_col: str, vec_col: str, components: int = 32, oversample: int | None = None, tolerance: float = 1e-13
) -> tuple[Whitening | None, DataFrame]:
    """(fit, rows): rows are (id, whitened array<double>, deviation) of all vectors.

    ``vec_col`` holds arrays of integers below 2^53 (see ``quantised``). Rows
    whose vector is null or holds a null are dropped; a shorter vector, an
    empty one too, counts as padded with zeros. ``deviation`` is the exact
    n^2-fold squared distance from the mean, null where it does not fit a long.
    Components whose eigenvalue is zero are left out, so equal vectors give
    none. Repeated rows and ids are rows of their own, a null id stays. An empty
    table gives no fit and no rows; columns other than the two are not read.
    """
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<long>").alias("vec"))
    src = src.where(F.coalesce(F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull()), F.lit(False)))
    n, dim = src.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    kind = "id long, whitened array<double>, deviation long"
    if not n or not dim:
        return None, vectors.sparkSession.createDataFrame([], kind) if not n else src.select("id", F.array().cast("array<double>").alias("whitened"), F.lit(0).cast("long").alias("deviation"))
    blocks = staged(packed(src, dim), "whitening-blocks")
    fit = fit_blocks(blocks, n, dim, components, oversample, tolerance)
    whole = np.array([s // n for s in fit.sums], np.int64)
    part = [s % n for s in fit.sums]
    fraction, remainder = np.array([p / n for p in part]), np.array(part, np.int64)
    axes, scale = fit.axes, np.sqrt(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, block in zip(b.column("ids"), blocks_of(b, dim), strict=True):
                w = (centred(block, whole, fraction) @ axes) / scale
                apart = block - whole  # n*x - S = n * apart - remainder
                if (int(np.abs(apart).max(initial=0)) + 1) ** 2 * n * n * dim < 2**63:
                    off = n * apart - remainder
                    deviation = (off * off).sum(1).tolist()
                else:
                    off = n * apart.astype(object) - remainder
                    deviation = [x if x < 2**63 else None for x in (off * off).sum(1).tolist()]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([ids.values, flat, pa.array(deviation, pa.int64())], ["id", "whitened", "deviation"])

    return fit, blocks.mapInArrow(run, kind)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """Every usable vector's whitened components, with the fit's figures."""
    vectors = read(spark, sf_dir, "embeddings").where(finite("embedding")).select("vec_id", quantised("embedding").alias("vec"))
    fit, rows = whiten(vectors, "vec_id", "vec", components=32)
    explained = F.array(*[F.lit(float(x)) for x in (fit.explained if fit else [])]).cast("array<double>")
    rows = rows.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(fit.n if fit else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(fit.identity_error if fit else 0.0).alias("identity_error"),
    )
