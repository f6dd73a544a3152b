"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a label. Emissions are sums of learned weights of
the word's character n-grams between word marks (so those at a mark are
affixes) and of the whole word (the lexicon); transitions are learned too.
Training sequences are short stretches of labelled documents strung together,
so the chain sees switches of language. Forward-backward gives each word's
marginals over the whole text; a document's language is the label with the
largest sum of marginals, its score that label's share.

The model is fitted on the driver, on a bounded sample of labelled rows; the
weights are a table of fixed size. Everything else runs on all rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.functions.joins import broadcast_if_small
from veilgrid.llm.common import read, staged

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4)
MEMO_WORDS = 300_000
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word number) of all n-grams of the marked words and of the words themselves."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    flat = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    feats, owners = [], []
    h = np.zeros(len(flat), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(flat) - n + 1] * np.uint64(0x100000001B3) + flat[n - 1 :]
        inside = owner[: len(h)] == owner[n - 1 :]
        if n in ORDERS:
            mixed = (h ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            feats.append((mixed[inside] >> np.uint64(40)) % np.uint64(BUCKETS))
            owners.append(owner[: len(h)][inside])
        h = np.where(inside, h, np.uint64(0))
    ends = np.cumsum(size)
    # The whole word: sum of its characters times powers of the place, in one reduce.
    place = np.arange(len(flat)) - np.repeat(ends - size, size)
    power = np.cumprod(np.full(int(size.max(initial=1)) + 1, 0x100000001B3, np.uint64))
    whole = np.add.reduceat(flat * power[place], ends - size) if len(words) else np.zeros(0, np.uint64)
    feats.append(((whole * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(BUCKETS))
    owners.append(np.arange(len(words)))
    return np.concatenate(feats).astype(np.int64), np.concatenate(owners)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # BUCKETS x labels
    moves: np.ndarray  # labels x labels, log scale
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.labels)), np.float32)
        for at in range(0, len(words), 50_000):
            feats, owner = ngrams(words[at : at + 50_000])
            n = min(50_000, len(words) - at)
            for k in range(len(self.labels)):
                out[at : at + n, k] = np.bincount(owner, self.weights[feats, k], n)
        return out


def marginal_sums(scores: np.ndarray, size: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Per text, the sum of its words' marginals. scores: words x labels, text after text; all texts advance together."""
    total = np.zeros((len(size), scores.shape[1]), np.float64)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    first = (np.cumsum(size[np.argsort(order)]) - size[np.argsort(order)])[order]
    x = np.exp(scores - scores.max(1, keepdims=True, initial=-np.inf)).astype(np.float32)
    step, init = np.exp(moves).astype(np.float32), np.exp(start).astype(np.float32)
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest + 1), "left")  # texts with more than t words
    alpha = np.empty_like(x)
    a = np.empty((0, 0), np.float32)
    for t in range(longest):
        at = first[: active[t]] + t
        a = x[at] * (a[: active[t]] @ step if t else init)
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    b = np.ones((len(size), x.shape[1]), np.float32)
    sums = np.zeros((len(size), x.shape[1]), np.float64)
    for t in range(longest - 1, -1, -1):
        k, on = active[t], active[t + 1]
        if on:
            c = (x[first[:on] + t + 1] * b[:on]) @ step.T
            b[:on] = c / c.sum(1, keepdims=True)
        g = alpha[first[:k] + t] * b[:k]
        sums[:k] += g / g.sum(1, keepdims=True)
    total[order] = sums
    return total


def fit(rows: list[tuple[str, str]], epochs: int = 4, length: int = 64, batch: int = 512, rate: float = 0.3, seed: int = 7) -> Model:
    """Model of (text, label) rows; no rows give a model without labels."""
    labels = sorted({y for _, y in rows})
    n_lab = len(labels)
    model = Model(labels, np.zeros((BUCKETS, n_lab), np.float32), np.zeros((n_lab, n_lab)), np.zeros(n_lab))
    if n_lab < 2:
        return model
    rng = np.random.default_rng(seed)
    number = {y: i for i, y in enumerate(labels)}
    vocab: dict[str, int] = {}
    pieces = []
    for text, y in rows:
        ids = [vocab.setdefault(w, len(vocab)) for w in words_of(text)]
        at = 0
        while at < len(ids):
            n = int(rng.integers(2, 25))
            pieces.append((ids[at : at + n], number[y]))
            at += n
    feats, owner = ngrams(list(vocab))
    order = np.argsort(owner, kind="stable")
    feats, owner = feats[order], owner[order]
    ends = np.searchsorted(owner, np.arange(len(vocab) + 1))
    grad2 = [np.full((BUCKETS, n_lab), 1e-6, np.float32), np.full((n_lab, n_lab), 1e-6), np.full(n_lab, 1e-6)]
    for _ in range(epochs):
        words, gold = [], []
        for i in rng.permutation(len(pieces)):
            words += pieces[i][0]
            gold += [pieces[i][1]] * len(pieces[i][0])
        words += words[: -len(words) % length]
        gold += gold[: len(words) - len(gold)]
        whole = len(words) - len(words) % length
        w, g = np.array(words[:whole]).reshape(-1, length), np.array(gold[:whole]).reshape(-1, length)
        for at in range(0, len(w), batch):
            _step(model, w[at : at + batch], g[at : at + batch], feats, ends, grad2, rate)
    return model


def _step(model: Model, w: np.ndarray, g: np.ndarray, feats: np.ndarray, ends: np.ndarray, grad2: list, rate: float) -> None:
    """One AdaGrad step on the log-likelihood of sequences ``w`` (word ids) with labels ``g``."""
    n_lab = len(model.labels)
    types, inverse = np.unique(w, return_inverse=True)
    inverse = inverse.reshape(w.shape)
    count = ends[types + 1] - ends[types]
    own = np.repeat(np.arange(len(types)), count)
    idx = feats[np.repeat(ends[types] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
    emit = np.stack([np.bincount(own, model.weights[idx, k], len(types)) for k in range(n_lab)], 1)
    x = emit[inverse]
    x = np.exp(x - x.max(2, keepdims=True))
    step, init = np.exp(model.moves), np.exp(model.start)
    n, length = w.shape
    alpha, beta, norm = np.empty_like(x), np.ones_like(x), np.empty((n, length))
    for t in range(length):
        a = x[:, t] * (alpha[:, t - 1] @ step if t else init)
        norm[:, t] = a.sum(1)
        alpha[:, t] = a / norm[:, t : t + 1]
    moved = np.zeros((n_lab, n_lab))
    for t in range(length - 2, -1, -1):
        right = x[:, t + 1] * beta[:, t + 1] / norm[:, t + 1 : t + 2]
        beta[:, t] = right @ step.T
        moved += step * (alpha[:, t].T @ right)
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    gold = np.eye(n_lab)[g]
    seen = np.zeros((n_lab, n_lab))
    np.add.at(seen, (g[:, :-1].ravel(), g[:, 1:].ravel()), 1)
    err = (gold - gamma).reshape(-1, n_lab) / w.size
    by_type = np.stack([np.bincount(inverse.ravel(), err[:, k], len(types)) for k in range(n_lab)], 1)
    grads = [
        np.stack([np.bincount(idx, by_type[own, k], BUCKETS) for k in range(n_lab)], 1).astype(np.float32),
        (seen - moved) / w.size,
        (gold[:, 0] - gamma[:, 0]).sum(0) / n,
    ]
    for param, grad, acc in zip((model.weights, model.moves, model.start), grads, grad2, strict=True):
        acc += grad * grad
        param += rate * grad / np.sqrt(acc)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int, chars: int, least: int = 4) -> list[tuple[str, str]]:
    """At most ``rows`` labelled (text, label) rows outside the held-out fold, as many of each label as there are, by hash order.

    Every label has its share, ``least`` rows at least: more than rows / least
    labels take more rows. Of a longer text a stretch of ``chars`` characters
    is learned from, which begins where a hash of the id says.
    """
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5
    known = docs.where((fold != 0) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labels = known.groupBy(F.col(lang_col).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    each = max(least, rows // max(1, labels.count()))
    mixed = F.xxhash64(F.col(id_col).cast("string"))
    order = Window.partitionBy("y").orderBy("k")
    # Ranked without their texts, and every task hands on no more than a label's share.
    keys = known.select(F.pmod(mixed, F.lit(1 << 30)).alias("k"), F.col(lang_col).alias("y"))
    keys = staged(keys.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each).select("k", "y").distinct(), "langid-sample")
    start = F.pmod(mixed, F.greatest(F.length(text_col) - chars + 1, F.lit(1))).cast("int")
    texts = known.select(F.pmod(mixed, F.lit(1 << 30)).alias("k"), F.col(lang_col).alias("y"), F.col(text_col).substr(start + 1, F.lit(chars)).alias("t"))
    taken = texts.join(broadcast_if_small(keys), ["k", "y"]).withColumn("rank", F.row_number().over(order.orderBy("k", "t"))).where(F.col("rank") <= each)
    return [(r.t, r.y) for r in taken.orderBy("k", "t", "y").collect()]


class Labeller:
    """Labels texts, with the emissions of words seen before at hand."""

    def __init__(self, model: Model):
        self.model = model
        self.memo: dict[str, int] = {}
        self.table = np.zeros((0, len(model.labels)), np.float32)

    def label(self, column: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(label, score) of each text."""
        model = self.model
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.table = {}, self.table[:0]
        memo, parts = self.memo, []
        for t in column:
            # Words turn into numbers text by text, so that only the distinct ones stay in memory.
            parts.append(np.array([memo.setdefault(w, len(memo)) for w in words_of(t.as_py())], np.int32))
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        if not model.labels:
            return pa.array([UNKNOWN] * len(parts), pa.string()), pa.array(np.zeros(len(parts)))
        new = list(itertools.islice(memo, len(self.table), None))
        self.table = np.concatenate([self.table, model.emissions(new)])
        ids = np.concatenate([np.zeros(0, np.int32), *parts])
        share = marginal_sums(self.table[ids], size, model.moves, model.start) / np.maximum(size, 1)[:, None]
        score = np.where(size > 0, share.max(1).clip(0, 1), 0.0)
        langs = [model.labels[k] if n else UNKNOWN for k, n in zip(share.argmax(1), size, strict=True)]
        return pa.array(langs, pa.string()), pa.array(score)


def predict(docs: DataFrame, model: Model, text_col: str, *carry: str) -> DataFrame:
    """(row, lang_pred, score) for every row; row is a struct of the columns ``carry``."""
    cols = dict.fromkeys([*carry, text_col])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                row = b.column(0).slice(at, 1024)
                lang, score = labeller.label(row.field(list(cols).index(text_col)))
                parts = {c: row.field(i) for i, c in enumerate(cols) if c in carry}
                row = pa.StructArray.from_arrays(list(parts.values()), list(parts))
                yield pa.RecordBatch.from_arrays([row, lang, score], ["row", "lang_pred", "score"])

    kind = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")).dtypes[0][1]
    return rows.mapInArrow(run, f"row {kind}, lang_pred string, score double")


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = 1600,
    sample_chars: int = 20_000,
    carry: list[str] | None = None,
) -> DataFrame:
    """(row, lang_pred, score) for every row, from a model of the table's own labelled rows.

    ``row`` is a struct of the columns ``carry`` (the id alone if None).
    Learns from at most ``sample_rows`` texts (four of every label at least),
    of a longer one from a stretch of ``sample_chars`` characters, with a
    non-null label, whose id's crc32 is not divisible by 5.
    A null text or one without a letter is ``und`` with score 0; so is every
    row if there is no label to learn from. Null and repeated ids are kept as
    they are. An empty table gives an empty result.
    """
    model = fit(sample(docs, id_col, text_col, lang_col, sample_rows, sample_chars))
    return predict(docs, model, text_col, *(carry or [id_col]))


def keep_known(docs: DataFrame, least: float = 0.3, **kw) -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or scores below ``least``; all columns stay as they are."""
    out = identify(docs, carry=docs.columns, **kw)
    return out.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's predicted language; held_out marks the fold that takes no part in the fit."""
    out = identify(read(spark, sf_dir, "documents"))
    held = F.coalesce(F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("row.doc_id", held.alias("held_out"), "lang_pred", "score")
