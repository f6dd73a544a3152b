"""Best-fit packing under several capacities.

A sequence has three capacities: tokens, documents, and attention cost (the
sum of squared piece lengths). Pieces of one length are interchangeable, so
the vector best-fit runs on the histogram of lengths, which holds at most
``max_tokens`` rows whatever the corpus: lengths go from long to short, open
sequences of equal residual form one state, and a length goes to the state
that its residual vector scores best after the placement. The plan says which
ranks of a length go where; a piece finds its place by its rank among the
pieces of its length, from a counter per task and an offset per task and
length. No piece passes through the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.llm.common import read, staged

# Characters on which the two readers of the vocabulary below cannot differ in what is a letter, number or space.
PLAIN = r"[\t-\r -~\xa1-ɏ‐-‧‰-⁞₠-₿]*"
SPECIAL = "<|endoftext|>"


class Encoder:
    """Token ids as ``tokenizers`` gives them for ``{name}.json``, without added special tokens.

    ``{name}.tiktoken`` holds the same vocabulary for a reader several times
    as fast; it takes the texts made of plain characters and without the
    special string, all others go to ``tokenizers``. A test holds the ids
    against each other.
    """

    def __init__(self, name: str):
        import base64
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain = re.compile(PLAIN).fullmatch

    def ids(self, text: str) -> list[int]:
        if SPECIAL in text or not self.plain(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones, the first may be shorter."""
    first = n % most or most
    return [(0, first)] + [(s, most) for s in range(first, n, most)]


@dataclass
class State:
    """Open sequences that hold the same pieces: residual tokens, documents, attention; how many; (length, count)s."""

    tokens: int
    docs: int
    attention: int
    bins: int
    held: tuple

    def room(self, length: int) -> int:
        return min(self.tokens // length, self.docs, self.attention // (length * length))

    def put(self, length: int, count: int, bins: int) -> State:
        return State(
            self.tokens - length * count,
            self.docs - count,
            self.attention - length * length * count,
            bins,
            (*self.held, (length, count)),
        )


def best_fit(histogram: dict[int, int], caps: tuple[int, int, int], weights=(1.0, 0.05, 0.05), rule="norm") -> list[State]:
    """The sequences, as states, that take all pieces of the histogram.

    ``rule``: "norm" chooses the state with the least weighted norm of the
    residual after the placement, "dot" the one with the greatest weighted
    dot-product of the piece's needs and the residual. Ties go to the state
    opened first.
    """
    empty = State(*caps, 0, ())
    states: list[State] = []

    def score(s: State, length: int) -> float:
        need = (length / caps[0], 1 / caps[1], length * length / caps[2])
        left = (s.tokens / caps[0], s.docs / caps[1], s.attention / caps[2])
        if rule == "dot":
            return -sum(w * a * b for w, a, b in zip(weights, need, left, strict=True))
        k = s.room(length)
        return sum(w * (b - k * a) ** 2 for w, a, b in zip(weights, need, left, strict=True))

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        k0 = empty.room(length)
        if k0 < 1:
            raise ValueError(f"a piece of {length} tokens fits no sequence of capacities {caps}")
        open_, out = [], []
        for s in states:
            (open_ if s.room(length) else out).append(s)
        for s in sorted(open_, key=lambda s: score(s, length)):
            if not todo:
                out.append(s)
                continue
            k = s.room(length)
            full = min(s.bins, todo // k)
            if full:
                out.append(s.put(length, k, full))
            rest = todo - full * k if s.bins > full else 0
            todo -= full * k
            if 0 < rest < k:
                out.append(s.put(length, rest, 1))
                todo -= rest
                full += 1
            if s.bins > full:
                out.append(State(s.tokens, s.docs, s.attention, s.bins - full, s.held))
        if todo // k0:
            out.append(empty.put(length, k0, todo // k0))
        if todo % k0:
            out.append(empty.put(length, todo % k0, 1))
        states = out
    return states


def places(states: list[State]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, pieces per sequence, offset in the sequence), by rank."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    base = 0
    for s in states:
        at = 0
        for length, count in s.held:
            rank = used.get(length, 0)
            rows.setdefault(length, []).append((rank, base, count, at))
            used[length] = rank + s.bins * count
            at += length * count
        base += s.bins
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = 1024,
    max_docs: int = 1024,
    max_attention: int = 1024 * 1024,
    tokenizer: str = "byte_bpe_50k",
    end_id: int = 2,
    rule: str = "norm",
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row.

    Null text is empty and gives one piece with the end id alone. Rows with a
    null or repeated id are packed like any other. An empty table gives an
    empty result. Other columns are not read.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, task = None, {}, TaskContext.get().partitionId()
        names = ["id", "piece", "start", "length", "ids_crc32", "task", "rank"]
        for b in batches:
            enc = enc or Encoder(tokenizer)
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                owner, rows = [], []
                for i in range(part.num_rows):
                    ids = enc.ids(part.column(1)[i].as_py() or "")
                    ids.append(end_id)
                    raw = np.array(ids, dtype="<u4")
                    for k, (s, n) in enumerate(cut(len(raw), max_tokens)):
                        rank = seen.get(n, 0)
                        seen[n] = rank + 1
                        owner.append(i)
                        rows.append((k, s, n, zlib.crc32(raw[s : s + n].tobytes()), task, rank))
                cols = np.array(rows, dtype=np.int64).reshape(-1, 6).T
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner, pa.int64()))] + [pa.array(c).cast(t) for c, t in zip(cols, kinds, strict=True)],
                    names,
                )

    kind = dict(docs.dtypes)[id_col]
    cut_up = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        pieces, f"id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long"
    )
    cut_up = staged(cut_up, "pieces")
    counts = cut_up.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = places(best_fit(histogram, (max_tokens, max_docs, max_attention), rule=rule))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("at").to_numpy()
            seq, off = np.empty_like(rank), np.empty_like(rank)
            for n in np.unique(length):
                rows, mine = plan[int(n)], length == n
                row = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1]
                inner = rank[mine] - row[:, 0]
                seq[mine] = row[:, 1] + inner // row[:, 2]
                off[mine] = row[:, 3] + inner % row[:, 2] * n
            cols = [b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(seq), pa.array(off)],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = cut_up.join(starts, ["length", "task"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("first")).alias("at"))
    return ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return pack(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
