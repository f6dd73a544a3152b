"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Texts are cut into words (a run of spaces belongs to the word after it; no
piece has a space after another character, nor a line end). Distinct words of equal length
advance together, one character at a time: the hashes of all substrings that
end there probe the sorted piece keys, each hit that may follow the best
path's last piece competes, and the maximum's length is the backpointer.

The vocabulary is a BPE one, whose right result is not the path of the highest
sum of scores but the outcome of its merges. A sequence of pieces is that
outcome exactly if every two neighbours alone would stay apart, so the
transition score is 0 for such neighbours and minus infinity for others, and
one path is left per prefix. Whether two pieces stay apart is found by undoing
their merges from the latest on, for all pairs of a step at once.

Characters without a piece become byte pieces; decoding turns them back.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.common import read

SPACE = "▁"
PRIME = 0x100000001B3
MIX = 0x9E3779B97F4A7C15
SLOT_BITS = 19
MEMO_WORDS = 800_000
LONG_WORD = 48


def codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def extend(h: np.ndarray, char: np.ndarray) -> np.ndarray:
    """Hash of a substring with one more character in front."""
    return (h * np.uint64(PRIME)) ^ ((char + np.uint64(1)) * np.uint64(MIX))


def key_of(piece: str) -> int:
    h = np.zeros(1, np.uint64)
    for c in codes([piece])[::-1]:
        h = extend(h, np.array([c], np.uint64))
    return int(h[0])


def merge_all(text: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """BPE of ``text`` by repeated merging: the pieces, and the parts of the last merge."""
    parts, last = list(text), None
    while len(parts) > 1:
        best = min(((rank.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=None)
        if best is None or best[0] == 1 << 30:
            break
        i = best[1]
        last = (parts[i], parts[i + 1])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts, last


def slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per leading bits: the place of the first sorted key that has them (-1 if none), and whether others follow."""
    slot = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    first = np.full(1 << SLOT_BITS, -1, np.int32)
    first[slot[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
    return first, np.bincount(slot, minlength=1 << SLOT_BITS) > 1


def found(h: np.ndarray, keys: np.ndarray, first: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of h that are among the sorted keys, their places there)."""
    slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    at = first[slot]
    rows = np.nonzero(at >= 0)[0]
    at = at[rows]
    same = keys[at] == h[rows]
    more = np.nonzero(~same & shared[slot[rows]])[0]
    if len(more):
        at[more] = np.minimum(np.searchsorted(keys, h[rows[more]]), len(keys) - 1)
        same[more] = keys[at[more]] == h[rows[more]]
    return rows[same], at[same]


class Pieces:
    """The vocabulary's tables: plain arrays, built once on the driver.

    A node is a piece that merging can make, or a single character; rank 0 is a
    character, a merged piece has its place in the order of merges. ``left``
    and ``right`` are the nodes of its last merge.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        text = {i: sp.id_to_piece(i) for i in plain}
        order = sorted((i for i in plain if len(text[i]) > 1), key=lambda i: (-sp.get_score(i), i))
        rank = {text[i]: r + 1 for r, i in enumerate(order)}
        single = {t: i for i, t in text.items() if len(t) == 1}
        self.byte_ids = np.full(256, -1, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
        names = sorted(set("".join(text.values())))
        nodes = {c: k for k, c in enumerate(names)}
        split = {}
        for i in order:
            parts, last = merge_all(text[i], rank)
            if len(parts) == 1 and all(p in nodes for p in last):
                split[text[i]] = last
                nodes[text[i]] = len(nodes)
        self.rank = np.zeros(len(nodes), np.int32)
        self.left, self.right = np.arange(len(nodes)), np.arange(len(nodes))
        self.ids = np.full(len(nodes), -1, np.int32)  # -1: a character without a piece of its own
        keys = np.zeros(len(nodes), np.uint64)
        for t, k in nodes.items():
            keys[k] = key_of(t)
            self.ids[k] = single.get(t, -1)
            if t in split:
                self.rank[k], self.left[k], self.right[k] = rank[t], nodes[split[t][0]], nodes[split[t][1]]
        for i in order:
            if text[i] in nodes:
                self.ids[nodes[text[i]]] = i
        at = np.argsort(keys)
        self.keys, self.node_of_key = keys[at], at.astype(np.int32)
        self.nodes = nodes
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        # Which two nodes merge to a third: sorted pairs with the rank of the outcome.
        pairs = []
        by_text = {t: k for t, k in nodes.items()}
        for t, r in rank.items():
            pairs += [(by_text[t[:c]] * len(nodes) + by_text[t[c:]], r) for c in range(1, len(t)) if t[:c] in by_text and t[c:] in by_text]
        mixed = np.array([p for p, _ in pairs], np.uint64) * np.uint64(MIX)
        at = np.argsort(mixed)
        self.pair_keys, self.pair_rank = mixed[at], np.array([r for _, r in pairs], np.int32)[at]
        self.longest = max(map(len, nodes))
        # Words: spaces and what follows them. Line ends and tabs that no piece holds stand by themselves.
        alone = "".join(c for c in "\n\t\r" if c not in nodes)
        self.word = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]+" if alone else ""))
        self.surface = [b""] * n
        for i in plain:
            self.surface[i] = text[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            if i >= 0:
                self.surface[i] = bytes([b])
        # Neighbouring characters that no piece holds: a cut there parts no merge.
        self.inner = np.unique(np.array([ord(a) << 32 | ord(b) for t in nodes for a, b in zip(t, t[1:], strict=False)], np.int64))

    @functools.cached_property
    def piece_slots(self) -> tuple[np.ndarray, np.ndarray]:
        return slots(self.keys)

    @functools.cached_property
    def pair_slots(self) -> tuple[np.ndarray, np.ndarray]:
        return slots(self.pair_keys)

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Node of each hash, -1 if none."""
        out = np.full(len(h), -1, np.int32)
        rows, at = found(h, self.keys, *self.piece_slots)
        out[rows] = self.node_of_key[at]
        return out

    def merges(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether neighbours a, b merge before ``limit``."""
        out = np.zeros(len(a), bool)
        rows, at = found((a * len(self.rank) + b).astype(np.uint64) * np.uint64(MIX), self.pair_keys, *self.pair_slots)
        out[rows] = self.pair_rank[at] < limit[rows]
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves nodes a, b (neighbours) as they are."""
        ok = np.ones(len(a), bool)
        todo = np.arange(len(a))
        a, b, limit = a.astype(np.int64), b.astype(np.int64), np.full(len(a), 1 << 30)
        while len(todo):
            merged = self.merges(a, b, limit)
            ok[todo[merged]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = np.nonzero(~merged & ((ra > 0) | (rb > 0)))[0]
            todo, a, b, ra, rb = todo[go], a[go], b[go], ra[go], rb[go]
            # The later merge is undone first; of equal ones the right one is later.
            undo = ra > rb
            limit = np.where(undo, ra, rb + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return ok

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces per word, all nodes) of words of one length; -1 is a character that no piece holds."""
        n, m = len(words[0]), len(words)
        chars = codes(words).reshape(m, n).T.copy()
        step = np.zeros((n + 1, m), np.int8)  # backpointer: length of the last piece
        node = np.full((n + 1, m), -1, np.int32)
        reached = np.zeros((n + 1, m), bool)
        reached[0] = True
        for j in range(1, n + 1):
            h = np.zeros(m, np.uint64)
            for size in range(1, min(j, self.longest) + 1):
                i = j - size
                h = extend(h, chars[i])
                found = self.probe(h)
                if size == 1:
                    # An unknown character stands alone, whatever its neighbours.
                    lone = (found < 0) & reached[i]
                    step[j, lone], reached[j, lone] = 1, True
                rows = np.nonzero((found >= 0) & reached[i])[0]
                if not len(rows):
                    continue
                last, now = node[i, rows], found[rows]
                fits = last < 0
                fits[~fits] = self.apart(last[~fits], now[~fits])
                rows, now = rows[fits], now[fits]
                step[j, rows], node[j, rows], reached[j, rows] = size, now, True
        # All words walk back together; a column per step, from the last piece on.
        count, at, live, cols = np.zeros(m, np.int64), np.full(m, n), np.arange(m), []
        while len(live):
            col = np.full(m, -2, np.int32)
            col[live] = node[at[live], live]
            cols.append(col)
            count[live] += 1
            at[live] -= step[at[live], live]
            live = live[at[live] > 0]
        back = np.stack(cols[::-1], 1)
        return count, back[back > -2]

    def viterbi_alone(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long word, where a pass over columns of one row would cost more than plain steps."""
        n, find, known = len(word), self.nodes.get, {}
        step, node = [0] * (n + 1), [-1] * (n + 1)
        reached = [True] + [False] * n
        for j in range(1, n + 1):
            for size in range(1, min(j, self.longest) + 1):
                i = j - size
                if not reached[i]:
                    continue
                k = find(word[i:j], -1)
                if k < 0:
                    if size == 1:
                        step[j], reached[j] = 1, True
                    continue
                pair = (node[i], k)
                if pair[0] >= 0:
                    if pair not in known:
                        known[pair] = bool(self.apart(np.array(pair[:1]), np.array(pair[1:]))[0])
                    if not known[pair]:
                        continue
                step[j], node[j], reached[j] = size, k, True
        out, at = [], n
        while at:
            out.append(node[at])
            at -= step[at]
        return np.array([len(out)]), np.array(out[::-1], np.int32)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids per word, all ids) of the words, in order."""
        parts = {k: p for k, w in enumerate(words) if len(w) > LONG_WORD and len(p := self.cut(w)) > 1}
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if k not in parts:
                by_size.setdefault(len(w), []).append(k)
        pieces: list = [None] * len(words)
        if parts:
            short = sorted(set().union(*parts.values()))
            count, flat = self.encode_words(short)
            of = dict(zip(short, np.split(flat, np.cumsum(count)[:-1]), strict=True))
            for k, p in parts.items():
                pieces[k] = np.concatenate([of[x] for x in p])
        owners, counts, flats = [], [], []
        for size, at in by_size.items():
            group = max(1, 4_000_000 // (16 * (size + 1)))
            for s in range(0, len(at), group):
                some = at[s : s + group]
                few = size > LONG_WORD and len(some) == 1
                count, nodes = self.viterbi_alone(words[some[0]]) if few else self.viterbi([words[k] for k in some])
                ids = self.ids[nodes]
                ids[nodes < 0] = -1
                odd = np.unique(np.repeat(np.arange(len(some)), count)[ids < 0])
                ends = np.cumsum(count)
                for k in odd.tolist():
                    pieces[some[k]] = self.with_bytes(words[some[k]], nodes[ends[k] - count[k] : ends[k]])
                owners.append(np.array(some))
                counts.append(count)
                flats.append(ids)
        if owners:
            owner, count, flat = map(np.concatenate, (owners, counts, flats))
        else:
            owner, count, flat = (np.zeros(0, np.int64),) * 3
        # From the order of lengths to the order of the words.
        start = np.zeros(len(words), np.int64)
        total = np.zeros(len(words), np.int64)
        start[owner], total[owner] = np.cumsum(count) - count, count
        extra = [(k, x) for k, x in enumerate(pieces) if x is not None]
        if extra:
            sizes = np.array([len(x) for _, x in extra])
            which = np.array([k for k, _ in extra])
            start[which], total[which] = len(flat) + np.cumsum(sizes) - sizes, sizes
            flat = np.concatenate([flat, *[x for _, x in extra]])
        return total, flat[ranges(start, total)].astype(np.int32)

    def cut(self, word: str) -> list[str]:
        """Parts of a long word, cut where no piece holds both neighbours."""
        c = codes([word]).astype(np.int64)
        at = np.nonzero(~np.isin(c[:-1] << 32 | c[1:], self.inner))[0] + 1
        ends = [0, *at.tolist(), len(word)]
        return [word[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def with_bytes(self, word: str, nodes: np.ndarray) -> np.ndarray:
        """Ids of a word some of whose characters have no piece of their own: those become their bytes."""
        out, at = [], 0
        for k in nodes.tolist():
            i = int(self.ids[k]) if k >= 0 else -1
            n = len(self.surface[i].decode()) if i >= 0 else 1
            out += [i] if i >= 0 else self.byte_ids[list(word[at : at + n].encode("utf-8", "surrogatepass"))].tolist()
            at += n
        return np.array(out, np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids, without the space that encoding puts in front."""
        text = b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def load(model: str) -> Pieces:
    import public_tokenizers

    with open(public_tokenizers.path(model), "rb") as f:
        return Pieces(f.read())


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for count[0] places, then the same for the next."""
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)


class Coder:
    """Encodes texts, each distinct word once; known words' ids lie in one array."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.start, self.count, self.flat = (np.zeros(0, t) for t in (np.int64, np.int64, np.int32))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = self.pieces.word.findall
        words = [cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.forget()
        new = list(set().union(*words) - self.memo.keys())
        if new:
            count, flat = self.pieces.encode_words(new)
            self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new)), strict=True))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
            self.count, self.flat = np.concatenate([self.count, count]), np.concatenate([self.flat, flat])
        size = np.fromiter(map(len, words), np.int64, len(words))
        known = np.fromiter(map(self.memo.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(size.sum()))
        ids = self.flat[ranges(self.start[known], self.count[known])]
        ends = np.concatenate([[0], np.cumsum(self.count[known])])[np.concatenate([[0], np.cumsum(size)])]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", with_ids: bool = False) -> DataFrame:
    """(id, n_pieces, ids_crc32, round_trip) for every row, with ``with_ids`` also ids and decoded.

    ids_crc32 is that of the ids as little-endian unsigned 32-bit numbers;
    round_trip says that decoding gives the text back (the vocabulary's space
    sign itself comes back as a space). Null counts as empty and has no
    pieces. Null and repeated ids are kept as they are. An empty table gives
    an empty result; other columns are not read.
    """
    pieces = load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(pieces)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                texts = [t.as_py() or "" for t in part.column(1)]
                ids = coder.encode(texts)
                back = [pieces.decode(x) for x in ids]
                same = [x == t.replace(SPACE, " ") for x, t in zip(back, texts, strict=True)]
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                cols = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(same)]
                if with_ids:
                    cols += [pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["id", "n_pieces", "ids_crc32", "round_trip", *(["ids", "decoded"] if with_ids else [])]
    schema = f"id {dict(docs.dtypes)[id_col]}, n_pieces long, ids_crc32 long, round_trip boolean" + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Per document: number of pieces, digest of the ids, and whether decoding gives the text back."""
    return encode_decode(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
