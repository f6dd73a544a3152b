"""Secret scans: three fixed patterns and a randomness test battery.

Besides the fixed patterns, every run of 20 or more code characters that is no
plain word or number is a candidate. Its encoding is inferred from the
character classes it uses; a run that fits none, such as key=value, is split at
"=" and then at the signs foreign to the encoding that fits best, and its parts
of 20 or more characters are candidates. Four tests ask whether it could be a
uniform random string of that encoding: chi-squared of the alphabet's counts,
the number of runs above and below the alphabet's middle, the serial
correlation of neighbours, and how much its letter pairs are those of the
corpus's own words (an identifier is made of words; a key is not). Fisher's
method combines them to one p-value, low for anything that is not random.
The pairs are counted over the words of all texts, in a pass of its own.

False discoveries are controlled within each stratum (encoding and length
band) over the whole corpus: random strings have uniform p-values, others
pile up near zero, so the larger p-values tell how many random strings there
are (Storey's estimate), and the threshold is the lowest at which the
share of others among the accepted stays within ``fdr``. Short strings, on
which the tests have little power, are thereby judged by their own stratum. A
string counts once however often it is copied, and a stratum of few strings
leans on the share in all strata as far as the strata agree.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.common import read, staged

# Fixed patterns: kind, pattern, least length of the whole match, least length of group 2.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 0, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 20, 0),
    ("hex", re.compile(r"[0-9a-f]+"), 24, 0),
)
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "api")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
JOINT = re.compile(r"[+/_=-]+")
# Encodings, from the narrowest alphabet on.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
SETS = tuple((name, frozenset(chars), {c: i for i, c in enumerate(chars)}) for name, chars in ALPHABETS)
# The signs that base64 and base64url, which hold all other characters of a candidate but "=", lack.
FOREIGN = ("-_", "+/")
BANDS = (20, 24, 32, 48, 64, 128)
BINS = 200
# A word of the corpus: it stands alone and has no capital inside.
WORD = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z][a-z]{1,18}(?![A-Za-z0-9+/_=-])")
LETTERS = 26
SURE = 0.2  # p-values above are hardly ever of words
KINDS = ("assign", "access", "hex", "random")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, in code points, per kind from left to right."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", *m.span()) for m in BASE[0][1].finditer(text) if len(m[2]) >= BASE[0][3]]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in BASE[1][1].finditer(text) if len(m[0]) >= BASE[1][2]]
    # A greedy run of 24 or more is a whole match of the pattern that is long enough.
    out += [("hex", *m.span()) for m in LONG_HEX.finditer(text)]
    return out


def plain(token: str) -> bool:
    """Words, capitalised words and numbers, alone or joined by signs."""
    return all(PART.fullmatch(x) for x in JOINT.split(token) if x)


def infer(token: str) -> tuple[str, dict[str, int]] | None:
    """The narrowest encoding that has all characters of the token (padding aside)."""
    used = set(token)
    return next(((name, index) for name, chars, index in SETS if used <= chars), None)


def letter_codes(text: bytes) -> np.ndarray:
    """0 to 25 for letters of either case, 26 for all else."""
    x = (np.frombuffer(text, np.uint8) | 0x20) - ord("a")
    return np.minimum(x, LETTERS).astype(np.int64)


def pair_counts(texts: list[str]) -> np.ndarray:
    """How often each letter follows each other in the words of the texts, 26 x 26."""
    joined = " ".join(" ".join(WORD.findall(t)) for t in texts).encode()
    x = letter_codes(joined)
    full = np.bincount(x[:-1] * (LETTERS + 1) + x[1:], minlength=(LETTERS + 1) ** 2) if len(x) else np.zeros((LETTERS + 1) ** 2, np.int64)
    return full.reshape(LETTERS + 1, LETTERS + 1)[:LETTERS, :LETTERS]


class WordPairs:
    """The log odds of a letter pair in the corpus's words against any pair, and what sums of them random strings have.

    ``prior`` pairs of each kind are added, so a corpus of few words says little.
    """

    def __init__(self, counts: np.ndarray, prior: float = 2.0):
        seen = counts + prior
        self.odds = np.zeros((LETTERS + 1, LETTERS + 1))
        self.odds[:LETTERS, :LETTERS] = np.log(LETTERS * seen / seen.sum(1, keepdims=True))
        self.random = {}
        for name, chars in ALPHABETS:
            x = letter_codes(chars.encode())
            f = self.odds[x][:, x]
            mean = f.mean()
            self.random[name] = mean, f.var(), float((f.mean(0) * f.mean(1)).mean() - mean**2)

    def p(self, token: str, name: str) -> float:
        """The chance that a random string of the encoding is as like to words as the token."""
        x = letter_codes(token.encode())
        n, (mean, var, cov) = len(x) - 1, self.random[name]
        spread = n * var + 2 * (n - 1) * cov
        return 0.5 if spread < 1e-9 else p_upper((float(self.odds[x[:-1], x[1:]].sum()) - n * mean) / math.sqrt(spread))


def p_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(token: str, index: dict[str, int], *more: float) -> float:
    """Fisher's p-value of the three tests of the token itself, and of the p-values ``more``, that it is uniform over its alphabet."""
    n, size = len(token), len(index)
    x = np.fromiter((index[c] for c in token), np.float64, n)
    counts = np.fromiter(Counter(token).values(), np.float64)
    chi = float((counts * counts).sum() * size / n - n)
    p1 = p_upper((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))
    high = x >= size / 2
    a = int(high.sum())
    b = n - a
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / max(1, n - 1)
    p2 = 2 * p_upper(abs(runs - mean) / math.sqrt(var)) if var > 0 else 2.0 ** (1 - n)
    d = x - x.mean()
    ss = float((d * d).sum())
    p3 = 2 * p_upper(abs(float((d[1:] * d[:-1]).sum()) / ss * math.sqrt(n) + 1 / math.sqrt(n))) if ss > 0 else 0.0
    tests = (p1, p2, p3, *more)
    half = -sum(math.log(max(p, 1e-300)) for p in tests)
    return math.exp(-half) * sum(half**k / math.factorial(k) for k in range(len(tests)))


def split_at(signs: str, token: str, start: int) -> list[tuple[int, str]]:
    """(start, part) of the parts of ``token`` between the signs."""
    return [(start + m.start(), m[0]) for m in re.finditer(f"[^{re.escape(signs)}]+", token)]


def parts(token: str, start: int) -> list[tuple[int, str]]:
    """(start, part) of a token that fits no encoding: what lies between "=", or else between foreign signs.

    Of two encodings with as few foreign signs, the one that leaves the longest part fits best.
    """
    out = []
    for at, part in split_at("=", token, start):
        if len(part) < BANDS[0] or infer(part):
            out.append((at, part))
            continue
        ways = [(sum(map(part.count, signs)), split_at(signs, part, at)) for signs in FOREIGN]
        out += min(ways, key=lambda w: (w[0], -max((len(x) for _, x in w[1]), default=0)))[1]
    return [(at, part) for at, part in out if len(part) >= BANDS[0]]


def candidates(text: str, words: WordPairs | None = None) -> list[tuple[int, int, str, float, str]]:
    """(start, end, stratum, p, digest) of every run of code characters, or part of one, that is no plain word or number."""
    out, words = [], words or WordPairs(np.zeros((LETTERS, LETTERS)))
    for m in CANDIDATE.finditer(text):
        token = m[0].rstrip("=")
        if len(token) < BANDS[0] or plain(token):
            continue
        whole = infer(token)
        for at, part in [(m.start(), token)] if whole else parts(token, m.start()):
            if not whole and plain(part):
                continue
            name, index = whole or infer(part)
            band = max(b for b in BANDS if b <= len(part))
            out.append((at, at + len(part), f"{name}:{band}", randomness(part, index, words.p(part, name)), xxhash.xxh64_hexdigest(part)))
    return out


def random_strings(n: np.ndarray, least: float = SURE) -> float:
    """How many of the strings are random, from their p-values' histogram.

    Above the least of a few cuts beyond which the lower half holds no more
    than the upper half, chance aside, p-values are taken to be of random
    strings alone; those below the cut are as many for their share. The
    more p-values that serve, the surer the estimate where keys are few.
    """
    for cut in (least, 0.3, 0.4):
        i = int(cut * BINS)
        mid = (i + BINS) // 2
        low, all_ = n[i:mid].sum(), n[i:].sum()
        if 2 * low - all_ <= 1.64 * math.sqrt(all_):
            return float(all_ / (1 - cut))
    return float(2 * n[BINS // 2 :].sum())


def thresholds(histogram: dict[str, dict[int, int]], fdr: float, floor: float = 0.01) -> dict[str, float]:
    """Per stratum, the least p-value accepted as random; above 1 if none is.

    A stratum's share of random strings (``random_strings``) is shrunk towards the share in all strata by as many strings' worth as
    the strata agree beyond chance (1 to 100).
    """
    counts = {k: np.array([bins.get(i, 0) for i in range(BINS + 1)], dtype=float) for k, bins in histogram.items()}
    if not counts:
        return {}
    size = np.array([n.sum() for n in counts.values()])
    own = np.array([random_strings(n) for n in counts.values()])
    mean = min(1.0, own.sum() / size.sum())
    chance = mean * (2 - mean) / size
    spread = float((size * ((own / size - mean) ** 2 - chance)).sum() / size.sum())
    lean = min(100.0, max(1.0, (mean * (1 - mean) + 0.01) / max(spread, 1e-4)))
    share = np.minimum(1.0, (own + lean * mean) / (size + lean))
    out = {}
    for (stratum, n), random in zip(counts.items(), size * share, strict=True):
        out[stratum] = 2.0
        for i in range(max(1, int(floor * BINS)), BINS // 2 + 1):
            got = n[i:].sum()
            want = random * (1 - i / BINS)
            # What exceeds the random strings expected there, chance aside, is taken for others.
            if got and got - want - math.sqrt(random * max(0.0, SURE - i / BINS)) <= fdr * got:
                out[stratum] = i / BINS
                break
    return out


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


SPAN = "array<struct<kind:string,start:int,end:int>>"
FOUND = "array<struct<start:int,end:int,stratum:string,p:double,digest:string>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.05) -> DataFrame:
    """(id, spans, base_spans) for every row: arrays of (kind, start, end) in code points.

    Null and empty texts have no span. Rows with null or repeated ids are kept
    as they are. An empty table gives an empty result. Other columns are not
    read. One pass counts the letter pairs of words, one finds the candidates;
    thresholds come from all candidates.
    """
    return judged(found_in(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", ["id"]), fdr)


def word_pairs(docs: DataFrame, text_col: str) -> WordPairs:
    """The letter pairs of all words of all texts; a task hands on one table of 676 numbers, and they are summed by a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((LETTERS, LETTERS), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                total += pair_counts([t for t in b.column(0).slice(at, 256).to_pylist() if t])
        hit = np.nonzero(total.ravel())[0]
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total.ravel()[hit])], ["pair", "n"])

    counts = np.zeros(LETTERS * LETTERS)
    for r in docs.select(F.col(text_col).alias("t")).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r.pair] = r.n
    return WordPairs(counts.reshape(LETTERS, LETTERS))


def found_in(rows: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """The columns ``carry`` in a struct ``row``, ``base`` and ``found``, written in the shared folder: the fixed patterns' spans and the candidates."""
    words = word_pairs(rows, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        found = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.string()), ("p", pa.float64()), ("digest", pa.string())]))
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part, a, c = b.column(0).slice(at, 1024), [], []
                for t in part.field(cols.index(text_col)):
                    text = t.as_py() or ""
                    a.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in base_spans(text)])
                    c.append([dict(zip(("start", "end", "stratum", "p", "digest"), x, strict=True)) for x in candidates(text, words)])
                row = pa.StructArray.from_arrays([part.field(cols.index(x)) for x in carry], carry)
                yield pa.RecordBatch.from_arrays([row, pa.array(a, span), pa.array(c, found)], ["row", "base", "found"])

    cols = list(dict.fromkeys([*carry, text_col]))
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"))
    kind = rows.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")).dtypes[0][1]
    return staged(packed.mapInArrow(run, f"row {kind}, base {SPAN}, found {FOUND}"), "secrets")


def learned(found: DataFrame, fdr: float) -> dict[str, float]:
    """Thresholds from the p-values of all candidates; strata and bins are few, whatever the corpus."""
    c = found.select(F.explode("found").alias("c")).select("c.stratum", "c.p", "c.digest")
    once = c.groupBy("stratum", "digest").agg(F.min("p").alias("p"))
    bins = once.groupBy("stratum", F.floor(F.col("p") * BINS).cast("int").alias("bin")).count().collect()
    histogram: dict[str, dict[int, int]] = {}
    for r in bins:
        histogram.setdefault(r["stratum"], {})[r["bin"]] = r["count"]
    return thresholds(histogram, fdr)


def judged(found: DataFrame, fdr: float) -> DataFrame:
    """The carried columns, with ``spans`` (the fixed patterns' and the accepted candidates that overlap none of them) and ``base_spans``."""
    least = learned(found, fdr)
    accept = F.filter(
        "found",
        lambda c: (c["p"] >= F.coalesce(F.element_at(_literal_map(least), c["stratum"]), F.lit(2.0)))
        & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    extra = F.transform(accept, lambda c: F.struct(F.lit("random").alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return found.select("row.*", F.concat("base", extra).alias("spans"), F.col("base").alias("base_spans"))


def _literal_map(least: dict[str, float]):
    return F.create_map(*[F.lit(x) for kv in sorted((least or {"": 2.0}).items()) for x in kv])


def spans_text(spans: str):
    """The column's spans as text, by start, then kind as listed."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.transform(spans, lambda s: F.struct(s["start"], rank[s["kind"]], s["end"], s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Per document: counts per kind, digest of the fixed patterns' spans, and all spans."""
    rows = scan(read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select(
        F.col("id").alias("doc_id"),
        *[count(k) for k in KINDS[:3]],
        F.sha2(spans_text("base_spans"), 256).alias("base_sha256"),
        spans_text("spans").alias("spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", fdr: float = 0.05) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` in the text; all rows and columns stay.

    A null text stays null. An ``n_chars`` column follows the text.
    """
    # Found once: the rows are written beside what was found in them, and cut from there.
    renamed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index(text_col)}"
    rows = judged(found_in(renamed, text, renamed.columns), fdr)

    def clean(text: str | None, spans: list[dict]) -> str | None:
        if text is None or not spans:
            return text
        at, out = 0, []
        for s, e in sorted((x["start"], x["end"]) for x in spans):
            if e > at:
                out += [text[at:s], mark] if s >= at else []
                at = e
        return "".join([*out, text[at:]])

    names, schema = renamed.columns, renamed.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([clean(t.as_py(), x.as_py()) for t, x in zip(b.column(text), b.column("spans"), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if c == text else b.column(c) for c in names], names)

    out = rows.select(*names, "spans").mapInArrow(run, schema).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(text_col).isNull(), F.col("n_chars")).otherwise(F.length(text_col).cast(dict(docs.dtypes)["n_chars"])))
    return out
