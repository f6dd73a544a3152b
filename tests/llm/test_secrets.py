"""Secret scans: fixed patterns by the definition, the battery's p-values, false discovery control, redaction."""

import base64
import hashlib
import random
import re
import string

import pytest

from veilgrid.llm import secret_scan as S

SF = "/root/testdata/sf0.01"


def by_definition(text):
    spans = []
    for k, (kind, pattern, group, least) in enumerate(
        [
            ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
            ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
            ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
        ]
    ):
        spans += [(m.start(), k, kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return [(kind, s, e) for s, _, kind, e in sorted(spans)]


def test_fixed_patterns():
    texts = [
        "", "password = abcdef", "PassWd:'abc", "secret=token:abcdef", "token=secret=abcdefgh", "api_key\"  :  \"x.y=z/1+2-3_4",
        "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "AKIA", "é" * 5 + "0123456789abcdef01234567" + "é", "x0123456789abcdef0123456",
        "apikey=aaaaaa token='bbbbbb' " + "f" * 30, "ſecret=abcdefgh toKen=abcdefgh", "token=" + "0" * 40,
    ]
    for t in texts:
        assert sorted(S.base_spans(t)) == sorted(by_definition(t)), t
        assert S.join_spans(S.base_spans(t)) == ",".join(f"{k}:{s}:{e}" for k, s, e in by_definition(t)), t


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    got = S.op8_secret_scan(spark, SF).toPandas().set_index("doc_id").loc[docs.index]
    for text, r in zip(docs.text, got.itertuples(), strict=True):
        base = by_definition(text or "")
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r.spans.split(",")) | {""}
        assert bool(r.spans) >= bool(base)


def test_battery_tells_random_from_patterned():
    rng = random.Random(2)
    p = []
    for _ in range(400):
        token = base64.b64encode(rng.randbytes(30)).decode()
        name, index = S.infer(token)
        assert name in ("base62", "base64")
        p.append(S.randomness(token, index))
    assert 0.35 < sum(p) / len(p) < 0.65 and sum(x < 0.05 for x in p) < 48
    for token in ("ab1" * 12, "A1" * 20, "abcdefghij0123456789" * 2, "aaaaaaaaaaaaaaaaaaaa1", "VersionNumber12VersionNumber12"):
        assert S.randomness(token, S.infer(token)[1]) < 0.01, token


def test_plain_words_and_numbers_are_no_candidates():
    text = "Donaudampfschifffahrtsgesellschaft SCHIFFFAHRTSGESELLSCHAFT 12345678901234567890123 one-two_three/four-five-six-seven ------------------------ some/long/path/with/many/parts"
    assert S.candidates(text) == []
    # Long runs take linear time, whatever they end in.
    for odd in ("-" * 100_000 + "a1", "a-" * 50_000 + "a1B", "Ab" * 50_000 + "!", "1" * 100_000 + "x"):
        assert len(S.candidates(odd)) <= 1


def test_found_without_a_keyword_and_clean_left_alone(spark):
    rng = random.Random(9)
    rows = [(i, f"note {base64.b64encode(rng.randbytes(36)).decode().rstrip('=')} end", "k") for i in range(60)]
    rows += [(1000 + i, f"see Chapter{i}SectionChapter{i}Section and Aa0Aa0Aa0Aa0Aa0Aa0Aa0", "k") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = {r.id: r.spans for r in S.scan(docs).collect()}
    hit = sum(bool(got[i]) for i in range(60))
    assert hit >= 55
    assert sum(bool(got[1000 + i]) for i in range(300)) <= 6


def test_edge_cases_and_redaction(spark):
    key = "AKIA" + "Q7" * 9
    rows = [(1, None), (2, ""), (None, f"x {key} y"), (3, f"password={key}!"), (3, f"password={key}!"), (4, "clean " * 2000)]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "z") for r in rows], "doc_id long, text string, n_chars long, spans string")
    got = sorted((str(r.id), S.join_spans([tuple(x) for x in r.base_spans])) for r in S.scan(docs).collect())
    assert got == sorted([("1", ""), ("2", ""), ("None", "access:2:24"), ("3", "assign:0:31,access:9:31"), ("3", "assign:0:31,access:9:31"), ("4", "")])
    out = S.redact(docs)
    assert out.columns == docs.columns
    texts = sorted((str(r.doc_id), r.text, r.n_chars) for r in out.collect())
    assert texts == sorted(
        [("1", None, 0), ("2", "", 0), ("None", "x [SECRET] y", 12), ("3", "[SECRET]!", 9), ("3", "[SECRET]!", 9), ("4", "clean " * 2000, 12000)], key=lambda x: (x[0], str(x[1]))
    )
    assert S.scan(docs.limit(0)).count() == 0 and S.redact(docs.limit(0)).count() == 0


def test_runs_of_no_single_alphabet_are_split():
    secret, b64, url = "9Gx2kLmQ7vTz8RbW3nYp5cHd", "q8+Zx1/Rk7Lw0Tn5+Vb3Yc9/Hd2Jf6Mp", "q8-Zx1_Rk7Lw0Tn5-Vb3Yc9_Hd2Jf6Mp"
    for text, part in [
        (f"sig={secret}", secret), (f"auth={b64}", b64), (f"PRIVATE_KEY={secret}", secret), (f"AccountKey={b64}==;x", b64), (f"https://h.example/cb?code={url}&s=1", url),
        (f"é a=b={secret} end", secret), (f"src/a/b/{url}", url), (f"some-name-{b64}", b64), (f"k={b64}==/one", b64), (f"dir/{secret}-x_y", None), (f"x={b64}-{b64}", b64),
    ]:
        found = S.candidates(text)
        assert found, text
        for start, end, stratum, p, digest in found:
            assert S.infer(text[start:end]) and stratum.split(":")[0] == S.infer(text[start:end])[0] and end - start >= 20
        if part:
            assert part in [text[s:e] for s, e, *_ in found], text
    assert S.candidates("one=two_three/four-five=six/seven_eight some_long_name=another/long-value/for_that x=1234567890123456789012345") == []
    assert len(S.candidates("a=" * 100_000 + "b1")) == 0 and len(S.candidates("/-" * 100_000 + "b1")) <= 1


def test_values_behind_unknown_keys_are_found_and_redacted(spark):
    rng = random.Random(4)
    keys = [base64.b64encode(rng.randbytes(36)).decode() for _ in range(80)]
    rows = [(i, f"see AccountKey={k};Endpoint and sig={k[::-1]} end") for i, k in enumerate(keys)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: [(x.start, x.end) for x in r.spans] for r in S.scan(docs).collect()}
    assert sum((15, 15 + 48) in got[i] for i in range(80)) >= 72
    out = {r.doc_id: r.text for r in S.redact(docs).collect()}
    assert sum(k in out[i] or k[::-1] in out[i] for i, k in enumerate(keys)) <= 12


NOUNS = (
    "user account manager get set list update delete create order item price total count index value key name type state event table column row file path read write "
    "open close start stop time date hour minute second day week month year the and that have for not with you this but his from they say her she will one all would "
    "there their what out about who which when make can like just him know take people into good some could them see other than then now look only come its over"
).split()


def identifiers(rng, n):
    """Names as programs have them: joined words with a few digits, which no test of the string alone tells from a key."""
    out = set()
    while len(out) < n:
        ws = [rng.choice(NOUNS) for _ in range(rng.randrange(3, 7))]
        hexes = "".join(rng.choice("0123456789abcdef") for _ in range(4))
        t = rng.choice(["".join(w.capitalize() for w in ws) + f"{rng.randrange(100)}{rng.choice('abxyz')}", "/".join([*ws, hexes]), "_".join(ws) + f"_v{rng.randrange(1000)}"])
        if len(t) >= 20:
            out.add(t)
    return sorted(out)


@pytest.mark.parametrize("n_keys,length", [(200, 32), (200, 24), (200, 20)])
def test_precision_and_recall_beside_identifiers(spark, n_keys, length):
    rng = random.Random(n_keys + length)
    names = identifiers(rng, 5000)
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(length)) for _ in range(n_keys)]
    prose = lambda: " ".join(rng.choice(NOUNS) for _ in range(12))
    rows = [(i, f"{prose()} {t} {prose()}") for i, t in enumerate([*keys, *names])]
    out = S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hit = [r.id for r in out if r.spans]
    right = sum(i < n_keys for i in hit)
    assert right >= 0.9 * n_keys and right >= 0.9 * len(hit), (right, len(hit))


def test_few_keys_beside_identifiers():
    """20 keys among 5,000 names: chance moves a single corpus, so means over ten of them."""
    precision, recall = [], []
    for seed in range(10):
        rng = random.Random(seed)
        words = S.WordPairs(S.pair_counts([" ".join(rng.choice(NOUNS) for _ in range(60_000))]))
        keys = {"".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32)) for _ in range(20)}
        found = [(t in keys, c) for t in [*keys, *identifiers(rng, 5000)] for c in S.candidates(t, words)]
        bins = {}
        for _, c in found:
            at = bins.setdefault(c[2], {})
            at[int(c[3] * S.BINS)] = at.get(int(c[3] * S.BINS), 0) + 1
        least = S.thresholds(bins, 0.05)
        hit = [key for key, c in found if c[3] >= least[c[2]]]
        precision.append(sum(hit) / max(1, len(hit)))
        recall.append(sum(hit) / 20)
    assert sum(precision) / 10 >= 0.9 and sum(recall) / 10 >= 0.8, (precision, recall)


def test_identifiers_alone_are_left(spark):
    rng = random.Random(8)
    rows = [(i, f"see {t} and {' '.join(rng.choice(NOUNS) for _ in range(9))}") for i, t in enumerate(identifiers(rng, 3000))]
    out = S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(bool(r.spans) for r in out) <= 30
