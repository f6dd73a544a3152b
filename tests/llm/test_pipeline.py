"""The pipeline stage by stage on the whole table, and each stage on odd rows."""

import random
import re

import corpus_pipeline as C
from veilgrid.llm import langid_crf, packing, secret_scan, simhash_vp
from veilgrid.llm.common import staged

from .test_packing import check
from .test_secrets import by_definition
from .test_simhash import brute, plain_fingerprint

SF = "/root/testdata/sf0.01"


def test_stages_and_their_order():
    assert [n for n, _ in C.STAGES] == ["language_id", "simhash_near_dedup", "secret_scan", "best_fit_packing"]


def test_run_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    frames = []
    for name, stage in C.STAGES:
        docs = staged(stage(spark, docs, SF), f"test-{name}")
        frames.append({r.doc_id: r for r in docs.collect()} if name != "best_fit_packing" else [tuple(r) for r in docs.collect()])
        assert docs.columns == columns or name == "best_fit_packing"
    known, single, clean, packed = frames
    # Language: only texts without a letter may go from this table; the rest is untouched.
    assert {k for k, r in before.items() if not re.search(r"[^\W\d_]", r.text or "")} == before.keys() - known.keys()
    assert all(known[k] == before[k] for k in known)
    # Near duplicates: one of each component, the smallest id.
    ids = sorted(known)
    comp = brute(ids, [plain_fingerprint(known[i].text) for i in ids], 4)
    assert sorted(single) == sorted(set(comp)) and all(single[k] == known[k] for k in single)
    # Secrets: every fixed pattern is gone from the text, texts without a span are untouched.
    assert clean.keys() == single.keys()
    for k, r in clean.items():
        spans = by_definition(single[k].text)
        assert (secret_scan.KINDS and not spans and r == single[k]) or "[SECRET]" in r.text
        assert r.n_chars == len(r.text)
        assert not any(single[k].text[s:e] in r.text for kind, s, e in spans if kind == "hex")
    # Packing: every document that is left, whole.
    enc = packing.Encoder("byte_bpe_50k")
    check(packed, {k: enc.ids(r.text) + [2] for k, r in clean.items()}, (1024, 1024, 1 << 20))
    total = sorted(map(tuple, C.run(spark, SF).collect()))
    assert len(total) == len(packed) and {(r[0], r[1], r[4]) for r in total} == {(r[0], r[1], r[4]) for r in packed}


def test_odd_rows_pass_through_every_stage(spark):
    rng = random.Random(1)
    vocab = [f"w{''.join(rng.choices('abcdefgh', k=4))}" for _ in range(200)]
    rows = [(i, " ".join(rng.choices(vocab, k=40)), "en" if i % 2 else None, None, 5) for i in range(60)]
    rows += [(100, None, "en", "s", None), (101, "", None, None, 0), (None, " ".join(vocab[:30]), None, None, 1), (7, rows[7][1], None, "s", 5), (102, "123 456", "en", "s", 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in C.STAGES:
        docs = staged(stage(spark, docs, SF), f"odd-{name}")
        if name == "language_id":
            assert docs.count() == len(rows) - 3
        if name == "simhash_near_dedup":
            assert docs.count() == len(rows) - 4
    assert docs.select("doc_id").distinct().count() == 61
    empty = spark.createDataFrame([], schema)
    for _, stage in C.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
    assert langid_crf.UNKNOWN == "und" and simhash_vp.PAIR_BLOCK > 0
