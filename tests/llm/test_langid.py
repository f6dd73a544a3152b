"""Language ID: forward-backward by brute force, gradient by differences, held-out accuracy, edge cases."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from veilgrid.llm import langid_crf as L

SF = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    size = np.array([3, 0, 1, 5])
    scores, moves, start = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got = L.marginal_sums(scores.astype(np.float32), size, moves, start)
    at = 0
    for k, n in enumerate(size):
        want, total = np.zeros(3), 0.0
        for path in itertools.product(range(3), repeat=int(n)):
            if not n:
                continue
            s = start[path[0]] + sum(scores[at + i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False))
            total += np.exp(s)
            for y in path:
                want[y] += np.exp(s)
        assert np.allclose(got[k], want / total if n else 0, atol=1e-4)
        at += n


def test_fit_learns_words_and_transitions():
    rows = [("the cat and the dog of the house", "en"), ("le chat et le chien de la maison", "fr")] * 20
    model = L.fit(rows, epochs=6)
    assert model.labels == ["en", "fr"]
    assert (np.diag(model.moves) > model.moves[0, 1]).all()
    words = L.words_of("The cat le chien")
    sums = L.marginal_sums(model.emissions(words), np.array([4]), model.moves, model.start)
    assert abs(sums.sum() - 4) < 1e-4 and 1.5 < sums[0, 0] < 2.5


def test_held_out_accuracy_and_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.op2_language_id(spark, SF)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    both = got.join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(both) == docs.count()
    held = both[both.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.98
    assert both.score.between(0, 1).all()


def test_predictions_do_not_see_labels_or_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    spoilt = docs.withColumn("lang", F.when(fold == 0, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    a = {r.row.doc_id: (r.lang_pred, r.score) for r in L.identify(docs).collect()}
    b = {r.row.doc_id: (r.lang_pred, r.score) for r in L.identify(spoilt).collect()}
    assert a == b


def test_edge_cases(spark):
    text = "the house and the garden of the people"
    rows = [(i, text, "en", "s") for i in range(30)] + [(100 + i, "das haus und der garten der leute", "de", "s") for i in range(30)]
    rows += [(200, None, "en", "s"), (201, "", None, None), (202, "123 ½ ² !!", "de", "s"), (None, text, None, None), (3, text, "en", "s"), (203, "the " * 60_000, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = L.identify(docs).collect()
    assert len(out) == len(rows)
    got = {}
    for r in out:
        got.setdefault(r.row.doc_id, []).append((r.lang_pred, round(r.score, 6)))
    assert got[200] == got[201] == got[202] == [("und", 0.0)]
    assert got[None][0][0] == "en" and got[203][0][0] == "en" and got[3][0] == got[3][1] and got[105][0][0] == "de"
    kept = L.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert L.identify(docs.limit(0)).count() == 0 and L.keep_known(docs.limit(0)).count() == 0
    bare = L.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in bare} == {("und", 0.0)}


def test_every_label_has_its_share_and_long_texts_are_learned_from(spark):
    rows = [(i, f"w{i % 100}a w{i % 100}b w{i % 100}c", f"l{i % 100:02}") for i in range(2000)]
    rows += [(3000 + i, "zeta omega sigma " * 2000, "long") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken = L.sample(docs, "doc_id", "text", "lang", 200, 1000)
    n = {}
    for t, y in taken:
        n[y] = n.get(y, 0) + 1
        assert len(t) <= 1000
    assert len(n) == 101 and set(n.values()) == {4}
    assert len(L.sample(docs, "doc_id", "text", "lang", 1600, 1000)) <= 1600
