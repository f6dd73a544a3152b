"""Spelling variants by asymmetric q-chunks.

Two words that differ by one edit agree on one of two halves. So one word of a
pair contributes two disjoint chunks, its halves, with their places; the other
contributes the grams of those lengths at every place where such a chunk can
lie: the same place if the lengths agree, and the same place or one further if
it is the longer word. Chunks meet grams by equality of a key, and the pair is
verified.

A chunk that many words share ("tion" at the end) would meet too many grams.
There the open half, which holds the edit, is cut in two again: the chunk and
one of the two quarters agree. This goes on, for such keys alone, until few
words share a key or one character is open, so no key pairs more than
``max_pairs`` words unless they are near each other in all but one character.
No pair is lost on the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.common import read, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]{%d,}"


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_rows: int = 3, noise: int = 97) -> DataFrame:
    """(word, n): the words of all texts that occur ``least_rows`` times or more.

    A run is maximal in [A-Za-zÀ-ÿ], A-Z lower-cased. Where ``noise`` divides
    the crc32 h of "<id>:<run>", the run loses its code point h % length. A null
    text has no run, a null id counts as empty. Only runs of ``least_chars`` or
    more are looked at, as no run grows.
    """
    lower = F.translate(F.col(text_col), UPPER, LOWER)
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lower, F.lit(RUN % least_chars), F.lit(0))).alias("run"),
    )
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    cut = F.expr("concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    words = runs.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.length("word") >= least_chars) & (F.col("n") >= least_rows))


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the key of all that lies outside the open stretch [lo, hi) of the chunk side's word.

    ``longer`` marks a word that is one longer than its partner, whose open stretch then is one longer too.
    """
    return rows.withColumn(
        "key",
        F.expr("xxhash64(shift, size, lo, hi, substring(word, 1, lo), substring(word, hi + 1 + cast(longer as int)))"),
    )


def first_halves(words: DataFrame) -> DataFrame:
    """Two rows a word and part it can play: chunks, equally long grams, grams of one further."""
    size = F.length("word")
    parts = F.array(
        F.struct(F.lit(0).alias("shift"), F.lit(False).alias("longer"), size.alias("size")),
        F.struct(F.lit(1).alias("shift"), F.lit(False).alias("longer"), size.alias("size")),
        F.struct(F.lit(1).alias("shift"), F.lit(True).alias("longer"), (size - 1).alias("size")),
    )
    rows = words.select("word", F.inline(parts))
    return halves(rows.withColumn("lo", F.lit(0)).withColumn("hi", F.col("size")))


def halves(rows: DataFrame) -> DataFrame:
    """Each row twice, with the left and the right half of its open stretch."""
    cuts = F.expr("array(struct(lo, lo + (hi - lo) div 2 as hi), struct(lo + (hi - lo) div 2 as lo, hi))")
    rows = rows.withColumn("cuts", F.transform(cuts, lambda c: F.struct(c["lo"].cast("int").alias("lo"), c["hi"].cast("int").alias("hi"))))
    return keyed(rows.select("word", "shift", "longer", "size", F.inline("cuts")))


def near_pairs(words: DataFrame, max_pairs: int = 4096) -> DataFrame:
    """(a, b): every unordered pair of distinct ``word`` values that differ by one inserted, deleted or replaced code point."""
    rows = first_halves(words)
    found = None
    while True:
        rows = staged(rows, "chunks")
        sizes = rows.where("hi - lo > 1").groupBy("key").agg(
            F.count(F.when(~F.col("longer"), 1)).alias("n0"), F.count(F.when((F.col("shift") == 0) | F.col("longer"), 1)).alias("n1")
        )
        hot = staged(sizes.where(F.col("n0") * F.col("n1") > max_pairs).select("key"), "chunks-crowded")
        crowded = not hot.isEmpty()
        cold = rows.join(hot, "key", "left_anti") if crowded else rows
        chunks = cold.where("not longer").select("key", F.col("word").alias("a"), "shift")
        grams = cold.where("shift = 0 or longer").select("key", F.col("word").alias("b"))
        met = chunks.join(grams, "key").where("(shift = 1 or a < b) and levenshtein(a, b, 1) = 1").select("a", "b")
        met = staged(met, "chunk-pairs")
        found = met if found is None else found.union(met)
        if not crowded:
            return found.distinct()
        rows = halves(rows.join(hot, "key", "left_semi").drop("key"))


def variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n).

    form: the near word of largest n (ties: smallest in code-point order), if
    its n is ``factor`` or more times the word's; root: the last word that forms
    lead to, the word itself without one. n rises along forms, so they end. An
    empty table gives an empty result; columns other than the two are not read.
    ``words`` must hold a word once, as ``corpus_words`` does, and no null.
    """
    words = staged(words.select("word", "n"), "spelling-words")
    pairs = near_pairs(words.select("word"))
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("word").alias("b"), F.col("n").alias("m"))
    best = both.join(other, "b").groupBy("a").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("b"))).alias("top")
    )
    out = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    takes = F.coalesce(-F.col("top.m") >= factor * F.col("n"), F.lit(False))
    out = staged(
        out.select(
            "word",
            F.when(takes, F.col("top.b")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(takes, -F.col("top.m")).alias("form_n"),
        ),
        "spelling-forms",
    )
    return out.join(roots(out.where("form is not null").select("word", "form")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by pointer doubling: a round halves the steps that are left."""
    now = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        ahead = staged(ahead, "spelling-roots")
        now = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            return now


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Every word of ``documents`` with its form, root and counts."""
    return variants(corpus_words(read(spark, sf_dir, "documents")))


# crc32 is spelled out by its table, as DuckDB has no such function; near words share a word less one code point.
ORACLE_OP11 = """
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i AS c FROM (SELECT unnest(range(0, 256))::BIGINT AS i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{5,}')) AS run
  FROM documents
), distinct_runs AS (SELECT id, run, count(*) AS k, hex(encode(id || ':' || run)) AS x FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, k, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda p: CAST(('0x' || x[2 * p + 1 : 2 * p + 2]) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS h
  FROM distinct_runs, tab
), words AS (
  SELECT w AS word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS w, k FROM hashed
  ) GROUP BY w HAVING length(w) >= 5 AND sum(k) >= 3
), less AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), ranked AS (
  SELECT word, other, m, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM near
), forms AS (
  SELECT w.word, CASE WHEN m >= 2 * w.n THEN other END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN ranked k ON w.word = k.word AND r = 1
), walk AS (
  SELECT word, word AS at FROM forms
  UNION ALL
  SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NOT NULL
)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk ON walk.word = f.word JOIN forms e ON e.word = walk.at AND e.form IS NULL
"""
