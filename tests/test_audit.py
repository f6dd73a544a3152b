"""Row-change audit C1–C10, S9, S10 on the FIXTURES F10 tables, plus properties."""

import json

import pytest
from pyspark.sql import functions as F

from veilgrid.functions.scalars import flip, padded_increment
from veilgrid.operators.audit import (
    add_meta_columns,
    append_audit,
    audit_rows,
    audit_update,
    enforce_lengths,
    latest,
    length_violations,
    resolve_step,
    update,
    with_sequence_id,
)

T0, T1 = "2024-01-01 00:00:00", "2024-01-02 09:30:00"


@pytest.fixture()
def housing(spark):
    df = spark.createDataFrame(
        [("000000001", "Y", "", "000100"), ("000000002", "N", "000200", None)],
        "cmid string, broadbnd string, rnt string, tax string",
    )
    return add_meta_columns(df, T0, "loader")


def _housing_update():
    return {
        "broadbnd": flip("broadbnd", "Y", "N"),
        "rnt": padded_increment("rnt", 4),
        "tax": padded_increment("tax", 6),
    }


def test_meta_columns_added_once(spark, housing):
    again = add_meta_columns(housing, T1, "other")
    assert again.columns == housing.columns
    assert again.first().created_by == "loader"


def test_three_rows_without_meta(spark, housing):
    a = audit_update(
        housing, F.col("cmid") == "000000001", _housing_update(), table="hu_inet_housing", now=T1, user="loader",
        setting="2-ARC", exclude_cols=("created_dt", "created_by", "modified_dt", "modified_by"),
    )
    rows = {r.var_name: (r.original_value, r.modified_value) for r in a.collect()}
    assert rows == {"broadbnd": ("Y", "N"), "rnt": ("", "000004"), "tax": ("000100", "000106")}
    r = a.first()
    assert r.cmid == "000000001" and r.pnum is None and r.process_step == "2-ARC"
    assert r.changed_keys == ["broadbnd", "rnt", "tax"]


def test_meta_columns_audited_same_and_other_user(spark, housing):
    same = audit_update(housing, F.col("cmid") == "000000001", _housing_update(), table="h", now=T1, user="loader")
    assert sorted(r.var_name for r in same.collect()) == ["broadbnd", "modified_dt", "rnt", "tax"]
    other = audit_update(housing, F.col("cmid") == "000000001", _housing_update(), table="h", now=T1, user="editor")
    got = sorted(r.var_name for r in other.collect())
    assert got == ["broadbnd", "modified_by", "modified_dt", "rnt", "tax"]
    assert other.first().changed_keys == got


def test_population_two_rows_and_pnum(spark):
    pop = add_meta_columns(
        spark.createDataFrame([("000000001", "001", "M", "Y"), ("000000001", "002", "F", "N")], "cmid string, pnum string, sex string, wrk string"),
        T0,
        "loader",
    )
    a = audit_update(
        pop,
        (F.col("cmid") == "000000001") & (F.col("pnum") == "001"),
        {"sex": flip("sex", "M", "F"), "wrk": flip("wrk", "Y", "N")},
        table="hu_inet_population", now=T1, user="loader", exclude_cols=("modified_dt",),
    )
    rows = sorted((r.pnum, r.var_name, r.original_value, r.modified_value) for r in a.collect())
    assert rows == [("001", "sex", "M", "F"), ("001", "wrk", "Y", "N")]


def test_identical_rows_are_skipped_and_null_safe(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "x", None)], "k int, v string, w string")
    new = update(df, F.col("k") == 2, {"w": F.lit(None).cast("string")})
    assert audit_rows(df, new, ["k"], table="t", now=T1, user="u").count() == 0
    new2 = update(df, F.col("k") == 1, {"v": F.lit("now")})
    rows = audit_rows(df, new2, ["k"], table="t", now=T1, user="u").collect()
    assert [(r.k, r.var_name, r.original_value, r.modified_value) for r in rows] == [(1, "v", None, "now")]


def test_snapshots_keep_nulls(spark):
    df = spark.createDataFrame([(1, None, "a")], "k int, v string, w string")
    new = update(df, F.lit(True), {"w": F.lit("b")})
    r = audit_rows(df, new, ["k"], table="t", now=T1, user="u").first()
    assert json.loads(r.old_row) == {"k": 1, "v": None, "w": "a"}
    assert json.loads(r.new_row) == {"k": 1, "v": None, "w": "b"}


def test_inserts_and_deletes_not_audited(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    rows = audit_rows(old, new, ["k"], table="t", now=T1, user="u").collect()
    assert [(r.k, r.original_value, r.modified_value) for r in rows] == [(2, "b", "c")]


def test_duplicate_keys_fail_fast(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "z"), (2, "d")], "k int, v string")
    with pytest.raises(Exception, match="duplicate key"):
        audit_rows(old, new, ["k"], table="t", now=T1, user="u").collect()


def test_replaying_audit_on_old_gives_new(spark):
    old = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    cond = F.col("o_orderstatus") == "O"
    sets = {"o_orderpriority": F.lit("2-HIGH"), "o_custkey": F.col("o_custkey") + 1}
    new = update(old, cond, sets)
    a = audit_rows(old, new, ["o_orderkey"], table="orders", now=T1, user="u", snapshots=False)
    changes = {(r.o_orderkey, r.var_name): r.modified_value for r in a.collect()}
    replayed = []
    for r in old.collect():
        d = r.asDict()
        for c in ("o_orderpriority", "o_custkey"):
            if (d["o_orderkey"], c) in changes:
                v = changes[(d["o_orderkey"], c)]
                d[c] = int(v) if c == "o_custkey" else v
        replayed.append(d)
    expected = {r.o_orderkey: r.asDict() for r in new.collect()}
    assert {d["o_orderkey"]: d for d in replayed} == expected


def test_update_path_equals_join_path(spark):
    old = add_meta_columns(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), T0, "u")
    cond = F.col("o_orderstatus") == "F"
    sets = {"o_totalprice": F.col("o_totalprice") * 2}
    a1 = audit_update(old, cond, sets, table="orders", now=T1, user="u", keys=["o_orderkey"])
    a2 = audit_rows(old, update(old, cond, sets, now=T1, user="u"), ["o_orderkey"], table="orders", now=T1, user="u")
    assert sorted(map(tuple, a1.collect())) == sorted(map(tuple, a2.collect()))


def test_resolve_step(spark):
    df = spark.range(1)
    got = df.select(
        resolve_step("", "2-ARC").alias("a"), resolve_step(None, None).alias("b"), resolve_step("1-X", "2-ARC").alias("c")
    ).first()
    assert (got.a, got.b, got.c) == ("2-ARC", "3-Normalize", "1-X")


def test_sequence_ids_are_unique_and_rise(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("k"))
    rows = with_sequence_id(df, start=101).collect()
    ids = [r.audit_log_id for r in rows]
    assert min(ids) == 101 and ids == sorted(set(ids))
    assert [r.k for r in rows] == [r.k for r in df.collect()]
    assert not any(x in with_sequence_id(df)._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "Sort"))


def test_appended_log_goes_on_after_its_last_id(spark, tmp_dir):
    path = f"{tmp_dir}/log"
    one = spark.range(0, 10, numPartitions=3).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("var_name"))
    append_audit(one, path)
    first = {r.audit_log_id for r in spark.read.parquet(path).collect()}
    append_audit(one, path)
    ids = [r.audit_log_id for r in spark.read.parquet(path).collect()]
    assert len(first) == 10 and len(set(ids)) == len(ids) == 20
    assert min(set(ids) - first) == max(first) + 1
    assert [r.audit_log_id for r in latest(spark.read.parquet(path), 2).collect()] == sorted(ids)[:-3:-1]
    with pytest.raises(Exception, match="too long"):
        append_audit(one.withColumn("action_code", F.lit("x" * 11)), path)
    assert spark.read.parquet(path).count() == 20


def test_nothing_stays_persisted(spark):
    from veilgrid.plans.audit import QUERIES

    for fn in QUERIES.values():
        fn(spark, "/root/testdata/sf0.001").count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_length_limits_raise_not_cut(spark):
    df = spark.createDataFrame([("x" * 64, "ok"), ("short", "y" * 201)], "var_name string, original_value string")
    v = length_violations(df).collect()
    assert sorted(tuple(r.violations) for r in v) == [("original_value",), ("var_name",)]
    with pytest.raises(Exception):
        enforce_lengths(df).collect()
    assert enforce_lengths(spark.createDataFrame([("a", "b")], "var_name string, original_value string")).count() == 1


def test_defaults_are_now_and_session_user(spark, housing):
    a = audit_update(housing, F.col("cmid") == "000000001", {"broadbnd": F.lit("N")}, table="h")
    r = {x.var_name: x for x in a.collect()}
    assert set(r) >= {"broadbnd", "modified_dt", "modified_by"}
    assert r["broadbnd"].created_by == r["modified_by"].modified_value
    assert r["modified_dt"].created_dt is not None


def test_audit_matches_python_model(spark):
    import random

    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choice([1, 2, None]), rnd.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, s string, n int, x double")
    cond = (F.col("k") % 3 == 0) | F.col("s").isNull()
    sets = {"s": F.coalesce(F.col("s"), F.lit("b")), "n": F.col("n") + F.lit(0) * F.col("k")}
    got = sorted(
        (r.k, r.var_name, r.original_value, r.modified_value)
        for r in audit_update(df, cond, sets, table="t", now=T1, user="u", keys=["k"], stamp=False, snapshots=False).collect()
    )
    expected = []
    for k, s, n, x in rows:
        if k % 3 == 0 or s is None:
            new_s = s if s is not None else "b"
            if new_s != s:
                expected.append((k, "s", s, new_s))
    assert got == sorted(expected)


def test_stamp_modified_touches_only_updated_rows(spark, housing):
    from veilgrid.operators.audit import stamp_modified

    out = {r.cmid: (str(r.modified_dt), r.modified_by) for r in stamp_modified(housing, F.col("cmid") == "000000002", T1, "editor").collect()}
    assert out["000000002"] == ("2024-01-02 09:30:00", "editor")
    assert out["000000001"] == ("2024-01-01 00:00:00", "loader")


def test_assert_unique_keys(spark):
    from veilgrid.operators.audit import assert_unique_keys

    assert_unique_keys(spark.createDataFrame([(1,), (2,)], "k int"), ["k"])
    with pytest.raises(ValueError, match="duplicate key"):
        assert_unique_keys(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])
