"""Mechanisms of the change pipeline that a failure must not break: outbox, ledger, dead letters, rules as a table, ordered ids, JSON and streamed audit."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tests.test_events import DEFAULTS, NAMED, RULE, _line
from veilgrid.functions.joins import spread_join
from veilgrid.operators.audit import append_audit, audit_json, audit_rows, latest, with_ordered_id
from veilgrid.operators.events import dedupe_events, match_rule_table, route_events, valid_events
from veilgrid.sources.events import parsed_frame, read_events
from veilgrid.streaming import bus
from veilgrid.streaming.audit import AuditStream
from veilgrid.streaming.bus import EventConsumer, ExportTable, export_new, publish_batches, read_batches, write_batch

TOLD = {"database": "sales_db", "table": "t", "now": "2024-01-01 12:00:00"}


@pytest.mark.parametrize("fails_at", ["rows", "manifest", "publish", "mark"])
def test_outbox_survives_a_failure_at_each_step(spark, tmp_dir, monkeypatch, fails_at):
    t, b = f"{tmp_dir}/t", f"{tmp_dir}/bus"
    df = spark.range(7).withColumnRenamed("id", "k")

    def run():
        write_batch(df, t, "w1")
        return publish_batches(spark, t, b, **TOLD)

    if fails_at == "rows":  # half-written rows lie there
        spark.range(3).withColumnRenamed("id", "k").write.parquet(f"{t}/batch_id=w1")
        os.remove(f"{t}/batch_id=w1/_SUCCESS")
    elif fails_at == "manifest":
        df.write.parquet(f"{t}/batch_id=w1")
    elif fails_at == "publish":
        with monkeypatch.context() as m:
            m.setattr(bus, "publish", lambda *a, **k: (_ for _ in ()).throw(OSError("bus down")))
            with pytest.raises(OSError):
                run()
    else:  # published, but the mark is lost
        run()
        os.rename(f"{t}/_published", f"{tmp_dir}/lost")
    assert run() == 1 and run() == 0
    assert sorted(r.k for r in read_batches(spark, t).collect()) == list(range(7))
    once = dedupe_events(valid_events(read_events(spark, b)).select(F.col("event.id").alias("event_id"), "event.detail.recordCount"))
    assert [tuple(r) for r in once.collect()] == [("w1", 7)]
    write_batch(spark.range(2).withColumnRenamed("id", "k"), t, "w2")
    assert publish_batches(spark, t, b, **TOLD) == 1 and read_batches(spark, t).count() == 9


def test_rows_without_a_manifest_are_not_read(spark, tmp_dir):
    write_batch(spark.range(2), f"{tmp_dir}/t", "a")
    spark.range(5).write.parquet(f"{tmp_dir}/t/batch_id=b")
    assert read_batches(spark, f"{tmp_dir}/t").count() == 2


def _csv_keys(spark, place):
    return sorted(int(r.k) for r in spark.read.option("header", True).csv(place).collect())


def test_export_of_new_rows_with_a_micro_batch_that_fails_half_way(spark, tmp_dir, monkeypatch):
    a, out, ckpt, rows = (os.path.join(tmp_dir, x) for x in ("a", "out", "ckpt", "rows"))
    table = lambda: ExportTable(spark.read.parquet(rows), ["k"])
    name = ".".join(DEFAULTS)
    consumer = lambda: EventConsumer(spark, [a], out, ckpt, {"direct": RULE}, **NAMED, tables={name: table()}, only_new=True)

    def event(id_):
        spark.createDataFrame([(_line(id_),)], "value string").coalesce(1).write.mode("append").text(a)

    spark.range(10).withColumnRenamed("id", "k").write.parquet(rows)
    event("e1")
    consumer().start().awaitTermination()
    spark.range(10, 15).withColumnRenamed("id", "k").write.mode("append").parquet(rows)
    event("e2")
    with monkeypatch.context() as m:  # T12: the second micro-batch fails after its export
        m.setattr(bus, "archive", lambda *x, **y: (_ for _ in ()).throw(OSError("archive down")))
        with pytest.raises(Exception, match="archive down"):
            consumer().start().awaitTermination()
    spark.range(15, 18).withColumnRenamed("id", "k").write.mode("append").parquet(rows)
    consumer().start().awaitTermination()  # the retried epoch repeats its own rows, not the newer ones
    event("e3")
    consumer().start().awaitTermination()
    notes = {r.event_id: r.export_location for r in spark.read.parquet(f"{out}/notifications").collect()}
    assert [_csv_keys(spark, notes[e]) for e in ("e1", "e2", "e3")] == [list(range(10)), list(range(10, 15)), list(range(15, 18))]


def test_ledger_repeats_an_epoch(spark, tmp_dir):
    rows = lambda n: ExportTable(spark.range(n).withColumnRenamed("id", "k"), ["k"])
    keys = lambda n, e: sorted(r.k for r in export_new(rows(n), f"{tmp_dir}/l", e).collect())
    assert keys(3, 0) == [0, 1, 2] and keys(5, 1) == [3, 4] and keys(9, 1) == [3, 4] and keys(9, 2) == [5, 6, 7, 8] and keys(9, 3) == []


def test_dead_letters_go_back_and_grow_old(spark, tmp_dir):
    a, out, ckpt = (os.path.join(tmp_dir, x) for x in ("a", "out", "ckpt"))
    lines = [_line("ok"), _line("late", time="yesterday"), '{"broken', _line("x", detail=False)]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(a)
    pipe = EventConsumer(spark, [a], out, ckpt, {"direct": RULE}, **NAMED)
    pipe.start_dead_letters().awaitTermination()
    assert sorted(r.reason for r in spark.read.parquet(f"{out}/dead_letters").collect()) == ["invalid: time", "unparseable"]
    day = str(spark.read.parquet(f"{out}/dead_letters").first().arrived)
    mend = lambda v: F.replace(v, F.lit('"yesterday"'), F.lit('"2024-01-01T00:00:00Z"'))
    left = pipe.redrive(a, mend, day)
    assert [r.value for r in left.collect()] == ['{"broken']
    pipe.start().awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(f"{out}/notifications").collect()) == ["late", "ok"]
    later = str(spark.range(1).select(F.date_add(F.lit(day).cast("date"), 14)).first()[0])
    almost = str(spark.range(1).select(F.date_add(F.lit(day).cast("date"), 13)).first()[0])
    assert pipe.drop_old_dead_letters(almost) == 0 and pipe.drop_old_dead_letters(later) == 1 and pipe._dead_letter_days() == []


def test_rule_table_equals_predicates(spark):
    rng = random.Random(1)
    dbs, kinds = [f"d{i}" for i in range(8)] + [None], [f"t{i}" for i in range(5)]
    lines = [json.dumps({"id": f"e{i}", "detail-type": rng.choice(kinds), "source": "s", "time": "2024-01-01", "detail": {"database": rng.choice(dbs)}}) for i in range(200)]
    ev = valid_events(parsed_frame(spark.createDataFrame([(x,) for x in lines], "value string")))
    names = ["source", "detail-type", "detail.database"]
    pick = {"source": ["s", "other"], "detail-type": [*kinds, "none"], "detail.database": [*dbs[:-1], "none"]}
    rules = {f"r{i}": {n: rng.sample(pick[n], rng.randrange(1, 3)) for n in rng.sample(names, rng.randrange(1, 4))} for i in range(60)}
    rows = [(r, n, v) for r, p in rules.items() for n, v in p.items()]
    rows += [("ghost", "detail-type", kinds), ("ghost", "no such field", ["x"]), ("split", "detail-type", ["t0"]), ("split", "detail-type", ["t0", "t1"])]
    rules["split"] = {"detail-type": ["t0", "t1"]}
    e = F.col("event")
    fields = {"source": e["source"], "detail-type": e["detail-type"], "detail.database": e["detail"]["database"]}
    got = match_rule_table(ev, spark.createDataFrame(rows, "rule string, field string, values array<string>"), fields)
    pairs = lambda df: sorted((r.id, r.rule) for r in df.select("event.id", "rule").collect())
    assert pairs(got) == pairs(route_events(ev, rules)) and got.columns == [*ev.columns, "rule"]


def test_a_join_spreads_a_key_that_most_rows_share(spark):
    many = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).when(F.col("id") % 997 != 1, F.lit("common")).alias("k"))
    few = spark.createDataFrame([("common", "a"), ("common", "b"), ("10", "c"), ("10", "c"), ("none", "d"), (None, "e")], "k string, rule string")
    want = many.join(few, "k")
    got = spread_join(many, few, ["k"], most=100)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    # Without AQE, which would put small partitions together: no task meets more than a small share of the common rows.
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(held, ("false", "-1", "64"), strict=True):
            spark.conf.set(k, v)
        at = lambda df: [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert max(at(want)) > 7000 and max(at(spread_join(many, few, ["k"], most=100))) < 1800
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_ordered_ids_are_gap_free_and_go_on(spark, tmp_dir):
    df = spark.range(0, 5000, 1, 7).select((F.pmod(F.xxhash64("id"), F.lit(1000))).alias("a"), F.col("id").alias("b"))
    got = [(r.audit_log_id, r.a, r.b) for r in with_ordered_id(df, ["a", "b"]).orderBy("audit_log_id").collect()]
    assert [g[0] for g in got] == list(range(1, 5001)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    assert with_ordered_id(df.limit(0), ["a"]).count() == 0
    for n in (3, 0, 4):
        append_audit(df.limit(n), f"{tmp_dir}/log", order_cols=["a", "b"])
    log = spark.read.parquet(f"{tmp_dir}/log")
    assert [r.audit_log_id for r in latest(log, 100).collect()] == list(range(7, 0, -1))


def test_json_audit_of_varying_keys(spark):
    rows = [
        (1, '{"a":1,"b":"x","only_old":1}', '{"b":"y","a":2,"only_new":1}'),
        (2, '{"n":null,"s":"1"}', '{"n":"null","s":1}'),
        (3, '{"o":{"x":[1,2]},"same":{"p":1}}', '{"o":{"x":[1,3]},"same":{"p":1}}'),
        (4, None, '{"a":1}'), (5, "[1]", '{"a":1}'), (6, "{}", "{}"), (7, '{"a":null}', '{"a":null}'), (8, '{"a":"ä\\"b"}', '{"a":null}'),
    ]
    out = audit_json(spark.createDataFrame(rows, "k int, o string, n string"), "o", "n", table="t", keys=["k"], user="u", now="2024-01-01 00:00:00")
    got = sorted((r.k, r.var_name, r.original_value, r.modified_value, tuple(r.changed_keys)) for r in out.collect())
    assert got == [
        (1, "a", "1", "2", ("a", "b")), (1, "b", "x", "y", ("a", "b")), (2, "n", None, "null", ("n",)),
        (3, "o", '{"x":[1,2]}', '{"x":[1,3]}', ("o",)), (8, "a", 'ä"b', None, ("a",)),
    ]


def test_streamed_audit_equals_the_batch_audit(spark, tmp_dir, monkeypatch):
    kind = "k int, s string, n int, seq long"
    states = [
        [(i, "a", i, 0) for i in range(20)],
        [(i, "b" if i % 2 else "a", i, 1) for i in range(0, 20, 3)] + [(5, "c", 5, 2), (5, "c", 6, 3), (99, "new", 0, 1)],
        [(5, None, 6, 4), (99, "new", 1, 5), (3, "b", 3, 6)],
    ]
    stream = lambda: AuditStream(spark, f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ckpt", schema=kind, keys=["k"], seq="seq", table="t", now="2024-01-01 00:00:00", user="u")
    want, now = [], {}
    for rows in states:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/in")
        if len(want) > 2:
            with monkeypatch.context() as m:  # the micro-batch fails after its audit rows, before its state
                m.setattr(AuditStream, "_keep_state", lambda *a: (_ for _ in ()).throw(OSError("state down")))
                with pytest.raises(Exception, match="state down"):
                    stream().start().awaitTermination()
        stream().start().awaitTermination()
        for k, s, n, _ in sorted(rows, key=lambda r: r[3]):
            if k in now:
                old, new = (spark.createDataFrame([(k, *x)], "k int, s string, n int") for x in (now[k], (s, n)))
                want += [(r.k, r.var_name, r.original_value, r.modified_value) for r in audit_rows(old, new, ["k"], table="t", now="2024-01-01 00:00:00", user="u").collect()]
            now[k] = (s, n)
    log = spark.read.parquet(f"{tmp_dir}/out/audit")
    got = [(r.k, r.var_name, r.original_value, r.modified_value) for r in log.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 6
    assert sorted(tuple(r) for r in stream().state().select("k", "n").collect()) == sorted((k, v[1]) for k, v in now.items())
