"""Change events: the F9 cases, batch operators, streaming = batch twin, T1, T9 increments."""

import json
import os

from pyspark.sql import functions as F

from veilgrid.operators.audit import ts_literal
from veilgrid.operators.events import (
    archive,
    dead_letters,
    dedupe_events,
    export_increment,
    forward,
    normalize_event,
    notifications,
    quality_gate,
    route_events,
    valid_events,
    wrap_event,
)
from veilgrid.sources.events import parsed_frame, read_event_stream, read_events
from veilgrid.streaming.bus import EventConsumer, ExportTable, run_forwarder, write_and_publish

DEFAULTS = ("aeronav_db", "navigation_waypoints")
NAMED = {"default_database": DEFAULTS[0], "default_table": DEFAULTS[1]}
RULE = {"source": ["app.writer"], "detail-type": ["Data Table Updated"], "detail.database": ["aeronav_db"]}


def _line(id, database="aeronav_db", table="navigation_waypoints", count=3, detail=True, time="2024-01-01T12:00:00.000000"):
    env = {"version": "0", "id": id, "detail-type": "Data Table Updated", "source": "app.writer", "account": "000000000000", "time": time, "region": "local-1"}
    if detail:
        env["detail"] = {"database": database, "table": table, "operation": "INSERT", "recordCount": count}
    return json.dumps(env)


def _f9(spark):
    lines = [
        _line("e1"),
        _line("e2", database="aeroweather_db", table="weather_observations"),
        _line("e3", detail=False),
        _line("e1"),
        '{"version": "0", "id": "e5", "detail-type": "Data Ta',
        _line("e6", table="None", count=0),
    ]
    return parsed_frame(spark.createDataFrame([(x,) for x in lines], "value string"))


def test_f9_cases(spark):
    df = _f9(spark)
    dl = {r.value[:20]: r.reason for r in dead_letters(df).collect()}
    assert list(dl.values()) == ["unparseable"]
    ok = valid_events(df)
    assert ok.count() == 5
    routed = route_events(ok, {"direct": RULE})
    assert sorted(r.event.id for r in routed.collect()) == ["e1", "e1", "e6"]  # wrong db and missing detail do not match
    once = dedupe_events(routed.select(F.col("event.id").alias("event_id")), "event_id")
    assert sorted(r.event_id for r in once.collect()) == ["e1", "e6"]
    n = {r.event_id: (r.database, r.table, r.record_count) for r in normalize_event(ok, *DEFAULTS).collect()}
    assert n["e3"] == ("aeronav_db", "navigation_waypoints", 3)  # missing detail → defaults
    assert n["e6"] == ("aeronav_db", "navigation_waypoints", 0)  # 'None' table → default; count 0 kept
    assert n["e2"] == ("aeroweather_db", "weather_observations", 3)


def test_gate_archive_notification_wrap(spark):
    n = normalize_event(valid_events(_f9(spark)), *DEFAULTS)
    q = quality_gate(n, {"has_records": F.col("record_count") > 0})
    assert sorted(r.event_id for r in q.filter(~F.col("accepted")).collect()) == ["e6"]
    arch = archive(n, ts_literal("2024-02-01 00:00:00"))
    assert "e6" not in [r.event_id for r in arch.collect()]
    msg = notifications(n.withColumn("export_location", F.lit(None).cast("string")), ts_literal("2024-02-01 00:00:00"), *DEFAULTS)
    m = msg.filter(F.col("event_id") == "e3").first().message
    assert "Database: aeronav_db\nTable: navigation_waypoints\nRecords: 3\nLocation: Not available" in m
    w = wrap_event(n, ts_literal("2024-02-01 00:00:00")).first()
    assert w.event_validated and w.original_event.id == w.event_id


def test_export_increment_disjoint_and_complete(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    first = orders.filter(F.col("o_orderdate") < ts_literal("1998-01-01 00:00:00"))
    inc = export_increment(orders, first.select("o_orderkey"), ["o_orderkey"])
    assert first.join(inc, "o_orderkey").count() == 0
    assert first.count() + inc.count() == orders.count()


def test_streaming_equals_batch_and_increments(spark, tmp_dir):
    bus_a, bus_b, out, ckpt = (os.path.join(tmp_dir, x) for x in ("a", "b", "out", "ckpt"))
    lines = [_line(f"e{i}", count=i % 4, time=f"2024-01-0{1 + i // 10}T0{i % 10}:00:00.000000") for i in range(30)]
    lines += ['{"broken', _line("x1", database="other_db")]
    spark.createDataFrame([(x,) for x in lines[:16]], "value string").coalesce(1).write.text(bus_a)
    run_forwarder(spark, bus_a, bus_b, RULE, f"{ckpt}/fwd").awaitTermination()
    rows = spark.createDataFrame([(f"WP{i:03}", i) for i in range(50)], "waypoint_id string, n int").repartition(5)
    table = ExportTable(rows, ["waypoint_id"])
    pipe = EventConsumer(spark, [bus_a, bus_b], out, ckpt, {"direct": RULE}, max_files=1, **NAMED, tables={"aeronav_db.navigation_waypoints": table})
    pipe.start_dead_letters().awaitTermination()
    pipe.start().awaitTermination()
    first = {r.event_id for r in spark.read.parquet(f"{out}/notifications").collect()}
    # A second arrival: only the new file is processed (offsets in the checkpoint).
    spark.createDataFrame([(x,) for x in lines[16:]], "value string").coalesce(1).write.mode("append").text(bus_a)
    run_forwarder(spark, bus_a, bus_b, RULE, f"{ckpt}/fwd").awaitTermination()
    pipe.start_dead_letters().awaitTermination()
    pipe.start().awaitTermination()
    notes = spark.read.parquet(f"{out}/notifications")
    ids = [r.event_id for r in notes.collect()]
    assert len(ids) == len(set(ids))  # each event once, despite two delivery paths
    batch = route_events(valid_events(read_events(spark, bus_a)), {"direct": RULE})
    assert set(ids) == {r.event.id for r in batch.collect()}
    assert first and first < set(ids)
    assert [r.reason for r in spark.read.parquet(f"{out}/dead_letters").collect()] == ["unparseable"]
    # Every location that a notification names holds the table's rows, in key order.
    for r in notes.select("export_location").distinct().collect():
        got = [x.waypoint_id for x in spark.read.option("header", True).csv(r.export_location).collect()]
        assert sorted(got) == [f"WP{i:03}" for i in range(50)]
        parts = sorted(f for f in os.listdir(r.export_location) if f.startswith("part"))
        lines = [x for f in parts for x in open(os.path.join(r.export_location, f)).read().splitlines()[1:]]
        assert lines == sorted(lines)


def test_write_and_publish(spark, tmp_dir):
    df = spark.createDataFrame([("WP_POC_001", "POC_ALPHA"), ("WP_POC_002", "POC_BRAVO"), ("WP_POC_003", "POC_CHARLIE")], "waypoint_id string, waypoint_name string")
    res = write_and_publish(df, f"{tmp_dir}/t", f"{tmp_dir}/bus", database="aeronav_db", table="navigation_waypoints", event_id="w1", now="2024-01-01 12:00:00")
    assert res == {"written": True, "published": True, "error": None, "rows": 3}
    ev = read_events(spark, f"{tmp_dir}/bus").first().event
    assert ev.detail.recordCount == 3 and ev.id == "w1"
    blocked = f"{tmp_dir}/not_a_folder"
    with open(blocked, "w") as fh:
        fh.write("x")
    bad = write_and_publish(df, f"{blocked}/t", f"{tmp_dir}/bus2", database="d", table="t", event_id="w2", now="2024-01-01 12:00:00")
    assert not bad["written"] and not bad["published"] and not os.path.exists(f"{tmp_dir}/bus2")


def test_streaming_quality_gate_rejects(spark, tmp_dir):
    bus, out, ckpt = (os.path.join(tmp_dir, x) for x in ("a", "out", "ckpt"))
    lines = [_line(f"q{i}", count=i % 3) for i in range(9)]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(bus)
    pipe = EventConsumer(spark, [bus], out, ckpt, {"direct": RULE}, quality_rules={"has_records": F.col("record_count") > 0}, **NAMED)
    pipe.start().awaitTermination()
    rejected = sorted(r.event_id for r in spark.read.parquet(f"{out}/rejected").collect())
    noted = sorted(r.event_id for r in spark.read.parquet(f"{out}/notifications").collect())
    assert rejected == ["q0", "q3", "q6"]
    assert noted == sorted(f"q{i}" for i in range(9) if i % 3)


def test_retried_epoch_replaces_its_output(spark, tmp_dir):
    """A micro-batch that is run again (task retry, restart) overwrites its own output."""
    out = os.path.join(tmp_dir, "out")
    pipe = EventConsumer(spark, [os.path.join(tmp_dir, "unused")], out, os.path.join(tmp_dir, "ckpt"), {"direct": RULE}, **NAMED)
    batch = route_events(valid_events(_f9(spark)), {"direct": RULE}).drop("rule").dropDuplicates(["value"])
    pipe._process_batch(batch, 7)
    pipe._process_batch(batch, 7)
    notes = spark.read.parquet(f"{out}/notifications")
    assert notes.count() == batch.count() == 2
    assert {r.batch_id for r in notes.select("batch_id").collect()} == {7}


def test_late_event_is_processed_once(spark, tmp_dir):
    """An event two days older than what came before it is exported, archived and announced like any other."""
    bus, out, ckpt = (os.path.join(tmp_dir, x) for x in ("a", "out", "ckpt"))
    pipe = EventConsumer(spark, [bus], out, ckpt, {"direct": RULE}, max_files=1, **NAMED)
    for line in (_line("now", time="2024-01-09T12:00:00.000000"), _line("late", time="2024-01-07T11:00:00.000000"), _line("late", time="2024-01-07T11:00:00.000000")):
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(bus)
        pipe.start().awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(f"{out}/notifications").collect()) == ["late", "now"]
    assert {r.export_location for r in spark.read.parquet(f"{out}/notifications").collect()} == {None}  # no table to export


def test_root_fields_stand_in_for_an_empty_detail(spark):
    env = {"version": "0", "id": "r1", "detail-type": "t", "source": "s", "time": "2024-01-01T12:00:00.000000"}
    lines = [env | {"database": "d1", "table": "t1", "recordCount": 7}, env | {"id": "r2", "database": "d1", "detail": {"table": "t2"}}, env | {"id": "r3", "detail": {}, "table": "None"}]
    df = parsed_frame(spark.createDataFrame([(json.dumps(x),) for x in lines], "value string"))
    got = {r.event_id: (r.database, r.table, r.record_count) for r in normalize_event(valid_events(df), "dd", "tt").collect()}
    assert got == {"r1": ("d1", "t1", 7), "r2": ("dd", "t2", 3), "r3": ("dd", "tt", 3)}


SAMPLE = """{"version": "0", "id": "unique-event-id", "detail-type": "Data Table Updated", "source": "bus.writer", "account": "1",
 "time": "2024-01-01T12:00:00Z", "region": "r-1", "resources": ["a", {"b": [1, 2.5, null, true]}],
 "detail": {"database": "nav_db", "table": "waypoints", "operation": "INSERT", "recordCount": 3, "queryExecutionId": "query-id",
 "timestamp": "2024-01-01T12:00:00.000Z", "sourceAccount": "1", "note": {"why": "äöü", "cols": [["x"], []]}}}""".replace("\n", "")


def test_sample_envelope_keeps_every_field_in_batch_and_stream(spark, tmp_dir):
    (spark.createDataFrame([(SAMPLE,)], "value string").write.text(f"{tmp_dir}/bus"))
    wrapped = wrap_event(valid_events(read_events(spark, f"{tmp_dir}/bus")), ts_literal("2024-02-01 00:00:00"))
    row = wrapped.select("event", F.to_json("original").alias("original")).first()
    assert json.loads(row.original) == json.loads(SAMPLE)
    assert str(row.event.time) == "2024-01-01 12:00:00" and row.event.detail.recordCount == 3
    stream = valid_events(read_event_stream(spark, f"{tmp_dir}/bus")).select("event.id", "event.time", F.to_json("raw").alias("raw"))
    stream.writeStream.format("parquet").option("path", f"{tmp_dir}/out").option("checkpointLocation", f"{tmp_dir}/ckpt").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{tmp_dir}/out").first()
    assert out.id == "unique-event-id" and json.loads(out.raw) == json.loads(SAMPLE) and str(out.time) == "2024-01-01 12:00:00"


def test_a_line_is_read_in_one_go(spark):
    """The plan names every field once: the envelope is one read of the VARIANT, the counts' numbers one more each."""
    df = forward(valid_events(_f9(spark)), RULE).select("value")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get(") == 3


def test_times_counts_and_details_of_any_kind(spark):
    base = {"id": "a", "detail-type": "t", "source": "s"}
    times = {
        "2024-01-01T12:00:00Z": "2024-01-01 12:00:00", "2024-01-01T12:00:00": "2024-01-01 12:00:00", "2024-01-01T12:00:00.000Z": "2024-01-01 12:00:00",
        "2024-01-01T12:00:00.123456+02:00": "2024-01-01 10:00:00.123456", "2024-01-01T12:00:00-0530": "2024-01-01 17:30:00", "2024-01-01 12:00:00+01": "2024-01-01 11:00:00",
        "2024-01-01": "2024-01-01 00:00:00", "2024-11-03T06:30:00Z": "2024-11-03 06:30:00", "noon": None, "2024-13-01T00:00:00Z": None, 5: None,
    }
    details = [({"recordCount": 5_000_000_000}, 5_000_000_000), ({"recordCount": "12"}, 12), ("text", 3), ([1], 3), ({"recordCount": "many"}, None)]
    lines = [json.dumps(base | {"time": t}) for t in times] + [json.dumps(base | {"time": "2024-01-01T12:00:00Z", "detail": d}) for d, _ in details]
    old = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            df = parsed_frame(spark.createDataFrame([(x,) for x in lines], "value string"))
            got = {r.value: r for r in df.select("value", "event.time", "event._invalid").collect()}
            counts = {r.value: r.record_count for r in normalize_event(valid_events(df), *DEFAULTS).collect()}
        finally:
            spark.conf.set("spark.sql.session.timeZone", old)
        assert [got[x].time and str(got[x].time) for x in lines[: len(times)]] == list(times.values())
        assert [counts.get(x) for x in lines[len(times) :]] == [n for _, n in details]
        assert len(counts) == 8 + 4
