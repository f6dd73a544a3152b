"""Change-event pipeline on the driver ``events`` table.

Mapping (ours): each event row is published as a JSON envelope —
``detail-type`` = event_type, ``source`` = 'app.events', ``time`` = ts and a
``detail`` whose database is one of three (by user) and whose table is the
event type; 'signup' events carry no database/table (the defaults apply);
``recordCount`` = props.k. The routed rule matches purchase/signup/click
events of 'sales_db'; like the reference's direct rule plus forward + local
rule, every routed event is delivered twice and de-duplicated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.functions.scalars import like
from veilgrid.operators.audit import ts_literal
from veilgrid.operators.events import (
    archive,
    dead_letters,
    dedupe_events,
    export_increment,
    match_rule_table,
    normalize_event,
    notifications,
    quality_gate,
    route_events,
    valid_events,
    wrap_event,
)
from veilgrid.session import scratch_root
from veilgrid.sources.events import PARSE_SCHEMA, envelope, parsed_frame, to_json_text
from veilgrid.sources.sinks import export_csv
from veilgrid.sources.tables import read_table
from veilgrid.streaming.bus import EventConsumer, ExportTable, export_new, run_forwarder, with_location

SOURCE = "app.events"
DATABASES = ("sales_db", "ops_db", "ref_db")
DEFAULT_DATABASE = "app_db"
DEFAULT_TABLE = "events"
RUN_TS = "2024-02-01 12:00:00"
EXPORT_BASE = "/exports"
DIRECT_RULE = {"source": [SOURCE], "detail-type": ["purchase", "signup", "click"], "detail.database": ["sales_db"]}
PURCHASE_RULE = {"detail-type": ["purchase"]}
EXPORT_CUTOFF = "1998-01-01 00:00:00"


def _envelope(ev: DataFrame):
    """(envelope column, record count column) of an event row."""
    k = F.get_json_object("props", "$.k").cast("long")
    signup = F.col("event_type") == "signup"
    db = F.when(~signup, F.element_at(F.array(*[F.lit(d) for d in DATABASES]), (F.pmod(F.col("user_id"), F.lit(3)) + 1).cast("int")))
    detail = F.struct(
        db.alias("database"),
        F.when(~signup, F.col("event_type")).alias("table"),
        F.lit("INSERT").alias("operation"),
        k.alias("recordCount"),
        F.concat(F.lit("q-"), F.col("event_id").cast("string")).alias("queryExecutionId"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.lit("000000000000").alias("sourceAccount"),
    )
    env = envelope(
        id=F.col("event_id"),
        detail_type=F.col("event_type"),
        source=F.lit(SOURCE),
        time=F.col("ts"),
        detail=detail,
        account=F.lit("000000000000"),
        region=F.lit("local-1"),
    )
    return env, k


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one JSON envelope line (``value``)."""
    ev = read_table(spark, sf_dir, "events")
    env, k = _envelope(ev)
    return ev.select(to_json_text(env).alias("value"), F.col("event_type"), k.alias("k"), "props")


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a consumer sees them once they are parsed, without going through text."""
    ev = read_table(spark, sf_dir, "events")
    env, _ = _envelope(ev)
    known = {f.name for f in ev.select(env.alias("e")).schema["e"].dataType.fields}
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in PARSE_SCHEMA.fields if f.name not in known]
    whole = ev.select(env.alias("e"), *rest)
    fields = [F.col("e")[f.name].alias(f.name) if f.name in known else F.col(f.name) for f in PARSE_SCHEMA.fields]
    return whole.select(F.struct(*fields).alias("event"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse the published lines back into envelopes."""
    return parsed_frame(published(spark, sf_dir))


def _flat(df: DataFrame) -> DataFrame:
    e = F.col("event")
    return df.select(
        e["id"].alias("event_id"),
        e["detail-type"].alias("detail_type"),
        e["detail"]["database"].alias("database"),
        e["time"].alias("event_time"),
    )


def events_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 + P6: one row per (event, matching rule)."""
    routed = route_events(valid_events(typed(spark, sf_dir)), {"direct": DIRECT_RULE, "purchases": PURCHASE_RULE})
    return routed.select(
        F.col("event.id").alias("event_id"),
        F.col("event")["detail-type"].alias("detail_type"),
        F.col("event.detail.database").alias("database"),
        "rule",
    )


def deliveries(valid: DataFrame) -> DataFrame:
    """An event matching the direct rule is delivered by it and, after forwarding, again by the
    local rule — two delivery rows per event, produced in one pass (in-row explode, no union re-scan)."""
    return route_events(valid, {"direct": DIRECT_RULE, "local_via_forward": DIRECT_RULE})


def events_deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: each routed event once, although it was delivered twice."""
    return dedupe_events(_flat(deliveries(valid_events(typed(spark, sf_dir)))), "event_id")


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_event(valid_events(typed(spark, sf_dir)), DEFAULT_DATABASE, DEFAULT_TABLE)


def events_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 + P10 + S16 + S17: flat database/table/count with defaults, through the JSON text and back."""
    n = normalize_event(valid_events(parsed(spark, sf_dir)), DEFAULT_DATABASE, DEFAULT_TABLE)
    return n.select(
        "event_id", "detail_type", "source", "event_time", "database", "table", "record_count"
    )


def events_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named rules; failed rule names per event."""
    n = normalized(spark, sf_dir)
    rules = {
        "has_records": F.col("record_count") > 0,
        "named_database": F.col("event.detail.database").isNotNull(),
        "in_january": F.col("event_time") < ts_literal("2024-02-01 00:00:00"),
    }
    q = quality_gate(n, rules)
    return q.select("event_id", "accepted", F.array_join("failed_rules", ",").alias("failed_rules"))


def events_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10 + P8: archive records for events with records."""
    a = archive(normalized(spark, sf_dir), ts_literal(RUN_TS))
    return a.select("event_id", "database", "table", "record_count", "archive_status", "archived_at")


def export_tables(spark: SparkSession, sf_dir: str) -> dict[str, ExportTable]:
    """The tables that the routed events name: the events of one type, by event_id."""
    ev = read_table(spark, sf_dir, "events")
    return {f"sales_db.{t}": ExportTable(ev.filter(F.col("event_type") == t), ["event_id"]) for t in ("purchase", "click")}


def events_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8 path + T11: export location and notification text of each de-duplicated routed event."""
    once = dedupe_events(deliveries(valid_events(typed(spark, sf_dir))).drop("rule").withColumn("_id", F.col("event.id")), "_id")
    n = normalize_event(once.drop("_id"), DEFAULT_DATABASE, DEFAULT_TABLE)
    n = with_location(n, EXPORT_BASE, list(export_tables(spark, sf_dir)))
    out = notifications(n, ts_literal(RUN_TS), DEFAULT_DATABASE, DEFAULT_TABLE)
    return out.select("event_id", "export_location", "subject", "message")


def events_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixed feed — envelopes, bare props objects of 'error' events, and cut-off lines of
    'view' events with k < 10 — split into dead letters by reason. One scan."""
    pub = published(spark, sf_dir)
    cut = F.when((F.col("event_type") == "view") & (F.col("k") < 10), F.substring("value", 1, 40))
    bare = F.when(F.col("event_type") == "error", F.col("props"))
    feed = pub.select(F.explode(F.array_compact(F.array(F.col("value"), cut, bare))).alias("value"))
    dl = dead_letters(parsed_frame(feed))
    return dl.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def foreign_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as another producer may write it (``value``), by event_id modulo 8: times of five forms and zones,
    a count beyond 32 bits, fields that no envelope names, times that are none, and lines cut off."""
    ev = read_table(spark, sf_dir, "events").withColumn("form", F.pmod("event_id", F.lit(8)))
    k, form = F.get_json_object("props", "$.k").cast("long"), F.col("form")
    at = lambda fmt, shift="0": F.date_format(F.col("ts") + F.expr(f"INTERVAL {shift} MINUTES"), fmt)
    time = (
        F.when(form == 1, at("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(form == 2, at("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .when(form == 3, at("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'", "120"))
        .when(form == 4, at("yyyy-MM-dd' 'HH:mm:ss.SSSSSS'-0530'", "-330"))
        .when(form == 7, F.lit("yesterday"))
        .otherwise(at("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    )
    columns = F.when(form == 6, F.array(F.struct(F.col("event_type").alias("name"), F.array(k, k + 1).alias("versions"))))
    detail = F.struct(
        F.lit("sales_db").alias("database"),
        F.when(form == 5, k + 5_000_000_000).otherwise(k).alias("recordCount"),
        columns.alias("columns"),
    )
    line = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("detail-type"), F.lit(SOURCE).alias("source"), time.alias("time"),
            F.array(F.concat(F.lit("table/"), "event_type")).alias("resources"), detail.alias("detail"),
        )
    )
    return ev.select(F.when((form == 0) & (k % 10 == 0), F.substring(line, 1, 30)).otherwise(line).alias("value"))


def events_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of foreign producers, with the fields no envelope names read back from the wrapped original."""
    feed = parsed_frame(foreign_lines(spark, sf_dir))
    good = wrap_event(normalize_event(valid_events(feed), DEFAULT_DATABASE, DEFAULT_TABLE), ts_literal(RUN_TS))
    inner = lambda path, kind: F.try_variant_get("original", path, kind)
    rows = good.select(
        "event_id", "event_time", "database", "record_count",
        inner("$.resources[0]", "string").alias("resource"),
        inner("$.detail.columns[0].name", "string").alias("column_name"),
        inner("$.detail.columns[0].versions[1]", "long").alias("column_version"),
        F.lit(None).cast("string").alias("reason"),
    )
    empty = [F.lit(None).cast(t).alias(c) for c, t in rows.dtypes[1:-1]]
    return rows.unionByName(dead_letters(feed).select(F.col("event.id").alias("event_id"), *empty, "reason"))


def orders_export_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9 batch twin: orders not in the previous export (keys exported up to the cutoff)."""
    orders = read_table(spark, sf_dir, "orders")
    exported = orders.filter(F.col("o_orderdate") < ts_literal(EXPORT_CUTOFF)).select("o_orderkey")
    return export_increment(orders, exported, ["o_orderkey"])


def events_rules_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 with rules as a table: every user subscribes to purchases and clicks of its own, every type to its events of one database."""
    ev = typed(spark, sf_dir)
    src = read_table(spark, sf_dir, "events")
    common = F.struct(F.lit("source").alias("field"), F.array(F.lit(SOURCE)).alias("values"))
    field = lambda name, *values: F.struct(F.lit(name).alias("field"), F.array(*values).alias("values"))
    own = src.select("user_id", "event_id").groupBy("user_id").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    q = lambda c: F.concat(F.lit("q-"), F.col(c).cast("string"))
    users = own.select(F.concat(F.lit("user-"), "user_id").alias("rule"), F.inline(F.array(common, field("detail-type", F.lit("purchase"), F.lit("click")), field("query", q("first"), q("last")))))
    kinds = src.select("event_type").distinct().select(F.concat(F.lit("type-"), "event_type").alias("rule"), F.inline(F.array(common, field("detail-type", F.col("event_type")), field("database", F.lit("ops_db")))))
    e = F.col("event")
    # Only what the rules name and the result shows goes through the join.
    fields = {"source": e["source"], "detail-type": e["detail-type"], "database": e["detail"]["database"], "query": e["detail"]["queryExecutionId"]}
    narrow = ev.select(e["id"].alias("event_id"), *[c.alias(name) for name, c in fields.items()])
    return match_rule_table(narrow, users.unionByName(kinds), {name: F.col(f"`{name}`") for name in fields}).select("event_id", "rule")


def orders_exported_in_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9 in the stream: a table that grows between three epochs, the second of them run twice; what each of them exported."""
    orders = read_table(spark, sf_dir, "orders")
    ledger = f"{scratch_root(spark, 'ledger')}/sales_db.orders"
    out = None
    for epoch, until in ((0, "1994-01-01"), (1, "1996-01-01"), (1, "1997-01-01"), (2, "1997-01-01")):
        rows = export_new(ExportTable(orders.filter(F.col("o_orderdate") < ts_literal(until + " 00:00:00")), ["o_orderkey"]), ledger, epoch)
        part = rows.select(F.lit(epoch).alias("epoch"), F.lit(until).alias("until"), "o_orderkey")
        out = part if out is None else out.unionByName(part)
    return out


def run_stream(spark: SparkSession, sf_dir: str) -> str:
    """The streaming pipeline over all events; returns the folder that holds its output.

    The feed is written once, then the forwarder (bus A to bus B) and the
    consumer (bus A and bus B) each run until they have read all there is. Every
    event that the rule matches arrives twice. Folders lie below the shared one.
    """
    root = scratch_root(spark, "events-stream")
    bus_a, bus_b, out, ckpt = (f"{root}/{x}" for x in ("bus_a", "bus_b", "out", "ckpt"))
    published(spark, sf_dir).select("value").write.text(bus_a)
    run_forwarder(spark, bus_a, bus_b, DIRECT_RULE, f"{ckpt}/forwarder").awaitTermination()
    pipe = EventConsumer(
        spark,
        [bus_a, bus_b],
        out,
        ckpt,
        {"direct": DIRECT_RULE},
        default_database=DEFAULT_DATABASE,
        default_table=DEFAULT_TABLE,
        tables=export_tables(spark, sf_dir),
        now=RUN_TS,
    )
    pipe.start().awaitTermination()
    return out


def events_stream_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3, T4, T11 end to end: the stream's notifications, which equal the batch twin's but for the folder."""
    out = run_stream(spark, sf_dir)
    notes = spark.read.parquet(f"{out}/notifications")
    here = lambda c: F.replace(F.col(c), F.lit(out), F.lit(EXPORT_BASE)).alias(c)
    return notes.select("event_id", here("export_location"), "subject", here("message"))


def events_table_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies where the notifications say that the changed tables were exported."""
    out = run_stream(spark, sf_dir)
    places = [r[0] for r in spark.read.parquet(f"{out}/notifications").select("export_location").distinct().collect()]
    schema = read_table(spark, sf_dir, "events").schema
    rows = spark.read.option("header", True).option("nullValue", "").schema(schema).csv(places)
    return rows.select("event_id", "user_id", "event_type", "value")


def export_customers_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8 + S12 + P4 + O2: the rows of a table whose key matches a LIKE pattern, in key order,
    exported as CSV (header, NULL as empty) under ``exported-data/{db}/{table}/export_{ts}.csv``
    and read back with the table's schema."""
    cust = read_table(spark, sf_dir, "customer")
    rows = cust.filter(like("c_name", "Customer#0000_0%"))
    path = export_csv(rows, scratch_root(spark, "export"), "sales_db", "customer", "20240201_120000", order_by=["c_custkey"])
    return spark.read.option("header", True).option("nullValue", "").schema(cust.schema).csv(path)


QUERIES = {
    "export_customers_like": export_customers_like,
    "events_stream_notifications": events_stream_notifications,
    "events_table_export": events_table_export,
    "events_route": events_route,
    "events_deduped": events_deduped,
    "events_normalized": events_normalized,
    "events_quality": events_quality,
    "events_archive": events_archive,
    "events_notifications": events_notifications,
    "events_dead_letters": events_dead_letters,
    "events_envelopes": events_envelopes,
    "events_rules_matched": events_rules_matched,
    "orders_exported_in_epochs": orders_exported_in_epochs,
    "orders_export_increment": orders_export_increment,
}

_EV = """
WITH ev AS (
    SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
           CASE WHEN event_type = 'signup' THEN NULL
                ELSE ['sales_db', 'ops_db', 'ref_db'][((user_id % 3) + 3) % 3 + 1] END AS db,
           CASE WHEN event_type = 'signup' THEN NULL ELSE event_type END AS tbl
    FROM events
),
nv AS (
    SELECT *, CAST(event_id AS VARCHAR) AS sid,
           COALESCE(NULLIF(NULLIF(NULLIF(db, ''), 'None'), 'Unknown'), 'app_db') AS database,
           COALESCE(NULLIF(NULLIF(NULLIF(tbl, ''), 'None'), 'Unknown'), 'events') AS "table",
           COALESCE(k, 3) AS record_count
    FROM ev
),
routed AS (
    SELECT * FROM nv WHERE event_type IN ('purchase', 'signup', 'click') AND db = 'sales_db'
)
"""

ORACLES = {
    "export_customers_like": "SELECT * FROM customer WHERE c_name LIKE 'Customer#0000_0%'",
    "events_stream_notifications": None,  # filled below: same rows as the batch twin
    "events_table_export": """
    SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('purchase', 'click')""",
    "events_route": _EV
    + """
    SELECT sid AS event_id, event_type AS detail_type, db AS database, 'direct' AS rule FROM routed
    UNION ALL
    SELECT sid, event_type, db, 'purchases' FROM nv WHERE event_type = 'purchase'""",
    "events_deduped": _EV
    + "SELECT sid AS event_id, event_type AS detail_type, db AS database, ts AS event_time FROM routed",
    "events_normalized": _EV
    + """
    SELECT sid AS event_id, event_type AS detail_type, 'app.events' AS source, ts AS event_time,
           database, "table", record_count FROM nv""",
    "events_quality": _EV
    + """
    SELECT sid AS event_id,
           (record_count > 0) AND db IS NOT NULL AND ts < TIMESTAMP '2024-02-01 00:00:00' AS accepted,
           concat_ws(',', CASE WHEN NOT COALESCE(record_count > 0, false) THEN 'has_records' END,
                          CASE WHEN db IS NULL THEN 'named_database' END,
                          CASE WHEN NOT COALESCE(ts < TIMESTAMP '2024-02-01 00:00:00', false) THEN 'in_january' END) AS failed_rules
    FROM nv""",
    "events_archive": _EV
    + """
    SELECT sid AS event_id, database, "table", record_count, 'completed' AS archive_status,
           TIMESTAMP '2024-02-01 12:00:00' AS archived_at
    FROM nv WHERE record_count > 0""",
    "events_notifications": _EV
    + """
    , x AS (SELECT *, '/exports/exported-data/' || database || '/' || "table" || '/export_'
                      || strftime(max(ts) OVER (PARTITION BY database, "table"), '%Y%m%d_%H%M%S') || '.csv' AS export_location FROM routed)
    SELECT sid AS event_id, export_location, 'Data Export Completed' AS subject,
           'Data Export Completed!

Database: ' || database || '
Table: ' || "table" || '
Records: ' || record_count || '
Location: ' || export_location || '
Time: 2024-02-01T12:00:00.000000' AS message
    FROM x""",
    "events_dead_letters": _EV
    + """
    SELECT 'missing: id,detail-type,source,time' AS reason, count(*) AS n FROM events WHERE event_type = 'error'
    UNION ALL
    SELECT 'unparseable', count(*) FROM ev WHERE event_type = 'view' AND k < 10""",
    "events_rules_matched": _EV
    + """
    , own AS (SELECT user_id, min(event_id) AS low, max(event_id) AS high FROM events GROUP BY user_id)
    SELECT sid AS event_id, 'user-' || o.user_id AS rule FROM nv JOIN own o ON event_id IN (o.low, o.high) WHERE event_type IN ('purchase', 'click')
    UNION ALL
    SELECT sid, 'type-' || event_type FROM nv WHERE db = 'ops_db'""",
    "orders_exported_in_epochs": """
    WITH runs(epoch, until, low, high) AS (VALUES (0, '1994-01-01', '0001-01-01', '1994-01-01'), (1, '1996-01-01', '1994-01-01', '1996-01-01'),
        (1, '1997-01-01', '1994-01-01', '1996-01-01'), (2, '1997-01-01', '1996-01-01', '1997-01-01'))
    SELECT epoch, until, o_orderkey FROM orders JOIN runs ON o_orderdate >= CAST(low AS TIMESTAMP) AND o_orderdate < CAST(high AS TIMESTAMP)""",
    "events_envelopes": """
    WITH e AS (SELECT *, event_id % 8 AS form, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT CAST(event_id AS VARCHAR) AS event_id,
           CASE form WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('millisecond', ts) ELSE ts END AS event_time,
           'sales_db' AS database, CASE form WHEN 5 THEN k + 5000000000 ELSE k END AS record_count,
           'table/' || event_type AS resource, CASE form WHEN 6 THEN event_type END AS column_name, CASE form WHEN 6 THEN k + 1 END AS column_version,
           NULL AS reason
    FROM e WHERE form <> 7 AND NOT (form = 0 AND k % 10 = 0)
    UNION ALL
    SELECT CASE form WHEN 7 THEN CAST(event_id AS VARCHAR) END, NULL, NULL, NULL, NULL, NULL, NULL,
           CASE form WHEN 7 THEN 'invalid: time' ELSE 'unparseable' END
    FROM e WHERE form = 7 OR (form = 0 AND k % 10 = 0)""",
    "orders_export_increment": """
    SELECT * FROM orders o WHERE NOT EXISTS (
        SELECT 1 FROM orders e WHERE e.o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AND e.o_orderkey = o.o_orderkey)""",
}

ORACLES["events_stream_notifications"] = ORACLES["events_notifications"]
