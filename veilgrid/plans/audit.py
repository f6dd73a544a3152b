"""Audited update of ``orders``.

Fixed scenario values (ours): every order with status 'F' is updated —
priority flips to '1-URGENT' (or to '5-LOW' when it was '1-URGENT') and the
total price rises by 4 — by ``etl_user`` with process step setting '2-ARC'.
The meta columns were added at ``LOAD_TS``; the update runs at ``UPDATE_TS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilgrid.functions.scalars import flip
from veilgrid.operators.audit import (
    add_meta_columns,
    append_audit,
    assert_unique_keys,
    audit_json,
    audit_rows,
    audit_update,
    latest,
    update,
)
from veilgrid.sources.tables import read_table
from veilgrid.session import scratch_root
from veilgrid.streaming.audit import AuditStream

LOAD_TS = "2024-01-31 00:00:00"
UPDATE_TS = "2024-02-01 12:00:00"
USER = "etl_user"
STEP_SETTING = "2-ARC"
KEYS = ["o_orderkey"]
RUN_SETTINGS = ("2-ARC", "4-LOAD")


def _cond():
    return F.col("o_orderstatus") == "F"


def _assignments():
    return {
        "o_orderpriority": flip("o_orderpriority", "1-URGENT", "5-LOW"),
        "o_totalprice": F.col("o_totalprice") + F.lit(4.0),
    }


def orders_with_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_meta_columns(read_table(spark, sf_dir, "orders"), LOAD_TS, USER)


def _update(spark: SparkSession, sf_dir: str, setting: str = STEP_SETTING, snapshots: bool = True) -> DataFrame:
    old = orders_with_meta(spark, sf_dir)
    return audit_update(
        old, _cond(), _assignments(), table="orders", now=UPDATE_TS, user=USER, setting=setting, keys=KEYS, snapshots=snapshots
    )


def audit_orders_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPDATE + audit in one narrow pass: no join, no shuffle."""
    assert_unique_keys(read_table(spark, sf_dir, "orders").filter(_cond()).select(*KEYS), KEYS, "orders")
    return _update(spark, sf_dir).withColumn("changed_keys", F.array_join("changed_keys", ","))


def audit_orders_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same audit from two snapshots joined on the key (the general two-table case)."""
    old = orders_with_meta(spark, sf_dir)
    new = update(old, _cond(), _assignments(), now=UPDATE_TS, user=USER)
    a = audit_rows(old, new, KEYS, table="orders", now=UPDATE_TS, user=USER, setting=STEP_SETTING)
    return a.withColumn("changed_keys", F.array_join("changed_keys", ","))


def audit_orders_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 audit rows of the last keys, newest first: a top-k, without snapshots."""
    rows = _update(spark, sf_dir, snapshots=False).orderBy(F.desc("o_orderkey"), F.desc("var_name")).limit(20)
    return rows.select(
        "response_table", "o_orderkey", "var_name", "original_value", "modified_value", F.array_join("changed_keys", ",").alias("changed_keys")
    )


def audit_log_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs appended to one audit log; per run, its rows, its ids, and whether they follow the run before."""
    path = f"{scratch_root(spark, 'audit-log')}/audit_log"
    for setting in RUN_SETTINGS:
        append_audit(_update(spark, sf_dir, setting), path)
    runs = spark.read.parquet(path).groupBy("process_step").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("audit_log_id").alias("n_ids"),
        F.min("audit_log_id").alias("low"), F.max("audit_log_id").alias("high"),
    )
    # One row per run.
    before = F.coalesce(F.lag("high").over(Window.orderBy("process_step")), F.lit(0))
    return runs.select("process_step", "n_rows", "n_ids", (F.col("low") > before).alias("follows"))


ORDER = ["o_orderkey", "var_name"]


def _ordered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark, 'audit-ordered')}/audit_log"
    for setting in RUN_SETTINGS:
        append_audit(_update(spark, sf_dir, setting, snapshots=False), path, order_cols=ORDER)
    return spark.read.parquet(path)


def audit_log_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs in one log, their ids 1, 2, ... in the order of key and column, the second run's after the first's."""
    return _ordered_log(spark, sf_dir).select("audit_log_id", "process_step", *ORDER, "original_value", "modified_value")


def audit_log_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: the 20 newest rows of that log, by id."""
    return latest(_ordered_log(spark, sf_dir), 20).select("audit_log_id", "process_step", *ORDER)


def audit_event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, C4, C5, F22, F23 on JSON: events whose properties change, with keys that come, go, are null or hold objects."""
    ev = read_table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    third = F.col("event_id") % 3
    cells = lambda *xs: F.to_json(F.map_from_entries(F.array_compact(F.array(*xs))), {"ignoreNullFields": "false"})
    cell = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
    old = cells(cell("k", F.col("k")), cell("kind", F.col("event_type")), F.when(third == 0, cell("gone", F.col("k"))), F.when(third == 1, cell("note", F.lit(None))))
    new = cells(
        cell("k", F.col("k") + F.when(F.col("event_type") == "click", 1).otherwise(0)),
        F.when(third != 2, cell("kind", F.when(F.col("k") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")))),
        F.when(third == 2, cell("come", F.col("k"))),
        F.when(third == 1, cell("note", F.when(F.col("k") % 5 == 0, F.lit("set")))),
    )
    rows = audit_json(ev.select("event_id", old.alias("o"), new.alias("n")), "o", "n", table="events", keys=["event_id"], now=UPDATE_TS, user=USER)
    return rows.select("event_id", "var_name", "original_value", "modified_value", F.array_join("changed_keys", ",").alias("changed_keys"), "process_step", "created_dt")


def audit_orders_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1–C9 as a stream: the orders arrive, then their updated rows; the audit rows of the second micro-batch."""
    root = scratch_root(spark, "audit-stream")
    old = orders_with_meta(spark, sf_dir)
    new = update(old.filter(_cond()), _cond(), _assignments(), now=UPDATE_TS, user=USER)
    first = old.withColumn("seq", F.lit(0).cast("long"))
    stream = AuditStream(
        spark, f"{root}/in", f"{root}/out", f"{root}/ckpt", schema=first.schema, keys=KEYS, seq="seq", table="orders", now=UPDATE_TS, user=USER, setting=STEP_SETTING
    )
    for rows in (first, new.withColumn("seq", F.lit(1).cast("long"))):
        rows.write.mode("append").parquet(f"{root}/in")
        stream.start().awaitTermination()
    return spark.read.parquet(f"{root}/out/audit").select(
        "response_table", "process_step", "o_orderkey", "var_name", "original_value", "modified_value", F.array_join("changed_keys", ",").alias("changed_keys")
    )


QUERIES = {
    "audit_orders_streamed": audit_orders_streamed,
    "audit_log_ordered": audit_log_ordered,
    "audit_log_newest": audit_log_newest,
    "audit_event_props": audit_event_props,
    "audit_orders_update": audit_orders_update,
    "audit_orders_snapshots": audit_orders_snapshots,
    "audit_orders_latest": audit_orders_latest,
    "audit_log_appended": audit_log_appended,
}

_AUDIT_SQL = """
WITH o AS (
    SELECT *, TIMESTAMP '2024-01-31 00:00:00' AS created_dt, 'etl_user' AS created_by,
           TIMESTAMP '2024-01-31 00:00:00' AS modified_dt, 'etl_user' AS modified_by
    FROM orders WHERE o_orderstatus = 'F'
),
n AS (
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 4 AS o_totalprice, o_orderdate,
           CASE o_orderpriority WHEN '1-URGENT' THEN '5-LOW' ELSE '1-URGENT' END AS o_orderpriority,
           created_dt, created_by, TIMESTAMP '2024-02-01 12:00:00' AS modified_dt, 'etl_user' AS modified_by
    FROM o
),
pairs AS (
    SELECT o.*, n.o_totalprice AS n_totalprice, n.o_orderpriority AS n_orderpriority,
           n.modified_dt AS n_modified_dt, n.modified_by AS n_modified_by
    FROM o JOIN n USING (o_orderkey)
),
cells AS (
    SELECT o_orderkey, 'o_orderpriority' AS var_name, o_orderpriority AS original_value,
           n_orderpriority AS modified_value, o_orderpriority IS DISTINCT FROM n_orderpriority AS changed FROM pairs
    UNION ALL
    SELECT o_orderkey, 'o_totalprice', CAST(o_totalprice AS VARCHAR), CAST(n_totalprice AS VARCHAR),
           o_totalprice IS DISTINCT FROM n_totalprice FROM pairs
    UNION ALL
    SELECT o_orderkey, 'modified_dt', CAST(modified_dt AS VARCHAR), CAST(n_modified_dt AS VARCHAR),
           modified_dt IS DISTINCT FROM n_modified_dt FROM pairs
    UNION ALL
    SELECT o_orderkey, 'modified_by', modified_by, n_modified_by, modified_by IS DISTINCT FROM n_modified_by FROM pairs
),
changed AS (SELECT * FROM cells WHERE changed),
keys AS (
    SELECT o_orderkey, string_agg(var_name, ',' ORDER BY var_name) AS changed_keys FROM changed GROUP BY o_orderkey
),
snap AS (
    SELECT o_orderkey,
      '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey
      || ',"o_orderstatus":' || to_json(o_orderstatus) || ',"o_totalprice":' || CAST(o_totalprice AS VARCHAR)
      || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || '"'
      || ',"o_orderpriority":' || to_json(o_orderpriority)
      || ',"created_dt":"2024-01-31T00:00:00.000","created_by":"etl_user"'
      || ',"modified_dt":"2024-01-31T00:00:00.000","modified_by":"etl_user"}' AS old_row,
      '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey
      || ',"o_orderstatus":' || to_json(o_orderstatus) || ',"o_totalprice":' || CAST(n_totalprice AS VARCHAR)
      || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || '"'
      || ',"o_orderpriority":' || to_json(n_orderpriority)
      || ',"created_dt":"2024-01-31T00:00:00.000","created_by":"etl_user"'
      || ',"modified_dt":"2024-02-01T12:00:00.000","modified_by":"etl_user"}' AS new_row
    FROM pairs
),
audit AS (
    SELECT 'orders' AS response_table, 'UPDATE' AS action_code, '2-ARC' AS process_step,
           CAST(NULL AS VARCHAR) AS cmid, CAST(NULL AS VARCHAR) AS pnum, c.o_orderkey,
           c.var_name, c.original_value, c.modified_value, k.changed_keys, s.old_row, s.new_row,
           TIMESTAMP '2024-02-01 12:00:00' AS created_dt, 'etl_user' AS created_by,
           'orders' AS table_name, CAST(NULL AS VARCHAR) AS note
    FROM changed c JOIN keys k USING (o_orderkey) JOIN snap s USING (o_orderkey)
)
"""

ORACLES = {
    "audit_orders_update": _AUDIT_SQL + "SELECT * FROM audit",
    "audit_orders_snapshots": _AUDIT_SQL + "SELECT * FROM audit",
    "audit_orders_latest": _AUDIT_SQL
    + """SELECT response_table, o_orderkey, var_name, original_value, modified_value, changed_keys
         FROM audit ORDER BY o_orderkey DESC, var_name DESC LIMIT 20""",
    "audit_log_appended": _AUDIT_SQL
    + """SELECT step AS process_step, count(*) AS n_rows, count(*) AS n_ids, true AS follows
         FROM audit, (VALUES ('2-ARC'), ('4-LOAD')) AS runs(step) GROUP BY step""",
    "audit_log_ordered": _AUDIT_SQL
    + """SELECT row_number() OVER (ORDER BY step, o_orderkey, var_name) AS audit_log_id, step AS process_step, o_orderkey, var_name, original_value, modified_value
         FROM audit, (VALUES ('2-ARC'), ('4-LOAD')) AS runs(step)""",
    "audit_log_newest": _AUDIT_SQL
    + """SELECT row_number() OVER (ORDER BY step, o_orderkey, var_name) AS audit_log_id, step AS process_step, o_orderkey, var_name
         FROM audit, (VALUES ('2-ARC'), ('4-LOAD')) AS runs(step) ORDER BY audit_log_id DESC LIMIT 20""",
    "audit_orders_streamed": _AUDIT_SQL + "SELECT response_table, process_step, o_orderkey, var_name, original_value, modified_value, changed_keys FROM audit",
    "audit_event_props": """
    WITH e AS (SELECT event_id, event_type, event_id % 3 AS third, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
    cells AS (
        SELECT event_id, 'k' AS var_name, CAST(k AS VARCHAR) AS original_value, CAST(k + CASE event_type WHEN 'click' THEN 1 ELSE 0 END AS VARCHAR) AS modified_value FROM e
        UNION ALL SELECT event_id, 'kind', event_type, CASE WHEN k % 2 = 0 THEN upper(event_type) ELSE event_type END FROM e WHERE third <> 2
        UNION ALL SELECT event_id, 'note', NULL, CASE WHEN k % 5 = 0 THEN 'set' END FROM e WHERE third = 1
    ),
    changed AS (SELECT * FROM cells WHERE original_value IS DISTINCT FROM modified_value)
    SELECT *, string_agg(var_name, ',') OVER (PARTITION BY event_id ORDER BY var_name ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS changed_keys,
           '3-Normalize' AS process_step, TIMESTAMP '2024-02-01 12:00:00' AS created_dt
    FROM changed""",
}
