"""Scalar helpers, look-ups and small sinks over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.functions import scalars as S
from veilgrid.operators.audit import length_violations, ts_literal
from veilgrid.operators.events import valid_events, wrap_event
from veilgrid.operators.lookup import latest_per_group
from veilgrid.operators.policy import bypass_findings, flatten_policies, reachable_roles
from veilgrid.operators.report import as_check_result, identity_section
from veilgrid.plans.events import RUN_TS, typed
from veilgrid.plans.report import call_log, outcomes
from veilgrid.sources.events import read_events
from veilgrid.sources.permissions import load_permissions
from veilgrid.sources.sinks import dataset_view, write_result
from veilgrid.sources.tables import read_table
from veilgrid.session import scratch_root
from veilgrid.streaming.bus import publish_batches, read_batches, write_and_publish, write_batch

LIMITS = {"o_orderpriority": 5, "o_orderstatus": 1}
KEYWORDS = ("authorized", "RATE")


def scalars_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, time, map and row helpers on every order."""
    o = read_table(spark, sf_dir, "orders").withColumn("m", F.create_map(F.lit("F"), F.lit("final"), F.lit("O"), F.lit("open")))
    old, new = [F.col("o_orderstatus"), F.nullif(F.col("o_custkey"), F.lit(85))], [F.lit("F"), F.col("o_custkey")]
    return o.select(
        "o_orderkey",
        S.padded_increment(F.col("o_custkey").cast("string"), 4).alias("padded"),
        S.truncate("o_orderpriority", 4).alias("short"),
        S.minutes_before("o_orderdate", 90).alias("before"),
        S.map_get_default("m", F.col("o_orderstatus"), "other").alias("named"),
        S.row_json(["o_orderkey", "o_orderstatus"]).alias("as_json"),
        S.rows_distinct(old, new).alias("differs"),
        S.last_path_part(F.concat_ws("/", F.lit("a"), "o_orderstatus", "o_custkey")).alias("last_part"),
    )


def report_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1's identity table, F5: one ARN per customer, of one of four kinds."""
    c = read_table(spark, sf_dir, "customer")
    kinds = F.array(F.lit(":user/"), F.lit(":role/"), F.lit(":assumed-role/"), F.lit(":root"))
    kind = F.element_at(kinds, (F.col("c_custkey") % 4 + 1).cast("int"))
    arn = F.concat(F.lit("arn:iam::1"), kind, F.col("c_name"), F.when(F.col("c_custkey") % 4 == 2, F.lit("/session")).otherwise(F.lit("")))
    return identity_section(c.select(F.col("c_custkey").cast("string").alias("account"), arn.alias("arn"), F.col("c_name").alias("user_id")))


def report_check_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested check results, and whether their message holds one of two words in any case."""
    r = as_check_result(outcomes(spark, sf_dir)).select("result.*")
    return r.groupBy("service", "status", "error_code", S.contains_any("message", KEYWORDS).alias("worded")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("data.count").alias("items"), F.count("data.sample").alias("samples")
    )


def events_latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's newest event and number of events."""
    out = latest_per_group(read_table(spark, sf_dir, "events"), ["user_id"], "ts", ["event_id", "event_type"], tiebreak="event_id")
    return out.select("user_id", "latest.event_id", "latest.event_type", "n")


def events_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every valid event, whole, with its validation mark."""
    w = wrap_event(valid_events(typed(spark, sf_dir)), ts_literal(RUN_TS))
    e = F.col("original_event")
    return w.select(e["id"].alias("event_id"), e["detail"]["recordCount"].alias("record_count"), "event_validated", "validated_at")


def orders_over_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders with a text over its limit, and which."""
    return length_violations(read_table(spark, sf_dir, "orders"), LIMITS).select("o_orderkey", F.array_join("violations", ",").alias("violations"))


def orders_written_and_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders appended to a table, the change event that tells of it, and its rows as a query result."""
    root = scratch_root(spark, "write-publish")
    rows = read_table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    done = write_and_publish(rows, f"{root}/t", f"{root}/bus", database="sales_db", table="orders", event_id="w1", now=RUN_TS)
    place = write_result(spark.read.parquet(f"{root}/t"), f"{root}/results", "q1", caller_path=f"{root}/mine")
    told = read_events(spark, f"{root}/bus").first().event.detail.recordCount  # the one event
    kept = spark.read.parquet(place).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("o_orderkey").alias("key_sum"))
    return kept.withColumns({"told": F.lit(told).cast("long"), "published": F.lit(done["published"])})


def orders_batches_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 as an outbox: orders written in a batch per status, each step called again as after a failure; per batch its rows and what its events say."""
    root = scratch_root(spark, "outbox")
    orders = read_table(spark, sf_dir, "orders")
    for status in ("F", "O", "F", "P"):
        write_batch(orders.filter(F.col("o_orderstatus") == status), f"{root}/t", f"w-{status}")
        publish_batches(spark, f"{root}/t", f"{root}/bus", database="sales_db", table="orders", now=RUN_TS)
    rows = read_batches(spark, f"{root}/t").groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("o_orderkey").alias("key_sum"))
    told = valid_events(read_events(spark, f"{root}/bus")).groupBy(F.col("event.id").alias("batch_id")).agg(F.count(F.lit(1)).alias("n_events"), F.sum("event.detail.recordCount").alias("told"))
    return rows.join(told, "batch_id", "full_outer")


def bi_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a typed view for a BI tool."""
    return dataset_view(read_table(spark, sf_dir, "events"), {"event_id": "STRING", "event_type": "STRING", "user_id": "INTEGER", "value": "DECIMAL"})


def policy_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every customer through its nation to its region, as roles that assume roles."""
    c, n, r = (read_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    up = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_name").alias("src"), F.col("n_name").alias("dst"))
    top = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    return reachable_roles(up.unionByName(top), 2)


def policy_reachable_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G12 to the end: customers assume their nation's role, nations another nation's in rings of five, and some their region's."""
    c, n, r = (read_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    up = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_name").alias("src"), F.col("n_name").alias("dst"))
    after = n.select(((F.col("n_nationkey") + 20) % 25).alias("n_nationkey"), F.col("n_name").alias("dst"))
    ring = n.join(after, "n_nationkey").select(F.col("n_name").alias("src"), "dst")
    top = n.filter("n_nationkey % 4 = 0").join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    return reachable_roles(up.unionByName(ring).unionByName(top), max_hops=None)


def _policies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(policies, visible, locations): customers as roles with policies of six kinds over their nation's bucket, and what they see of its orders."""
    c, n = (read_table(spark, sf_dir, t) for t in ("customer", "nation"))
    role = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_name").alias("role"), "c_custkey", "n_name")
    own = F.concat(F.lit("bucket-"), F.col("n_name"))

    def statement(effect: str, actions: list[str], *resources) -> Column:
        return F.struct(F.lit(effect).alias("effect"), F.array(*[F.lit(a) for a in actions]).alias("actions"), F.array(*resources).alias("resources"))

    under = lambda tail: F.concat(own, F.lit(tail))
    kinds = [
        F.array(statement("Allow", ["s3:GetObject"], under("/*"))),
        F.array(statement("Allow", ["s3:Get*", "s3:List*"], under("/tab*/orders/*"))),
        F.array(statement("Allow", ["s3:*"], under("/*")), statement("Deny", ["s3:*"], F.lit("*"))),
        F.array(statement("Allow", ["*"], F.lit("bucket-*")), statement("Deny", ["S3:getobject"], under("/tables/*"))),
        F.array(statement("Allow", ["s3:GetObject", "s3:PutObject"], under("/tables/orders/part-*")), statement("Deny", ["s3:PutObject"], F.lit("*")), statement("Deny", ["s3:Get*"], under("/tables/orders/part-0*"))),
        F.array(statement("Allow", ["s3:PutObject"], F.lit("*")), statement("Allow", ["s3:Get*"], F.lit("bucket-other/*"))),
    ]
    policies = role.select("role", F.element_at(F.array(*kinds), (F.col("c_custkey") % 6 + 1).cast("int")).alias("statements"))
    table = F.concat(F.lit("orders_"), F.col("n_name")).alias("table")
    visible = role.select("role", F.lit("sales_db").alias("database"), table, (F.col("c_custkey") % 5 == 0).alias("full_table"))
    bucket = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.lit("SHARED"))
    places = n.select(F.lit("sales_db").alias("database"), table, F.concat(F.lit("bucket-"), bucket, F.lit("/tables/orders")).alias("location"))
    return policies, visible, places


def policy_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as roles whose policies let them read, past the view, the files of orders that they see in part."""
    policies, visible, places = _policies(spark, sf_dir)
    return bypass_findings(flatten_policies(policies), visible, places)


def permissions_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call log's permissions written as a configuration file and loaded for three services, one of them not listed."""
    path = f"{scratch_root(spark, 'permissions')}/permissions.json"
    pairs = call_log(spark, sf_dir).select("service", "permission").distinct()
    # A configuration file is one small text: services and actions, not calls.
    lists = pairs.groupBy("service").agg(F.sort_array(F.collect_set("permission")).alias("actions"))
    whole = lists.agg(F.map_from_entries(F.collect_list(F.struct("service", "actions"))).alias("permissions"))
    whole.select(F.to_json(F.struct("permissions")).alias("value")).coalesce(1).write.text(path)
    chosen, missing = load_permissions(spark, path, ["click", "view", "absent"])
    return chosen.select("service", "permission").unionByName(missing.select("service", F.lit(None).cast("string").alias("permission")))


QUERIES = {
    "policy_reachable": policy_reachable,
    "policy_reachable_all": policy_reachable_all,
    "policy_bypass": policy_bypass,
    "permissions_loaded": permissions_loaded,
    "scalars_orders": scalars_orders,
    "report_identities": report_identities,
    "report_check_results": report_check_results,
    "events_latest_per_user": events_latest_per_user,
    "events_wrapped": events_wrapped,
    "orders_over_length": orders_over_length,
    "orders_written_and_published": orders_written_and_published,
    "orders_batches_published": orders_batches_published,
    "bi_events": bi_events,
}


def oracles(calls: str) -> dict[str, str]:
    """``calls``: the CTEs that end in ``outc``, the classified call log."""
    return {
        "policy_reachable": """
            WITH e AS (SELECT c_name AS src, n_name AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey
                UNION SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
            SELECT src, dst, 1 AS hops FROM e
            UNION ALL SELECT DISTINCT a.src, b.dst, 2 FROM e a JOIN e b ON a.dst = b.src""",
        "policy_reachable_all": """
            WITH RECURSIVE e AS (SELECT c_name AS src, n_name AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey
                UNION SELECT a.n_name, b.n_name FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 5) % 25
                UNION SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 = 0),
            walk AS (SELECT src, dst, 1 AS hops FROM e UNION SELECT w.src, e.dst, w.hops + 1 FROM walk w JOIN e ON w.dst = e.src WHERE w.hops < 12)
            SELECT src, dst, min(hops) AS hops FROM walk WHERE src <> dst GROUP BY ALL""",
        # The rule: an Allow whose action and resource meet the read of some object below the location, and no Deny that holds
        # the action and all those objects. Wildcards stand in both.
        "policy_bypass": r"""
            WITH role AS (SELECT c_name AS role, c_custkey, n_name, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
            kinds(kind, effect, action, resource) AS (VALUES (0, 'Allow', 's3:GetObject', '@/*'), (1, 'Allow', 's3:Get*', '@/tab*/orders/*'),
                (1, 'Allow', 's3:List*', '@/tab*/orders/*'), (2, 'Allow', 's3:*', '@/*'), (2, 'Deny', 's3:*', '*'), (3, 'Allow', '*', 'bucket-*'),
                (3, 'Deny', 'S3:getobject', '@/tables/*'), (4, 'Allow', 's3:GetObject', '@/tables/orders/part-*'),
                (4, 'Allow', 's3:PutObject', '@/tables/orders/part-*'), (4, 'Deny', 's3:PutObject', '*'), (4, 'Deny', 's3:Get*', '@/tables/orders/part-0*'),
                (5, 'Allow', 's3:PutObject', '*'), (5, 'Allow', 's3:Get*', 'bucket-other/*')),
            st AS (SELECT role, effect, lower(action) AS action, replace(resource, '@', 'bucket-' || n_name) AS resource
                FROM role JOIN kinds ON kind = c_custkey % 6),
            seen AS (SELECT role, 'orders_' || n_name AS "table", 'bucket-' || CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'SHARED' END || '/tables/orders' AS location
                FROM role WHERE c_custkey % 5 <> 0),
            met AS (SELECT s.*, a.resource, regexp_extract(a.resource, '^[^*]*') AS head FROM seen s JOIN st a USING (role)
                WHERE effect = 'Allow' AND 's3:getobject' GLOB action),
            reach AS (SELECT *, CASE WHEN starts_with(head, location || '/') THEN resource ELSE location || '/' || substr(resource, length(head) + 1) END AS reach
                FROM met WHERE starts_with(head, location || '/') OR (starts_with(location || '/', head) AND contains(resource, '*')))
            SELECT DISTINCT role, 'sales_db' AS database, "table", location, resource FROM reach r
            WHERE NOT EXISTS (SELECT 1 FROM st d WHERE d.role = r.role AND effect = 'Deny' AND 's3:getobject' GLOB d.action AND r.reach GLOB d.resource)""",
        "permissions_loaded": calls
        + """
            SELECT DISTINCT service, permission FROM calls WHERE service IN ('click', 'view')
            UNION ALL SELECT 'absent', NULL""",
        "scalars_orders": """
            SELECT o_orderkey, lpad(CAST(o_custkey + 4 AS VARCHAR), 6, '0') AS padded, substr(o_orderpriority, 1, 4) AS short,
                   o_orderdate - INTERVAL 90 MINUTE AS before,
                   CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS named,
                   '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS as_json,
                   o_orderstatus IS DISTINCT FROM 'F' OR nullif(o_custkey, 85) IS DISTINCT FROM o_custkey AS differs,
                   CAST(o_custkey AS VARCHAR) AS last_part
            FROM orders""",
        "report_identities": """
            WITH c AS (SELECT *, c_custkey % 4 AS k, [':user/', ':role/', ':assumed-role/', ':root'][c_custkey % 4 + 1] AS mark FROM customer)
            SELECT CAST(c_custkey AS VARCHAR) AS account, ['IAM User', 'IAM Role', 'Assumed Role', 'Unknown'][k + 1] AS identity_type,
                   CASE WHEN k = 3 THEN 'arn:iam::1:root' || c_name ELSE c_name END AS identity_name,
                   'arn:iam::1' || mark || c_name || CASE WHEN k = 2 THEN '/session' ELSE '' END AS arn, c_name AS user_id
            FROM c""",
        "report_check_results": calls
        + """
            SELECT service, status, error_code, lower(message) LIKE '%authorized%' OR lower(message) LIKE '%rate%' AS worded,
                   count(*) AS n, CAST(sum(data_count) AS BIGINT) AS items, CAST(0 AS BIGINT) AS samples
            FROM outc GROUP BY ALL""",
        "events_latest_per_user": """
            SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type, count(*) AS n
            FROM events GROUP BY user_id""",
        "events_wrapped": """
            SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS record_count,
                   true AS event_validated, TIMESTAMP '2024-02-01 12:00:00' AS validated_at
            FROM events""",
        "orders_over_length": """
            SELECT o_orderkey, 'o_orderpriority' AS violations FROM orders WHERE length(o_orderpriority) > 5""",
        "orders_written_and_published": """
            SELECT count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum, count(*) AS told, true AS published
            FROM orders WHERE o_orderstatus = 'F'""",
        "orders_batches_published": """
            SELECT 'w-' || o_orderstatus AS batch_id, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum,
                   CAST(1 AS BIGINT) AS n_events, count(*) AS told FROM orders GROUP BY o_orderstatus""",
        "bi_events": """
            SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(user_id AS INTEGER) AS user_id, value FROM events""",
    }
