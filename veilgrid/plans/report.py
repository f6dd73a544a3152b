"""Permission-outcome report on a call log derived from ``events``.

Mapping (ours): one event = one permission check. ``service`` = event_type;
the permission name is made up from ``props.k`` (verb = k mod 7, noun =
(k div 7) mod 5; k divisible by 11 is GetCallerIdentity); the outcome code
comes from ``value`` ranges; the response holds made-up lists whose lengths
come from ``k`` (so A8 is shown on made-up lists only). The audit trail for denied checks
is the ``purchase`` events of the same user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.functions.joins import values_frame
from veilgrid.operators.lookup import audit_lookup, expand_patterns, lookup_default
from veilgrid.operators.report import (
    HEAD_MATRIX,
    HEAD_SUMMARY,
    classify_outcomes,
    detail_table,
    permission_inventory,
    report_text,
    run_verdict,
    sections,
    service_matrix,
    summary,
)
from veilgrid.sources.tables import read_table

# Fixed mapping values (ours).
VERBS = ("Describe", "List", "Get", "Lookup", "Search", "Put", "Delete")
NOUNS = ("Instances", "Buckets", "Functions", "Tables", "Keys")
# value < bound → (error code, error message); above the last bound the call succeeded.
OUTCOME_BANDS = (
    (2.5, "AccessDenied", "User is not authorized to perform this action"),
    (5.0, "NoSuchBucket", "The specified bucket does not exist"),
    (7.5, "ValidationException", "Invalid request"),
    (10.0, "ParamValidationError", 'Parameter validation failed: Missing required parameter in input: "Name"'),
    (11.0, "ThrottlingException", "Rate exceeded"),
)
CLIENT_OF_SERVICE = (("click", "clickstream"), ("purchase", "billing"))
CLIENT_OVERRIDE = (("purchase", "GetKeys", "kms"), ("view", "ListTables", "glue"))
PATTERNS = (
    ("click", "List*"),
    ("click", "Describe*"),
    ("view", "Get*"),
    ("view", "Describe_*"),
    ("purchase", "*Keys"),
    ("signup", "Search*"),
    ("error", "*"),
)


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A one-element explode: filters on what k leads to stay above it, so the JSON is read once a row.
    ev = read_table(spark, sf_dir, "events").withColumn("k", F.explode(F.array(F.get_json_object("props", "$.k").cast("int"))))
    k = F.col("k")
    verb = F.element_at(F.array(*[F.lit(v) for v in VERBS]), F.pmod(k, F.lit(len(VERBS))) + 1)
    noun = F.element_at(F.array(*[F.lit(n) for n in NOUNS]), F.pmod(F.floor(k / len(VERBS)), F.lit(len(NOUNS))).cast("int") + 1)
    code = F.lit(None).cast("string")
    msg = F.lit(None).cast("string")
    for bound, c, m in reversed(OUTCOME_BANDS):
        code = F.when(F.col("value") < bound, F.lit(c)).otherwise(code)
        msg = F.when(F.col("value") < bound, F.lit(m)).otherwise(msg)
    response = F.create_map(
        F.lit("Items"), F.array_repeat(F.col("event_type"), F.pmod(k, F.lit(5))),
        F.lit("Reservations"), F.array_repeat(F.format_string('{"Instances":[%s]}', F.array_join(F.array_repeat(F.lit('"i"'), F.pmod(k, F.lit(4))), ",")), F.pmod(k, F.lit(3))),
        F.lit("Account"), F.array(F.lit("000000000000")),
        F.lit("Arn"), F.array(F.concat(F.lit("arn:user/"), F.col("user_id").cast("string"))),
        F.lit("NextToken"), F.array_repeat(F.lit("t"), F.lit(7)),
    )
    return ev.select(
        "event_id",
        "ts",
        "user_id",
        F.col("event_type").alias("service"),
        F.when(F.pmod(k, F.lit(11)) == 0, F.lit("GetCallerIdentity")).otherwise(F.concat(verb, noun)).alias("permission"),
        code.alias("error_code"),
        msg.alias("error_message"),
        response.alias("response"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail_table(classify_outcomes(call_log(spark, sf_dir)))


def report_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = outcomes(spark, sf_dir)
    clients = values_frame(spark, CLIENT_OF_SERVICE, "service string, client string")
    overrides = values_frame(spark, CLIENT_OVERRIDE, "service string, permission string, client string")
    o = lookup_default(o, clients, ["service"], "client", "client", F.col("service"))
    o = lookup_default(o, overrides, ["service", "permission"], "client", "client", F.col("client"))
    return o.select(
        "event_id",
        "service",
        "permission",
        "method_name",
        "client",
        "status",
        "message",
        F.col("result_error_code").alias("error_code"),
        "details",
        "data_count",
        "short_status",
        "detail_text",
    )


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(outcomes(spark, sf_dir))


def report_service_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service_matrix(outcomes(spark, sf_dir)).select(
        "service",
        F.col("total").cast("long").alias("total"),
        *[F.col(c).cast("long").alias(c) for c in ("passed", "denied", "not_tested", "skipped", "error")],
        "verdict",
    )


def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(outcomes(spark, sf_dir))


def report_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_verdict(outcomes(spark, sf_dir)).select(F.col("denied").cast("long").alias("denied"), "exit_code")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes with a run_id; a run is a day of the call log (ours)."""
    return outcomes(spark, sf_dir).withColumn("run_id", F.date_format("ts", "yyyy-MM-dd"))


def report_run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run's own counts and percents."""
    return summary(_runs(spark, sf_dir), ["run_id"])


def report_run_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run's own verdict."""
    return run_verdict(_runs(spark, sf_dir), ["run_id"]).select("run_id", F.col("denied").cast("long").alias("denied"), "exit_code")


def report_run_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run's report as text."""
    runs = _runs(spark, sf_dir)
    return report_text(summary(runs, ["run_id"]), service_matrix(runs, ["run_id"]), ["run_id"]).select("run_id", F.col("value").alias("report"))


def _purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")


def report_denied_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Denied checks with the audit look-up (same user, last 60 min)."""
    denied = outcomes(spark, sf_dir).filter(F.col("status") == "DENIED").select(
        "event_id", "ts", "user_id", "service", "permission", F.col("result_error_code").alias("error_code")
    )
    look = audit_lookup(
        denied, _purchases(spark, sf_dir), key="user_id", probe_ts="ts", audit_ts="ts", audit_id="event_id"
    )
    return look.select(
        "event_id", "service", "permission", "error_code", "ct_count", "ct_latest_id", "ct_latest_time", "ct_message"
    )


def events_audit_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 'error' event × 'purchase' events of the same user in the 60 minutes up to it."""
    ev = read_table(spark, sf_dir, "events")
    errors = ev.filter(F.col("event_type") == "error").select("event_id", "ts", "user_id", "value")
    look = audit_lookup(
        errors,
        _purchases(spark, sf_dir),
        key="user_id",
        probe_ts="ts",
        audit_ts="ts",
        audit_id="event_id",
        payload=["value"],
    )
    return look.select(
        "event_id", "user_id", "ct_count", "ct_latest_id", "ct_latest_time", "ct_latest_value", "ct_message"
    )


def report_pattern_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wildcard action patterns per service × the checks they cover."""
    pats = values_frame(spark, PATTERNS, "service string, pattern string")
    actions = call_log(spark, sf_dir).groupBy("service", "permission").agg(F.count(F.lit(1)).alias("n"))
    return expand_patterns(actions, pats).groupBy("service", "pattern").agg(
        F.sum("n").alias("n_checks"), F.count(F.lit(1)).alias("n_permissions")
    )


def report_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D12 + A7: each service's permissions in order, with the length of its list."""
    return permission_inventory(call_log(spark, sf_dir)).select("service", "permission", "position", "n_permissions")


QUERIES = {
    "report_outcomes": report_outcomes,
    "report_summary": report_summary,
    "report_service_matrix": report_service_matrix,
    "report_sections": report_sections,
    "report_verdict": report_verdict,
    "report_run_summaries": report_run_summaries,
    "report_run_verdicts": report_run_verdicts,
    "report_run_texts": report_run_texts,
    "report_denied_audit": report_denied_audit,
    "events_audit_lookup": events_audit_lookup,
    "report_pattern_matches": report_pattern_matches,
    "report_inventory": report_inventory,
}

CALLS = """
WITH ev AS (
    SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
),
calls AS (
    SELECT event_id, ts, user_id, event_type AS service,
           CASE WHEN k % 11 = 0 THEN 'GetCallerIdentity' ELSE
           ['Describe','List','Get','Lookup','Search','Put','Delete'][((k % 7) + 7) % 7 + 1]
           || ['Instances','Buckets','Functions','Tables','Keys'][(((floor(k / 7))::INTEGER % 5) + 5) % 5 + 1] END AS permission,
           CASE WHEN value < 2.5 THEN 'AccessDenied' WHEN value < 5.0 THEN 'NoSuchBucket'
                WHEN value < 7.5 THEN 'ValidationException' WHEN value < 10.0 THEN 'ParamValidationError'
                WHEN value < 11.0 THEN 'ThrottlingException' END AS code,
           CASE WHEN value < 2.5 THEN 'User is not authorized to perform this action'
                WHEN value < 5.0 THEN 'The specified bucket does not exist'
                WHEN value < 7.5 THEN 'Invalid request'
                WHEN value < 10.0 THEN 'Parameter validation failed: Missing required parameter in input: "Name"'
                WHEN value < 11.0 THEN 'Rate exceeded' END AS msg,
           ((k % 5) + 5) % 5 AS n_items, ((k % 3) + 3) % 3 AS n_res, ((k % 3) + 3) % 3 * (((k % 4) + 4) % 4) AS n_inst
    FROM ev
),
o AS (
    SELECT *,
      regexp_matches(permission, '^(Describe|List|Get|Lookup|Search)') AS ro,
      CASE WHEN NOT regexp_matches(permission, '^(Describe|List|Get|Lookup|Search)') THEN 'SKIPPED'
           WHEN code IS NULL THEN 'PASSED'
           WHEN code = 'AccessDenied' THEN 'DENIED'
           WHEN code IN ('NoSuchBucket', 'ValidationException') THEN 'PASSED'
           WHEN msg LIKE '%Parameter validation failed%' OR msg LIKE '%Missing required parameter%' THEN 'NOT_TESTED'
           ELSE 'ERROR' END AS status
    FROM calls
),
outc AS (
    SELECT *,
      CASE WHEN status = 'SKIPPED' THEN 'Not a read-only permission (safety check)'
           WHEN code IS NULL THEN 'Permission validated successfully'
           WHEN code = 'AccessDenied' THEN msg
           WHEN code = 'NoSuchBucket' THEN 'Permission validated (resource not found)'
           WHEN code = 'ValidationException' THEN 'Permission exists (' || code || ')'
           WHEN code = 'ParamValidationError' THEN 'Requires parameters: ' || msg
           ELSE code || ': ' || msg END AS message,
      CASE WHEN status IN ('DENIED', 'ERROR') THEN code END AS error_code,
      CASE WHEN status = 'SKIPPED' THEN ''
           WHEN code IS NULL THEN CASE WHEN permission = 'GetCallerIdentity' THEN 'Account: 000000000000, ARN: arn:user/' || user_id
                WHEN permission = 'DescribeInstances' THEN n_inst || ' instances'
                WHEN n_items >= greatest(n_res, 1) THEN n_items || ' items'
                WHEN n_res >= 1 THEN n_res || ' reservations' ELSE '1 account' END
           WHEN code = 'AccessDenied' THEN ''
           WHEN code = 'NoSuchBucket' THEN 'API authorized (' || code || ')'
           WHEN code = 'ValidationException' THEN 'API accessible'
           WHEN status = 'NOT_TESTED' THEN 'Needs param mapping'
           ELSE '' END AS details,
      CAST(CASE WHEN status <> 'SKIPPED' AND code IS NULL THEN CASE permission WHEN 'GetCallerIdentity' THEN 1 WHEN 'DescribeInstances' THEN n_inst
                ELSE greatest(n_items, n_res, 1) END ELSE 0 END AS INTEGER) AS data_count
    FROM o
)
"""

_PURCHASE_LOOKUP = """
, m AS (
    SELECT p.event_id, a.event_id AS aid, a.ts AS ats, a.value AS avalue
    FROM probes p JOIN events a
      ON a.event_type = 'purchase' AND a.user_id = p.user_id
     AND a.ts BETWEEN p.ts - INTERVAL 60 MINUTE AND p.ts
),
agg AS (
    SELECT event_id, CAST(count(*) AS INTEGER) AS ct_count,
           arg_max(aid, ats) AS ct_latest_id, max(ats) AS ct_latest_time, arg_max(avalue, ats) AS ct_latest_value
    FROM m GROUP BY event_id
),
looked AS (
    SELECT p.*, COALESCE(agg.ct_count, 0) AS ct_count, agg.ct_latest_id, agg.ct_latest_time, agg.ct_latest_value,
           CASE WHEN COALESCE(agg.ct_count, 0) > 0 THEN agg.ct_count || ' events in last 60min'
                ELSE 'No recent events' END AS ct_message
    FROM probes p LEFT JOIN agg USING (event_id)
)
"""

ORACLES = {
    "report_outcomes": CALLS
    + """
    SELECT event_id, service, permission,
           lower(regexp_replace(regexp_replace(permission, '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS method_name,
           CASE WHEN service = 'purchase' AND permission = 'GetKeys' THEN 'kms'
                WHEN service = 'view' AND permission = 'ListTables' THEN 'glue'
                WHEN service = 'click' THEN 'clickstream'
                WHEN service = 'purchase' THEN 'billing'
                ELSE service END AS client,
           status, message, error_code, details, data_count,
           CASE status WHEN 'PASSED' THEN 'OK' WHEN 'DENIED' THEN 'DENIED' WHEN 'NOT_TESTED' THEN 'N/T'
                WHEN 'SKIPPED' THEN 'SKIP' WHEN 'ERROR' THEN 'ERR' ELSE '?' END AS short_status,
           CASE WHEN status = 'PASSED' THEN details ELSE message END AS detail_text
    FROM outc""",
    "report_summary": CALLS
    + """
    , t AS (SELECT count(*) AS total FROM outc),
    s(status) AS (VALUES ('PASSED'), ('DENIED'), ('NOT_TESTED'), ('SKIPPED'), ('ERROR')),
    c AS (SELECT s.status, CAST(count(outc.status) AS BIGINT) AS n FROM s LEFT JOIN outc ON outc.status = s.status GROUP BY s.status)
    SELECT c.status, c.n, CAST(CASE WHEN t.total = 0 THEN 0 ELSE c.n * 100 // t.total END AS BIGINT) AS percent FROM c, t
    UNION ALL SELECT 'Total', CAST(total AS BIGINT), CAST(100 AS BIGINT) FROM t""",
    "report_service_matrix": CALLS
    + """
    , g AS (
        SELECT service, CAST(count(*) AS BIGINT) AS total,
               CAST(count(*) FILTER (WHERE status = 'PASSED') AS BIGINT) AS passed,
               CAST(count(*) FILTER (WHERE status = 'DENIED') AS BIGINT) AS denied,
               CAST(count(*) FILTER (WHERE status = 'NOT_TESTED') AS BIGINT) AS not_tested,
               CAST(count(*) FILTER (WHERE status = 'SKIPPED') AS BIGINT) AS skipped,
               CAST(count(*) FILTER (WHERE status = 'ERROR') AS BIGINT) AS error
        FROM outc GROUP BY service
    )
    SELECT *, CASE WHEN denied > 0 THEN 'ISSUES' WHEN error > 0 THEN 'ERRORS' WHEN not_tested > 0 THEN 'PARTIAL'
                   WHEN passed = total - skipped THEN 'OK' ELSE 'PARTIAL' END AS verdict
    FROM g ORDER BY service""",
    "report_sections": CALLS
    + """
    SELECT 'not_tested' AS section, service, permission, message AS reason FROM outc WHERE status = 'NOT_TESTED'
    UNION ALL
    SELECT 'error', service, permission, message FROM outc WHERE status = 'ERROR'""",
    "report_verdict": CALLS
    + """
    SELECT CAST(count(*) FILTER (WHERE status = 'DENIED') AS BIGINT) AS denied,
           CASE WHEN count(*) FILTER (WHERE status = 'DENIED') > 0 THEN 1 ELSE 0 END AS exit_code FROM outc""",
    "report_run_summaries": CALLS
    + """
    , rn AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, status FROM outc),
    t AS (SELECT run_id, count(*) AS total FROM rn GROUP BY run_id),
    s(status) AS (VALUES ('PASSED'), ('DENIED'), ('NOT_TESTED'), ('SKIPPED'), ('ERROR'))
    SELECT t.run_id, s.status, CAST(count(rn.status) AS BIGINT) AS n, CAST(count(rn.status) * 100 // t.total AS BIGINT) AS percent
    FROM t CROSS JOIN s LEFT JOIN rn ON rn.run_id = t.run_id AND rn.status = s.status GROUP BY t.run_id, s.status, t.total
    UNION ALL SELECT run_id, 'Total', CAST(total AS BIGINT), CAST(100 AS BIGINT) FROM t""",
    "report_run_verdicts": CALLS
    + """
    SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, CAST(count(*) FILTER (WHERE status = 'DENIED') AS BIGINT) AS denied,
           CASE WHEN count(*) FILTER (WHERE status = 'DENIED') > 0 THEN 1 ELSE 0 END AS exit_code FROM outc GROUP BY 1""",
    "report_run_texts": CALLS
    + (
        """
    , rn AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, service, status FROM outc),
    t AS (SELECT run_id, count(*) AS total FROM rn GROUP BY run_id),
    s(place, status) AS (VALUES (1, 'PASSED'), (2, 'DENIED'), (3, 'NOT_TESTED'), (4, 'SKIPPED'), (5, 'ERROR')),
    n AS (SELECT t.run_id, s.place, s.status, count(rn.status) AS n, t.total
          FROM t CROSS JOIN s LEFT JOIN rn ON rn.run_id = t.run_id AND rn.status = s.status GROUP BY t.run_id, s.place, s.status, t.total),
    top AS (SELECT run_id, string_agg('| ' || status || ' | ' || n || ' | ' || (n * 100 // total) || '%% |', chr(10) ORDER BY place)
                   || chr(10) || '| Total | ' || max(total) || ' | 100%% |' AS body FROM n GROUP BY run_id),
    g AS (SELECT run_id, service, count(*) AS total, count(*) FILTER (WHERE status = 'PASSED') AS passed,
                 count(*) FILTER (WHERE status = 'DENIED') AS denied, count(*) FILTER (WHERE status = 'NOT_TESTED') AS not_tested,
                 count(*) FILTER (WHERE status = 'SKIPPED') AS skipped, count(*) FILTER (WHERE status = 'ERROR') AS error
          FROM rn GROUP BY run_id, service),
    rest AS (SELECT run_id, string_agg('| ' || concat_ws(' | ', service, total, passed, denied, not_tested, skipped, error,
                        CASE WHEN denied > 0 THEN 'ISSUES' WHEN error > 0 THEN 'ERRORS' WHEN not_tested > 0 THEN 'PARTIAL'
                             WHEN passed = total - skipped THEN 'OK' ELSE 'PARTIAL' END) || ' |', chr(10) ORDER BY service) AS body
             FROM g GROUP BY run_id)
    SELECT run_id, '%s' || chr(10) || top.body || chr(10) || chr(10) || '%s' || chr(10) || rest.body AS report FROM top JOIN rest USING (run_id)"""
        % ("\n".join(HEAD_SUMMARY), "\n".join(HEAD_MATRIX))
    ),
    "report_denied_audit": CALLS
    + ", probes AS (SELECT event_id, ts, user_id, service, permission, error_code FROM outc WHERE status = 'DENIED')"
    + _PURCHASE_LOOKUP
    + """
    SELECT event_id, service, permission, error_code, ct_count, ct_latest_id, ct_latest_time, ct_message FROM looked""",
    "events_audit_lookup": "WITH probes AS (SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'error')"
    + _PURCHASE_LOOKUP
    + """
    SELECT event_id, user_id, ct_count, ct_latest_id, ct_latest_time, ct_latest_value, ct_message FROM looked""",
    "report_pattern_matches": CALLS
    + """
    , pats(service, pattern) AS (VALUES ('click', 'List*'), ('click', 'Describe*'), ('view', 'Get*'),
        ('view', 'Describe_*'), ('purchase', '*Keys'), ('signup', 'Search*'), ('error', '*'))
    SELECT p.service, p.pattern, CAST(count(*) AS BIGINT) AS n_checks, count(DISTINCT c.permission) AS n_permissions
    FROM calls c JOIN pats p ON c.service = p.service
     AND c.permission LIKE replace(replace(p.pattern, '_', '\\_'), '*', '%') ESCAPE '\\'
    GROUP BY p.service, p.pattern""",
    "report_inventory": CALLS
    + """
    SELECT service, permission, CAST(row_number() OVER (PARTITION BY service ORDER BY permission) AS INTEGER) AS position,
           CAST(count(*) OVER (PARTITION BY service) AS INTEGER) AS n_permissions
    FROM (SELECT DISTINCT service, permission FROM calls)""",
}
