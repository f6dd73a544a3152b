"""Permission-outcome report over a call log.

Input: a call-log DataFrame ``(service, permission, error_code, error_message,
response map<string, array<string>>)``, one row per permission check. Every
section is a DataFrame, the text of the report included (``report_text``), and
is written by Spark. A log of several runs has a column that tells them apart;
named in ``by``, it gives every run its own section. A scalar field of a response is a
list of one; an object inside a list is its JSON text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.functions.scalars import RESPONSE_METADATA_KEYS, identity_name, identity_type, is_readonly, snake_case
from veilgrid.operators.audit import with_ordered_id

# Fixed values that must equal the reference's for the same classification.
# Error codes that mean the call was refused.
DENIED_CODES = ("AccessDenied", "AccessDeniedException", "UnauthorizedAccess", "UnauthorizedOperation", "AuthorizationError")
# Error codes that mean "resource not found" — the call itself was authorized.
NOT_FOUND_CODES = (
    "NoSuchBucket",
    "NoSuchKey",
    "NoSuchTagSet",
    "FunctionNotFound",
    "ResourceNotFoundException",
    "ResourceNotFoundFault",
    "ResourceNotFound",
    "SecretNotFoundError",
    "NotFoundException",
    "KeyNotFoundException",
    "InvalidKeyId",
    "QueueDoesNotExist",
    "AWS.SimpleQueueService.NonExistentQueue",
    "TrailNotFoundException",
    "NoSuchEntity",
    "EntityNotFoundException",
    "DBInstanceNotFound",
    "DBClusterNotFoundFault",
    "DBSnapshotNotFound",
    "StackNotFoundException",
    "LogGroupNotFoundException",
    "WorkGroupNotFoundException",
    "TableNotFoundException",
    "DatabaseNotFoundException",
    "InvalidAMIID.NotFound",
    "InvalidInstanceID.NotFound",
    "InvalidNetworkInterfaceID.NotFound",
    "InvalidSnapshot.NotFound",
    "InvalidVolume.NotFound",
    "InvalidVpcID.NotFound",
    "InvalidSpotFleetRequestId.NotFound",
    "InvalidLocalGatewayRouteTableID.NotFound",
    "InvalidVpcEndpointServiceId.NotFound",
    "PlatformApplicationDisabledException",
    "InvalidTargetArn.Unknown",
)
# Error codes of bad or incomplete input — the API was reachable.
BAD_INPUT_CODES = (
    "ValidationError",
    "ValidationException",
    "InvalidParameterValue",
    "MissingParameter",
    "InvalidSpotDatafeed.NotFound",
    "OptInRequired",
    "UnsupportedOperation",
    "BadRequest",
    "InvalidParameterCombination",
    "InvalidParameterException",
    "InvalidArnException",
    "InvalidAddress",
    "InvalidClientTokenId",
    "PermanentRedirect",
    "InvalidLocalGatewayRouteTableID.Malformed",
)
# Message fragments of client-side parameter validation (never reached the service).
PARAM_VALIDATION_TEXT = ("Parameter validation failed", "Missing required parameter")
# Short status words of the detail table.
SHORT_STATUS = {"PASSED": "OK", "DENIED": "DENIED", "NOT_TESTED": "N/T", "SKIPPED": "SKIP", "ERROR": "ERR"}
STATUSES = ("PASSED", "DENIED", "NOT_TESTED", "SKIPPED", "ERROR")
# Result messages and details per outcome ("%s" is the error code).
MSG_SKIPPED = "Not a read-only permission (safety check)"
MSG_PASSED = "Permission validated successfully"
MSG_NOT_FOUND = "Permission validated (resource not found)"
MSG_BAD_INPUT = "Permission exists (%s)"
MSG_NOT_TESTED = "Requires parameters not in mapping"
MSG_CLIENT_CHECK = "Requires parameters: %s"
CLIENT_CHECK_CODE = "ParamValidationError"
DETAIL_IDENTITY = "Account: %s, ARN: %s"
DETAIL_INSTANCES = "%d instances"
# Headings and table headers of the text report.
HEAD_SUMMARY = ("## Summary", "", "| Status | Count | Percentage |", "|--------|-------|------------|")
HEAD_MATRIX = (
    "## Service Permission Matrix",
    "",
    "| Service | Total | Passed | Denied | NotTested | Skipped | Error | Status |",
    "|---------|-------|--------|--------|-----------|---------|-------|--------|",
)
DETAIL_NO_LIST = "API call successful"
DETAIL_NOT_FOUND = "API authorized (%s)"
DETAIL_BAD_INPUT = "API accessible"
DETAIL_NOT_TESTED = "Needs param mapping"
NOT_AVAILABLE = "N/A"


def code_class(code: Column) -> Column:
    """The class of an error code ("denied", "not_found", "bad_input"), NULL for any other: literal lists, no join."""
    return (
        F.when(code.isin(*DENIED_CODES), F.lit("denied"))
        .when(code.isin(*NOT_FOUND_CODES), F.lit("not_found"))
        .when(code.isin(*BAD_INPUT_CODES), F.lit("bad_input"))
    )


def largest_list(response: Column, skip=RESPONSE_METADATA_KEYS) -> Column:
    """``struct(key, size)`` of the largest array in the map, first key wins a tie; metadata keys skipped.

    NULL when the map has no (non-metadata) array.
    """
    entries = F.filter(F.map_entries(response), lambda e: ~e["key"].isin(*skip))
    ranked = F.transform(
        entries, lambda e, i: F.struct(F.size(e["value"]).alias("n"), (-i).alias("neg_pos"), e["key"].alias("key"))
    )
    best = F.array_max(ranked)
    return F.when(F.size(entries) > 0, F.struct(best["key"].alias("key"), best["n"].alias("n")))


def nested_instances(response: Column) -> Column:
    """How many instances the response's reservations hold together."""
    each = F.transform(F.coalesce(response["Reservations"], F.array().cast("array<string>")), lambda r: F.size(F.from_json(r, "Instances array<string>")["Instances"]))
    return F.aggregate(each, F.lit(0), lambda n, x: n + F.greatest(x, F.lit(0)))


def classify_outcomes(log: DataFrame) -> DataFrame:
    """Status, message, error_code, details, count per call; first rule that matches wins.

    Order: not read-only → SKIPPED; no error → PASSED; denied code → DENIED;
    not-found code → PASSED; bad-input code → PASSED; parameter-validation
    text → NOT_TESTED; anything else → ERROR. A passed call's details: account
    and ARN of GetCallerIdentity, the instances inside the reservations of
    DescribeInstances, else the largest list of a non-empty response ("n key"),
    "API call successful" (1) when it has no list, and "" (0) when the response
    is empty or missing. Texts are whole; only the text report cuts them.
    """
    code, msg = F.col("error_code"), F.coalesce(F.col("error_message"), F.lit(""))
    cls = code_class(code)
    readonly = is_readonly("permission")
    client_check = code == CLIENT_CHECK_CODE
    param_text = client_check
    for t in PARAM_VALIDATION_TEXT:
        param_text = param_text | msg.contains(t)
    ok_call = code.isNull()
    status = (
        F.when(~readonly, F.lit("SKIPPED"))
        .when(ok_call, F.lit("PASSED"))
        .when(cls == "denied", F.lit("DENIED"))
        .when(cls.isin("not_found", "bad_input"), F.lit("PASSED"))
        .when(param_text, F.lit("NOT_TESTED"))
        .otherwise(F.lit("ERROR"))
    )
    main = largest_list(F.col("response"))
    message = (
        F.when(~readonly, F.lit(MSG_SKIPPED))
        .when(ok_call, F.lit(MSG_PASSED))
        .when(cls == "denied", msg)
        .when(cls == "not_found", F.lit(MSG_NOT_FOUND))
        .when(cls == "bad_input", F.format_string(MSG_BAD_INPUT, code))
        .when(client_check, F.format_string(MSG_CLIENT_CHECK, msg))
        .when(param_text, F.lit(MSG_NOT_TESTED))
        .otherwise(F.format_string("%s: %s", code, msg))
    )
    # Details come from a non-empty response only; an empty or missing one keeps the defaults ("" / 0).
    has_response = F.coalesce(F.size(F.col("response")) > 0, F.lit(False))
    response = F.col("response")
    identity, instances = F.col("permission") == "GetCallerIdentity", F.col("permission") == "DescribeInstances"
    who = F.format_string(DETAIL_IDENTITY, *[F.coalesce(F.get(response[k], F.lit(0)), F.lit("None")) for k in ("Account", "Arn")])
    n_instances = nested_instances(response)
    details = (
        F.when(~readonly, F.lit(""))
        .when(ok_call & ~has_response, F.lit(""))
        .when(ok_call & identity, who)
        .when(ok_call & instances, F.format_string(DETAIL_INSTANCES, n_instances))
        .when(ok_call & main.isNotNull(), F.format_string("%d %s", main["n"], F.lower(main["key"])))
        .when(ok_call, F.lit(DETAIL_NO_LIST))
        .when(cls == "denied", F.lit(""))
        .when(cls == "not_found", F.format_string(DETAIL_NOT_FOUND, code))
        .when(cls == "bad_input", F.lit(DETAIL_BAD_INPUT))
        .when(param_text, F.lit(DETAIL_NOT_TESTED))
        .otherwise(F.lit(""))
    )
    size = F.when(identity, F.lit(1)).when(instances, n_instances).otherwise(F.coalesce(main["n"], F.lit(1)))
    count = F.when(readonly & ok_call & has_response, size).otherwise(F.lit(0))
    return (
        log.withColumn("status", status)
        .withColumn("message", message)
        .withColumn("result_error_code", F.when(F.col("status").isin("DENIED", "ERROR"), code))
        .withColumn("details", details)
        .withColumn("data_count", count.cast("int"))
        .withColumn("method_name", snake_case("permission"))
    )


def detail_table(outcomes: DataFrame) -> DataFrame:
    """Short status and the text shown per check: details (with the sample, if there is one) when PASSED, else the message."""
    short = F.coalesce(
        F.element_at(F.create_map(*[x for k, v in SHORT_STATUS.items() for x in (F.lit(k), F.lit(v))]), F.col("status")),
        F.lit("?"),
    )
    shown = F.col("details")
    if "sample" in outcomes.columns:
        sample = F.nullif(F.col("sample"), F.lit(""))
        both = F.when(shown != "", F.format_string("%s (%s)", shown, sample)).otherwise(sample)
        shown = F.when(sample.isNotNull(), both).otherwise(shown)
    text = F.when(F.col("status") == "PASSED", shown).otherwise(F.col("message"))
    return outcomes.withColumn("short_status", short).withColumn("detail_text", text)


def status_counts(outcomes: DataFrame) -> Column:
    """A2: the five conditional counts as aggregate expressions."""
    s = F.col("status")
    return [F.count_if(s == st).alias(st.lower()) for st in STATUSES]


def summary(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A2 + A3, R6: count and integer percent (``n*100 // total``, 0 when empty) per status, plus Total, for each run of ``by``.

    One aggregate row a run (partial aggregation map-side, one scan), unpivoted with
    ``stack`` into the five status rows and the Total row.
    """
    agg = outcomes.groupBy(*by).agg(*status_counts(outcomes), F.count(F.lit(1)).alias("total"))
    pairs = [f"'{st}', {st.lower()}" for st in STATUSES] + ["'Total', total"]
    per = agg.select(*by, "total", F.expr(f"stack({len(pairs)}, {', '.join(pairs)}) AS (status, n)"))
    pct = F.when(F.col("status") == "Total", F.lit(100)).when(F.col("total") == 0, F.lit(0)).otherwise(F.expr("n * 100 div total"))
    return per.select(*by, "status", F.col("n").cast("long").alias("n"), pct.cast("long").alias("percent"))


def service_verdict(total: Column, passed: Column, denied: Column, not_tested: Column, skipped: Column, error: Column) -> Column:
    """A5: ordered rules — ISSUES, ERRORS, PARTIAL (not tested), OK, else PARTIAL."""
    return (
        F.when(denied > 0, F.lit("ISSUES"))
        .when(error > 0, F.lit("ERRORS"))
        .when(not_tested > 0, F.lit("PARTIAL"))
        .when(passed == total - skipped, F.lit("OK"))
        .otherwise(F.lit("PARTIAL"))
    )


def service_matrix(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A4 + A5 + O4: per (run and) service totals by status and a verdict, sorted by service."""
    agg = outcomes.groupBy(*by, "service").agg(F.count(F.lit(1)).alias("total"), *status_counts(outcomes))
    c = F.col
    return agg.withColumn(
        "verdict", service_verdict(c("total"), c("passed"), c("denied"), c("not_tested"), c("skipped"), c("error"))
    ).orderBy(*by, F.col("service").asc_nulls_last())


def sections(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The not-tested list and the error list with their whole messages, in one pass."""
    s = F.col("status")
    return outcomes.filter(s.isin("NOT_TESTED", "ERROR")).select(
        *by,
        F.when(s == "NOT_TESTED", F.lit("not_tested")).otherwise(F.lit("error")).alias("section"),
        "service",
        "permission",
        F.col("message").alias("reason"),
    )


def run_verdict(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exit code 1 for each run in which any check was DENIED (errors and not-tested do not fail it)."""
    return outcomes.groupBy(*by).agg(F.count_if(F.col("status") == "DENIED").alias("denied")).select(
        *by, "denied", F.when(F.col("denied") > 0, F.lit(1)).otherwise(F.lit(0)).alias("exit_code")
    )


def permission_inventory(log: DataFrame) -> DataFrame:
    """D12 + A7: one row per distinct (service, permission) with its place in the service's sorted list and the list's length.

    Rows, not one array per service, and no window over one: nothing bounds a
    service's permissions. Places in the order of all pairs come from ranges of
    it, and a service's own start at its first.
    """
    pairs = log.select("service", "permission").distinct()
    ranked = with_ordered_id(pairs, ["service", "permission"], id_col="rank")
    sizes = ranked.groupBy(F.col("service").alias("of")).agg(F.min("rank").alias("first"), F.count(F.lit(1)).cast("int").alias("n_permissions"))
    position = (F.col("rank") - F.col("first") + 1).cast("int").alias("position")
    return ranked.join(sizes, F.col("service").eqNullSafe(F.col("of"))).select("service", "permission", position, "n_permissions")


def report_text(summaries: DataFrame, matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value): the Markdown text of each run from its summary and its service matrix.

    A text holds a line a status and a line a service of one run.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    order = F.array_position(F.array(*[F.lit(x) for x in (*STATUSES, "Total")]), F.col("status"))
    status_line = F.format_string("| %s | %s | %s%% |", "status", "n", "percent")
    columns = ("service", "total", "passed", "denied", "not_tested", "skipped", "error", "verdict")
    service_line = F.concat(F.lit("| "), F.concat_ws(" | ", *[shown(c) for c in columns]), F.lit(" |"))
    # A service without a name comes last.
    key = F.struct(order.cast("int").alias("place"), F.lit("").alias("name"), status_line.alias("line"))
    service_key = F.struct(F.when(F.col("service").isNull(), len(STATUSES) + 3).otherwise(len(STATUSES) + 2).alias("place"), F.coalesce("service", F.lit("")).alias("name"), service_line.alias("line"))
    lines = summaries.select(*by, key.alias("x")).union(matrix.select(*by, service_key.alias("x")))
    text = lines.groupBy(*by).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    part = lambda test: F.transform(F.filter("xs", test), lambda x: x["line"])
    head = lambda xs: F.array(*[F.lit(x) for x in xs])
    whole = F.concat(
        head(HEAD_SUMMARY), part(lambda x: x["place"] <= len(STATUSES) + 1), head(("", *HEAD_MATRIX)), part(lambda x: x["place"] > len(STATUSES) + 1)
    )
    return text.select(*by, F.array_join(whole, "\n").alias("value"))


def render_markdown(summary_rows, matrix_rows) -> str:
    """The text of ``report_text`` for one run, from the rows of the two small, already aggregated sections."""
    out = list(HEAD_SUMMARY)
    out += [f"| {r['status']} | {r['n']} | {r['percent']}% |" for r in summary_rows]
    out += ["", *HEAD_MATRIX]
    columns = ("service", "total", "passed", "denied", "not_tested", "skipped", "error", "verdict")
    out += ["| " + " | ".join(str(r[c]) for c in columns) + " |" for r in matrix_rows]
    return "\n".join(out) + "\n"


def as_check_result(outcomes: DataFrame) -> DataFrame:
    """One nested check result per row —
    ``{service, permission, status, message, error_code, data{count, sample, details}}``."""
    return outcomes.select(
        F.struct(
            "service",
            "permission",
            "status",
            "message",
            F.col("result_error_code").alias("error_code"),
            F.struct(
                F.col("data_count").alias("count"),
                (F.col("sample") if "sample" in outcomes.columns else F.lit(None)).cast("string").alias("sample"),
                F.col("details").alias("details"),
            ).alias("data"),
        ).alias("result")
    )


def identity_section(identity: DataFrame) -> DataFrame:
    """The caller identity table: account, identity type and name parsed from the ARN, ARN, user id."""
    return identity.select(
        "account",
        identity_type("arn").alias("identity_type"),
        identity_name("arn").alias("identity_name"),
        "arn",
        "user_id",
    )


def denied_section(outcomes: DataFrame, lookup: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The denied checks with their audit-trail text; "N/A" when no look-up was run.

    ``lookup`` is the output of ``audit_lookup`` over the denied rows (keyed by
    ``event_id``, with ``ct_message``).
    """
    denied = outcomes.filter(F.col("status") == "DENIED")
    base = denied.select(*by, "service", "permission", F.coalesce("result_error_code", F.lit(NOT_AVAILABLE)).alias("error_code"))
    if lookup is None:
        return base.withColumn("audit_trail", F.lit(NOT_AVAILABLE))
    return lookup.select(
        *by, "service", "permission", F.coalesce("error_code", F.lit(NOT_AVAILABLE)).alias("error_code"),
        F.coalesce("ct_message", F.lit(NOT_AVAILABLE)).alias("audit_trail"),
    )


def report_tables(
    outcomes: DataFrame, denied_lookup: DataFrame | None = None, identity: DataFrame | None = None, by: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """Every report section as a DataFrame (nothing is collected here).

    ``by`` names the columns that tell runs apart (``run_id``): every section
    then has them, and each run its own counts, percents, text and verdict.
    """
    out = {
        "summary": summary(outcomes, by),
        "service_matrix": service_matrix(outcomes, by),
        "denied": denied_section(outcomes, denied_lookup, by),
        "sections": sections(outcomes, by),
        "detail": detail_table(outcomes).select(*by, "service", "permission", "short_status", "detail_text"),
        "verdict": run_verdict(outcomes, by),
    }
    if identity is not None:
        out["identity"] = identity_section(identity)
    return out


def write_report(tables: dict[str, DataFrame], path: str, markdown_name: str = "report.md") -> str | None:
    """S18 sink: each section as Parquet under ``path/<section>``, the Markdown as text files under ``path/<markdown_name>``.

    Spark writes both, to whatever file system the path names. Of a log of one
    run the text is also returned; with several runs each has its folder
    ``<column>=<run>`` below ``markdown_name``, and None is returned.
    """
    base = path.rstrip("/")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")
    by = [c for c in tables["summary"].columns if c not in ("status", "n", "percent")]
    text = report_text(tables["summary"], tables["service_matrix"], by)
    writer = text.write.mode("overwrite")
    if by:
        writer.partitionBy(*by).text(f"{base}/{markdown_name}")
        return None
    writer.text(f"{base}/{markdown_name}")
    return text.first().value + "\n"
