"""Permission report (R1–R8, A2–A8) and look-up joins."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilgrid.functions.scalars import identity_name, identity_type, is_readonly, snake_case
from veilgrid.operators.lookup import audit_lookup, expand_patterns, lookup_default
from veilgrid.operators.report import (
    classify_outcomes,
    detail_table,
    largest_list,
    render_markdown,
    run_verdict,
    sections,
    service_matrix,
    summary,
)

LOG_SCHEMA = "service string, permission string, error_code string, error_message string, response map<string, array<string>>"


def _log(spark, rows):
    return spark.createDataFrame(rows, LOG_SCHEMA)


def test_outcome_classes_first_match_wins(spark):
    rows = [
        ("s3", "PutObject", None, None, None),
        ("s3", "ListBuckets", None, None, {"Buckets": ["a", "b"], "Owner": ["o"], "NextToken": ["x", "y", "z"]}),
        ("s3", "GetBucketPolicy", "NoSuchBucket", "gone", None),
        ("ec2", "DescribeInstances", "AccessDenied", "not authorized", None),
        ("ec2", "DescribeImages", "InvalidParameterValue", "bad", None),
        ("kms", "GetKeyPolicy", "SomeParamError", "Parameter validation failed: x", None),
        ("kms", "ListAliases", "Throttling", "slow down", None),
        ("sts", "GetCallerIdentity", None, None, {}),
        ("sts", "GetSessionToken", None, None, {"ResponseMetadata": ["m"]}),
    ]
    o = detail_table(classify_outcomes(_log(spark, rows)))
    got = {r.permission: (r.status, r.message, r.result_error_code, r.details, r.data_count, r.short_status) for r in o.collect()}
    assert got["PutObject"] == ("SKIPPED", "Not a read-only permission (safety check)", None, "", 0, "SKIP")
    assert got["ListBuckets"] == ("PASSED", "Permission validated successfully", None, "2 buckets", 2, "OK")
    assert got["GetBucketPolicy"][:4] == ("PASSED", "Permission validated (resource not found)", None, "API authorized (NoSuchBucket)")
    assert got["DescribeInstances"][:3] == ("DENIED", "not authorized", "AccessDenied")
    assert got["DescribeImages"][:2] == ("PASSED", "Permission exists (InvalidParameterValue)")
    assert got["GetKeyPolicy"][:4] == ("NOT_TESTED", "Requires parameters not in mapping", None, "Needs param mapping")
    assert got["ListAliases"][:3] == ("ERROR", "Throttling: slow down", "Throttling")
    assert got["GetCallerIdentity"][3:5] == ("", 0)  # empty response: defaults kept
    assert got["GetSessionToken"][3:5] == ("API call successful", 1)  # response without a list


def test_special_details_and_whole_texts(spark):
    reservations = ['{"Instances":["a","b"]}', '{"Instances":[]}', '{"Other":1}', '{"Instances":["c"]}']
    rows = [
        ("ec2", "DescribeInstances", None, None, {"Reservations": reservations, "Tags": ["t"] * 9}),
        ("sts", "GetCallerIdentity", None, None, {"Account": ["000000000000"], "Arn": ["arn:x"], "Many": ["m"] * 5}),
        ("sts", "GetSessionToken", "ParamValidationError", "x" * 200, None),
        ("s3", "ListBuckets", "Throttling", "y" * 200, None),
    ]
    o = detail_table(classify_outcomes(_log(spark, rows)).withColumn("sample", F.when(F.col("service") == "ec2", F.lit("a, b"))))
    got = {r.permission: (r.status, r.details, r.data_count, r.detail_text) for r in o.collect()}
    assert got["DescribeInstances"] == ("PASSED", "3 instances", 3, "3 instances (a, b)")
    assert got["GetCallerIdentity"] == ("PASSED", "Account: 000000000000, ARN: arn:x", 1, "Account: 000000000000, ARN: arn:x")
    assert got["GetSessionToken"] == ("NOT_TESTED", "Needs param mapping", 0, "Requires parameters: " + "x" * 200)
    assert got["ListBuckets"][3] == "Throttling: " + "y" * 200


def test_audit_lookup_counts_a_dense_hour(spark):
    """One key holds all events of an hour: the true count, in a pass that is linear in the events."""
    base = datetime(2024, 1, 1, 10)
    events = spark.range(200_000).select(F.col("id").alias("aid"), F.lit(1).alias("k"), (F.lit(base).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") % 3600)).alias("at"))
    probes = spark.createDataFrame([(1, 1, base + timedelta(minutes=59, seconds=59)), (2, 1, base + timedelta(seconds=9))], "pid long, k int, t timestamp_ntz")
    got = {r.pid: r.ct_count for r in audit_lookup(probes, events, key="k", probe_ts="t", audit_ts="at", audit_id="aid").collect()}
    per_second = [len(range(s, 200_000, 3600)) for s in range(3600)]
    assert got == {1: 200_000, 2: sum(per_second[:10])}


def test_largest_list_tie_and_metadata(spark):
    df = spark.createDataFrame(
        [({"A": ["1"], "B": ["2"], "NextToken": ["x", "y"]},), ({"ResponseMetadata": ["m"]},), ({"Z": [], "Y": ["q"]},)],
        "m map<string, array<string>>",
    )
    got = [r.x for r in df.select(largest_list(F.col("m")).alias("x")).collect()]
    assert (got[0].key, got[0].n) == ("A", 1)
    assert got[1] is None
    assert (got[2].key, got[2].n) == ("Y", 1)


def _outcomes(spark, statuses):
    return spark.createDataFrame([(s, st, "m" * 120) for s, st in statuses], "service string, status string, message string").withColumn("permission", F.lit("P"))


def test_summary_percent_and_total(spark):
    o = _outcomes(spark, [("a", "PASSED")] * 2 + [("a", "DENIED")])
    got = {r.status: (r.n, r.percent) for r in summary(o).collect()}
    assert got == {"PASSED": (2, 66), "DENIED": (1, 33), "NOT_TESTED": (0, 0), "SKIPPED": (0, 0), "ERROR": (0, 0), "Total": (3, 100)}
    empty = summary(o.limit(0))
    assert {r.status: r.percent for r in empty.collect()}["PASSED"] == 0


@pytest.mark.parametrize(
    "statuses,verdict",
    [
        (["PASSED", "DENIED", "ERROR"], "ISSUES"),
        (["PASSED", "ERROR", "NOT_TESTED"], "ERRORS"),
        (["PASSED", "NOT_TESTED"], "PARTIAL"),
        (["PASSED", "SKIPPED"], "OK"),
        (["SKIPPED"], "OK"),
    ],
)
def test_service_verdict_rules(spark, statuses, verdict):
    o = _outcomes(spark, [("svc", s) for s in statuses])
    assert service_matrix(o).first().verdict == verdict


def test_sections_and_run_verdict(spark):
    o = _outcomes(spark, [("a", "NOT_TESTED"), ("a", "ERROR"), ("b", "PASSED")])
    got = {r.section: len(r.reason) for r in sections(o).collect()}
    assert got == {"not_tested": 120, "error": 120}  # whole messages
    assert tuple(run_verdict(o).first()) == (0, 0)
    assert tuple(run_verdict(_outcomes(spark, [("a", "DENIED")])).first()) == (1, 1)
    md = render_markdown(summary(o).collect(), service_matrix(o).collect())
    assert "| Total | 3 | 100% |" in md and "| a | 2 |" in md


def test_string_helpers(spark):
    df = spark.createDataFrame(
        [("DescribeDBClusters", "arn:aws:sts::000000000000:assumed-role/Viewer/session"), ("GetObject", "arn:aws:iam::000000000000:user/alice"), ("PutItem", "x")],
        "p string, arn string",
    )
    got = [tuple(r) for r in df.select(snake_case("p"), is_readonly("p"), identity_type("arn"), identity_name("arn")).collect()]
    assert got == [
        ("describe_db_clusters", True, "Assumed Role", "Viewer"),
        ("get_object", True, "IAM User", "alice"),
        ("put_item", False, "Unknown", "x"),
    ]


def test_lookup_default(spark):
    df = spark.createDataFrame([("s3", "List"), ("logs", "Get")], "service string, permission string")
    m = spark.createDataFrame([("logs", "cloudwatch-logs")], "service string, client string")
    got = {r.service: r.client for r in lookup_default(df, m, ["service"], "client", "client", F.col("service")).collect()}
    assert got == {"s3": "s3", "logs": "cloudwatch-logs"}


def test_pattern_join_escapes_underscore(spark):
    acts = spark.createDataFrame(
        [("ec2", "DescribeImages"), ("ec2", "DescribeImageAttribute"), ("ec2", "Describe_X"), ("ec2", "DescribeYX"), ("s3", "ListBuckets")],
        "service string, permission string",
    )
    pats = spark.createDataFrame([("ec2", "DescribeImage*"), ("ec2", "Describe_*"), ("s3", "List*")], "service string, pattern string")
    got = sorted((r.pattern, r.permission) for r in expand_patterns(acts, pats).collect())
    assert got == [
        ("DescribeImage*", "DescribeImageAttribute"),
        ("DescribeImage*", "DescribeImages"),
        ("Describe_*", "Describe_X"),
        ("List*", "ListBuckets"),
    ]


def _brute(probes, audit, minutes):
    out = {}
    for pid, k, t in probes:
        hits = [(at, aid) for aid, ak, at in audit if ak == k and t - timedelta(minutes=minutes) <= at <= t]
        latest = max(hits)[1] if hits else None
        out[pid] = (len(hits), latest)
    return out


@pytest.mark.parametrize("split", [1, 3])
def test_audit_lookup_matches_brute_force_with_hot_key(spark, split):
    rnd = random.Random(7)
    base = datetime(2024, 1, 1)
    # Key 0 is hot: a third of all rows, packed into a few hours.
    audit = []
    for i in range(900):
        k = 0 if i % 3 == 0 else rnd.randint(1, 20)
        span = 240 if k == 0 else 3000
        audit.append((i, k, base + timedelta(minutes=rnd.randint(0, span), seconds=rnd.randint(0, 59))))
    probes = [(10000 + j, rnd.choice([0, 0, 1, 2, 3, 5, 99]), base + timedelta(minutes=rnd.randint(0, 3000))) for j in range(300)]
    probes.append((20000, 0, audit[0][2]))  # tie with an audit time: inclusive
    a_df = spark.createDataFrame(audit, "aid long, k long, at timestamp_ntz")
    p_df = spark.createDataFrame(probes, "pid long, k long, t timestamp_ntz")
    res = audit_lookup(p_df, a_df, key="k", probe_ts="t", audit_ts="at", audit_id="aid", minutes=60, split=split)
    got = {r.pid: (r.ct_count, r.ct_latest_id) for r in res.collect()}
    expected = _brute(probes, [(a, k, t) for a, k, t in audit], 60)
    assert len(got) == len(probes)
    assert got == expected
    assert any(c > 50 for c, _ in got.values()) and any(c == 0 for c, _ in got.values())


def test_latest_per_group_and_check_result(spark):
    from veilgrid.operators.lookup import latest_per_group
    from veilgrid.operators.report import as_check_result

    ev = spark.createDataFrame(
        [("GetObject", 1, "alice", datetime(2024, 1, 1, 10)), ("GetObject", 2, "bob", datetime(2024, 1, 1, 11)), ("ListKeys", 3, "carol", datetime(2024, 1, 1, 9))],
        "event_name string, id long, username string, event_time timestamp_ntz",
    )
    got = {r.event_name: (r.latest.username, r.n) for r in latest_per_group(ev, ["event_name"], "event_time", ["username", "id"], tiebreak="id").collect()}
    assert got == {"GetObject": ("bob", 2), "ListKeys": ("carol", 1)}
    o = classify_outcomes(_log(spark, [("s3", "ListBuckets", None, None, {"Buckets": ["a"]})]))
    r = as_check_result(o).first().result
    assert (r.service, r.status, r.error_code, r.data["count"], r.data.details) == ("s3", "PASSED", None, 1, "1 buckets")


def test_audit_lookup_nulls_never_match(spark):
    base = datetime(2024, 1, 1, 12)
    audit = spark.createDataFrame([(1, None, base), (2, 5, None), (3, 5, base)], "aid long, k long, at timestamp_ntz")
    probes = spark.createDataFrame([(10, None, base), (11, 5, None), (12, 5, base)], "pid long, k long, t timestamp_ntz")
    got = {r.pid: (r.ct_count, r.ct_latest_id, r.ct_message) for r in audit_lookup(probes, audit, key="k", probe_ts="t", audit_ts="at", audit_id="aid").collect()}
    assert got == {10: (0, None, "No recent events"), 11: (0, None, "No recent events"), 12: (1, 3, "1 events in last 60min")}


def test_identity_and_denied_sections(spark):
    from veilgrid.operators.report import denied_section, identity_section, report_tables

    ident = spark.createDataFrame(
        [("000000000000", "arn:aws:sts::000000000000:assumed-role/ReadOnly/session-1", "AROAEXAMPLE:session-1")],
        "account string, arn string, user_id string",
    )
    r = identity_section(ident).first()
    assert (r.identity_type, r.identity_name) == ("Assumed Role", "ReadOnly")
    o = classify_outcomes(_log(spark, [("s3", "GetObject", "AccessDenied", "no", None), ("s3", "ListBuckets", None, None, None)]))
    assert [tuple(x) for x in denied_section(o).collect()] == [("s3", "GetObject", "AccessDenied", "N/A")]
    tables = report_tables(o, identity=ident)
    assert set(tables) == {"summary", "service_matrix", "denied", "sections", "detail", "verdict", "identity"}


def test_pattern_join_meets_by_prefix(spark):
    """Thousands of patterns in one service against a plain match, and no join without the prefix."""
    import contextlib
    import io
    import random
    from fnmatch import fnmatchcase

    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc_%") for _ in range(rng.randrange(n)))
    acts = sorted({word(7) for _ in range(300)})
    pats = sorted({f"{word(4)}{rng.choice(['', '*', '*' + word(3), '*' + word(2) + '*'])}" for _ in range(2000)} | {"", "*"})
    a = spark.createDataFrame([("one", x, 1) for x in acts] + [("two", "abc", 2), ("one", None, 3)], "service string, permission string, n int")
    p = spark.createDataFrame([("one", x) for x in pats] + [("two", "a*c"), ("two", None)], "service string, pattern string")
    joined = expand_patterns(a, p)
    got = sorted((r.service, r.permission, r.pattern, r.n) for r in joined.collect())
    assert got == sorted([("one", x, y, 1) for x in acts for y in pats if fnmatchcase(x, y)] + [("two", "abc", "a*c", 2)])
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        joined.explain("formatted")
    assert "NestedLoop" not in out.getvalue() and "Cartesian" not in out.getvalue()
