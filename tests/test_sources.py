"""Catalog DDL, sinks and the permission config (S1–S20) and the policy graph."""

import json
import os

import pytest
from pyspark.sql import functions as F

from veilgrid.operators.access import Governor, grants_frame
from veilgrid.operators.policy import POLICY_SCHEMA, bypass_findings, flatten_policies, reachable_roles
from veilgrid.sources import catalog as C
from veilgrid.sources.permissions import counts, load_permissions
from veilgrid.sources.sinks import dataset_view, export_csv, result_location, write_result


def test_catalog_ddl_and_scans(spark, tmp_dir):
    C.create_database(spark, "aeronav_db")
    assert not C.ensure(spark.sql, "CREATE DATABASE aeronav_db")  # already exists → success, nothing made
    schema = "waypoint_id string, waypoint_name string, region string"
    C.create_table(spark, "aeronav_db.navigation_waypoints", schema, f"{tmp_dir}/wp", {"table_type": "ICEBERG"})
    C.create_table(spark, "aeronav_db.navigation_waypoints", schema, f"{tmp_dir}/wp", {"table_type": "ICEBERG"})
    C.append(spark.createDataFrame([("WP001", "KENNEDY", "NY")], schema), "aeronav_db.navigation_waypoints")
    C.append_by_name(spark.createDataFrame([("POC", "WP_POC_001")], "region string, waypoint_id string"), "aeronav_db.navigation_waypoints")
    rows = sorted(tuple(r) for r in C.read_table(spark, "aeronav_db.navigation_waypoints").collect())
    assert rows == [("WP001", "KENNEDY", "NY"), ("WP_POC_001", None, "POC")]
    tabs = {(r.database, r.table): r.properties for r in C.catalog_tables(spark, ["aeronav_db"]).collect()}
    assert tabs[("aeronav_db", "navigation_waypoints")]["table_type"] == "ICEBERG"
    assert [r.database for r in C.find_schemas(spark, "aero%").collect()] == ["aeronav_db"]
    made = C.alias_schema(spark, "aeronav_alias", "aeronav_db", {"navigation_waypoints": ["waypoint_id", "region"]})
    assert made == ["aeronav_alias.navigation_waypoints"]
    assert spark.table("aeronav_alias.navigation_waypoints").columns == ["waypoint_id", "region"]
    C.drop_alias(spark, "aeronav_alias")
    assert "aeronav_alias" not in [d.name for d in spark.catalog.listDatabases()]


def test_register_external(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    df.write.parquet(f"{tmp_dir}/ext")
    C.create_database(spark, "ext_db")
    t = C.register_external(spark, "ext_db.ext", df.schema, f"{tmp_dir}/ext")
    assert t.count() == 1 and C.register_external(spark, "ext_db.ext", df.schema, f"{tmp_dir}/ext").count() == 1


def test_result_location_rule():
    assert result_location("s3://wg/results", True, "s3://mine/demo-results") == "s3://wg/results"
    assert result_location("s3://wg/results", False, "s3://mine/demo-results") == "s3://mine/demo-results"
    assert result_location("s3://wg/results", False, None) == "s3://wg/results"


def test_csv_export_and_result_sink(spark, tmp_dir):
    df = spark.createDataFrame([("WP_POC_002", None), ("WP_POC_001", "POC_ALPHA")], "waypoint_id string, waypoint_name string")
    path = export_csv(df, tmp_dir, "aeronav_db", "navigation_waypoints", "20240101_120000", order_by=["waypoint_id"])
    assert path.endswith("exported-data/aeronav_db/navigation_waypoints/export_20240101_120000.csv")
    text = "".join(open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.startswith("part-"))
    assert text.splitlines()[0] == "waypoint_id,waypoint_name"
    assert "WP_POC_002," in text.splitlines()
    assert text.index("WP_POC_001") < text.index("WP_POC_002")
    out = write_result(df, f"{tmp_dir}/wg", "q1", enforce=True, caller_path=f"{tmp_dir}/mine")
    assert out == f"{tmp_dir}/wg/q1" and spark.read.parquet(out).count() == 2


def test_dataset_view_types(spark):
    df = spark.createDataFrame([("2024-01-15 10:30:00", "FL001", "450", "450.5")], "ts string, id string, n string, x string")
    v = dataset_view(df, {"ts": "DATETIME", "id": "STRING", "n": "INTEGER", "x": "DECIMAL"})
    assert v.dtypes == [("ts", "timestamp"), ("id", "string"), ("n", "int"), ("x", "double")]


def test_load_permissions_subset_and_missing(spark, tmp_dir):
    p = f"{tmp_dir}/perms.json"
    with open(p, "w") as fh:
        json.dump({"config": {"region": "local"}, "permissions": {"s3": ["ListBuckets", "GetObject"], "ec2": ["DescribeInstances"]}}, fh)
    pairs, missing = load_permissions(spark, p)
    assert tuple(counts(pairs).first()) == (3, 2)
    chosen, missing = load_permissions(spark, p, ["s3", "lambda"])
    assert sorted(r.permission for r in chosen.collect()) == ["GetObject", "ListBuckets"]
    assert [r.service for r in missing.collect()] == ["lambda"]


def test_reachable_roles_two_hops(spark):
    edges = spark.createDataFrame(
        [("ps_DataScientist", "DataScientist"), ("DataScientist", "WarehouseRole"), ("WarehouseRole", "Deeper"), ("ps_Viewer", "Viewer")],
        "src string, dst string",
    )
    got = sorted(tuple(r) for r in reachable_roles(edges, 2).collect())
    assert ("ps_DataScientist", "WarehouseRole", 2) in got and ("ps_DataScientist", "Deeper", 3) not in got
    assert ("DataScientist", "Deeper", 2) in got


def test_flatten_and_bypass(spark):
    policies = spark.createDataFrame(
        [
            ("AeroNav", [("Allow", ["s3:GetObject", "s3:ListBucket"], ["bucket-nav/*", "bucket-weather/*"])]),
            ("DataScientist", [("Allow", ["s3:*"], ["*"])]),
        ],
        POLICY_SCHEMA,
    )
    flat = flatten_policies(policies)
    assert flat.count() == 5
    visible = spark.createDataFrame(
        [("AeroNav", "aeronav_db", "navigation_waypoints", False), ("DataScientist", "aeronav_db", "navigation_waypoints", True)],
        "role string, database string, table string, full_table boolean",
    )
    locs = spark.createDataFrame([("aeronav_db", "navigation_waypoints", "bucket-nav/tables/wp")], "database string, table string, location string")
    got = [(r.role, r.resource) for r in bypass_findings(flat, visible, locs).collect()]
    assert got == [("AeroNav", "bucket-nav/*")]


def test_governor_rejects_bad_names(spark):
    with pytest.raises(ValueError):
        Governor(spark, {"no_db_part": spark.range(1)}, grants_frame(spark, []), roles=[])
    assert F  # keep import used


def test_permissions_frame_counts(spark):
    from veilgrid.sources.permissions import permissions_frame

    pairs = permissions_frame(spark, {"s3": ["ListBuckets", "GetObject"], "kms": ["ListKeys"]})
    assert tuple(counts(pairs).first()) == (3, 2)


def test_report_sink_writes_every_section(spark, tmp_dir):
    from veilgrid.operators.report import classify_outcomes, report_tables, write_report

    log = spark.createDataFrame(
        [("s3", "ListBuckets", None, None, None), ("s3", "GetObject", "AccessDenied", "no", None), ("ec2", "PutItem", None, None, None)],
        "service string, permission string, error_code string, error_message string, response map<string, array<string>>",
    )
    tables = report_tables(classify_outcomes(log))
    text = write_report(tables, f"{tmp_dir}/report")
    assert "| DENIED | 1 | 33% |" in text
    assert spark.read.parquet(f"{tmp_dir}/report/verdict").first().exit_code == 1
    assert os.path.exists(f"{tmp_dir}/report/report.md")
    assert spark.read.text(f"{tmp_dir}/report/report.md", wholetext=True).first().value == text
    write_report(report_tables(classify_outcomes(log.limit(2))), f"file://{tmp_dir}/report")
    assert "| ec2 |" not in spark.read.text(f"{tmp_dir}/report/report.md", wholetext=True).first().value


def test_report_of_several_runs(spark, tmp_dir):
    from veilgrid.operators.report import classify_outcomes, render_markdown, report_tables, report_text, service_matrix, summary, write_report

    rows = [("r1", "s3", "ListBuckets", None), ("r1", "s3", "GetObject", "AccessDenied"), ("r1", None, "GetObject", None), ("r2", "s3", "ListBuckets", None), ("r2", "a", "GetKeys", None)]
    log = spark.createDataFrame([(*r, None, None) for r in rows], "run_id string, service string, permission string, error_code string, error_message string, response map<string, array<string>>")
    o = classify_outcomes(log)
    tables = report_tables(o, by=["run_id"])
    assert {r.run_id: r.exit_code for r in tables["verdict"].collect()} == {"r1": 1, "r2": 0}
    assert {(r.run_id, r.n) for r in tables["summary"].where("status = 'Total'").collect()} == {("r1", 3), ("r2", 2)}
    assert write_report(tables, f"{tmp_dir}/runs") is None
    for run in ("r1", "r2"):
        mine = o.where(f"run_id = '{run}'")
        want = render_markdown(summary(mine).collect(), service_matrix(mine).collect())
        assert spark.read.text(f"{tmp_dir}/runs/report.md/run_id={run}", wholetext=True).first().value == want
    assert report_text(summary(o.limit(0), ["run_id"]), service_matrix(o.limit(0), ["run_id"]), ["run_id"]).count() == 0


def test_load_permissions_yaml(spark, tmp_dir):
    from veilgrid.sources.permissions import load_config

    p = f"{tmp_dir}/perms.yaml"
    with open(p, "w") as fh:
        fh.write("config:\n  region: local-1\n  check_cloudtrail: false\n\npermissions:\n  acm:\n    - ListCertificates\n  s3:\n    # a comment\n    - ListBuckets\n    - GetBucketPolicy\n")
    pairs, missing = load_permissions(spark, p, ["s3", "athena"])
    assert sorted(r.permission for r in pairs.collect()) == ["GetBucketPolicy", "ListBuckets"]
    assert [r.service for r in missing.collect()] == ["athena"]
    assert load_config(spark, p) == {"region": "local-1", "check_cloudtrail": False}
    assert tuple(counts(load_permissions(spark, p)[0]).first()) == (3, 2)


def test_load_patterns_then_expand(spark, tmp_dir):
    from veilgrid.operators.lookup import expand_patterns
    from veilgrid.sources.permissions import load_patterns, permissions_frame

    p = f"{tmp_dir}/patterns.tsv"
    with open(p, "w") as fh:
        fh.write("ec2\tDescribe*\ns3\tListBuckets\nkms\tList*\n")
    pats = load_patterns(spark, p)
    actions = permissions_frame(spark, {"ec2": ["DescribeInstances", "RunInstances"], "s3": ["ListBuckets", "ListObjects"], "kms": ["ListKeys", "ListAliases"]})
    got = sorted((r.service, r.pattern, r.permission) for r in expand_patterns(actions, pats).collect())
    assert got == [
        ("ec2", "Describe*", "DescribeInstances"),
        ("kms", "List*", "ListAliases"),
        ("kms", "List*", "ListKeys"),
        ("s3", "ListBuckets", "ListBuckets"),
    ]


def test_append_by_name_refuses_unknown_columns(spark, tmp_dir):
    from veilgrid.sources.catalog import append_by_name, create_database, create_table

    create_database(spark, "n_db")
    create_table(spark, "n_db.t", "a int, b string", f"{tmp_dir}/t")
    with pytest.raises(ValueError, match="bb"):
        append_by_name(spark.createDataFrame([(1, "x", "y")], "a int, bb string, c string"), "n_db.t")
    append_by_name(spark.createDataFrame([("x", 1)], "B string, a int"), "n_db.t")
    append_by_name(spark.createDataFrame([(2,)], "a int"), "n_db.t")
    assert sorted(map(tuple, spark.table("n_db.t").collect())) == [(1, "x"), (2, None)]


def test_size_check_is_a_number_and_hints_a_broadcast(spark):
    from veilgrid.functions.joins import broadcast_if_small, estimated_bytes, values_frame

    small = values_frame(spark, [("a", ["x", "y"]), ("b", None)], "k string, v array<string>")
    assert sorted((r.k, r.v) for r in small.collect()) == [("a", ["x", "y"]), ("b", None)]
    assert 0 < estimated_bytes(small) < 10_000
    assert estimated_bytes(spark.createDataFrame([("a",)], "k string")) > 1 << 60  # an RDD scan's size is unknown
    big = spark.range(10_000_000).select(F.col("id").cast("string").alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = big.join(broadcast_if_small(small), "k")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan
        plan = big.join(broadcast_if_small(big.withColumnRenamed("k", "k")), "k")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shared_folder_is_required_off_local_mode():
    from types import SimpleNamespace

    from veilgrid.session import checkpoint_dir

    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: d)))


def _allowed(statements, action, resource):
    """A request for one object, judged by fnmatch: any Deny wins."""
    from fnmatch import fnmatchcase

    hit = lambda e: any(
        s[0] == e and any(fnmatchcase(action.lower(), a.lower()) for a in s[1]) and any(fnmatchcase(resource, r) for r in s[2]) for s in statements
    )
    return hit("Allow") and not hit("Deny")


def test_bypass_follows_deny_and_wildcards(spark):
    """Against single objects: a role is found if and only if it may read one of the location's objects."""
    cases = {
        "plain": [("Allow", ["s3:GetObject"], ["b-nav/*"])],
        "get_star": [("Allow", ["s3:Get*"], ["b-nav/t*/wp/*"])],
        "deny_all": [("Allow", ["s3:*"], ["*"]), ("Deny", ["s3:*"], ["*"])],
        "deny_place": [("Allow", ["*"], ["*"]), ("Deny", ["S3:GETOBJECT"], ["b-nav/tables/*"])],
        "deny_part": [("Allow", ["s3:GetObject"], ["b-nav/tables/wp/*"]), ("Deny", ["s3:GetObject"], ["b-nav/tables/wp/p1*"])],
        "deny_what_is_allowed": [("Allow", ["s3:GetObject"], ["b-nav/tables/wp/p1*"]), ("Deny", ["s3:Get*"], ["b-nav/tables/wp/p*"])],
        "deny_elsewhere": [("Allow", ["s3:GetObject"], ["b-nav/*"]), ("Deny", ["s3:GetObject"], ["b-other/*"])],
        "deny_write": [("Allow", ["s3:GetObject"], ["b-nav/*"]), ("Deny", ["s3:Put*"], ["*"])],
        "write_only": [("Allow", ["s3:PutObject"], ["*"])],
        "narrow": [("Allow", ["s3:GetObject"], ["b-nav/tables/wp/p2.csv"])],
        "beside": [("Allow", ["s3:GetObject"], ["b-nav/tables/wp2/*", "b-nav/tables/w"])],
        "only_place": [("Allow", ["s3:GetObject"], ["b-nav/tables/wp"])],
        "suffix": [("Allow", ["s3:GetObject"], ["*.csv"]), ("Deny", ["s3:GetObject"], ["*.csv"])],
        "suffix_open": [("Allow", ["s3:GetObject"], ["*.csv"]), ("Deny", ["s3:GetObject"], ["*1.csv"])],
    }
    flat = flatten_policies(spark.createDataFrame(list(cases.items()), POLICY_SCHEMA))
    visible = spark.createDataFrame([(r, "nav", "wp", False) for r in cases], "role string, database string, table string, full_table boolean")
    locs = spark.createDataFrame([("nav", "wp", "b-nav/tables/wp")], "database string, table string, location string")
    got = {r.role for r in bypass_findings(flat, visible, locs).collect()}
    objects = [f"b-nav/tables/wp/{x}" for x in ("p1.csv", "p2.csv", "q", "p3", "x/y.csv")]
    assert got == {r for r, st in cases.items() if any(_allowed(st, "s3:GetObject", o) for o in objects)}


def test_reachable_to_the_end(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 6}") for i in range(6)] + [("r3", "x"), ("x", "y"), ("y", "x"), ("lone", "lone"), (None, "r0"), ("y", None)]
    edges = spark.createDataFrame(ring, "src string, dst string")
    got = {(r.src, r.dst): r.hops for r in reachable_roles(edges, max_hops=None).collect()}
    assert got["r4", "r3"] == 5 and got["r0", "y"] == 5 and got["r4", "y"] == 7 and ("lone", "lone") not in got and ("r0", "r0") not in got
    assert len(got) == 30 + 12 + 2
    with pytest.raises(RuntimeError):
        reachable_roles(edges, max_hops=None, max_rounds=3)
