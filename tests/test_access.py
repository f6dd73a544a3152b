"""Governed access (P1–P4, G1–G11, G16, V1-style goldens) on the FIXTURES tables."""

import pytest
from pyspark.sql import functions as F

from tests.fixtures import EXPECTED_VISIBLE, POLICY, fixture_tables, policy_rows
from veilgrid.functions.scalars import categorize
from veilgrid.operators.access import (
    PUBLIC,
    AccessDenied,
    Governor,
    allowed_columns,
    catalog_columns,
    effective_columns,
    grant,
    grant_conflicts,
    grant_write,
    grants_frame,
    revoke,
    visible_databases,
)

ROLES = ["DataScientist", "FlightRadarViewer", "AeroNav", "AeroWeather", "AeroTraffic"]


@pytest.fixture(scope="module")
def gov(spark):
    tables = fixture_tables(spark)
    return Governor(spark, tables, grants_frame(spark, policy_rows(tables)), roles=ROLES)


def test_visible_counts_match_policy(gov):
    for table, (n_vis, n_all) in EXPECTED_VISIBLE.items():
        role, hidden = POLICY[table]
        assert len(gov.visible(role, table)) == n_vis
        assert len(gov.visible("DataScientist", table)) == n_all
        assert sorted(gov.hidden(role, table)) == sorted(hidden)


def test_visible_and_hidden_partition_the_columns(gov):
    for table in EXPECTED_VISIBLE:
        role, _ = POLICY[table]
        vis, hid = set(gov.visible(role, table)), set(gov.hidden(role, table))
        assert vis | hid == set(gov.tables[table].columns)
        assert not (vis & hid)
        # Table order is kept.
        assert gov.visible(role, table) == [c for c in gov.tables[table].columns if c in vis]


def test_select_star_expands_after_policy(gov):
    v = gov.select("FlightRadarViewer", "flightradar_db.radar_detections", "*")
    assert "speed_knots" not in v.columns and len(v.columns) == 11
    assert v.count() == 5
    full = gov.select("DataScientist", "flightradar_db.radar_detections", "*")
    assert len(full.columns) == 13


def test_hidden_column_denied_everywhere(gov):
    t = "flightradar_db.radar_detections"
    with pytest.raises(AccessDenied) as e:
        gov.select("FlightRadarViewer", t, ["flight_id", "speed_knots"])
    assert e.value.column == "speed_knots"
    with pytest.raises(AccessDenied):
        gov.select("FlightRadarViewer", t, [F.col("heading_degrees") + 1])
    for q in [
        "SELECT speed_knots FROM {radar_detections}",
        "SELECT flight_id FROM {radar_detections} WHERE speed_knots > 400",
        "SELECT flight_id FROM {radar_detections} ORDER BY heading_degrees",
        "SELECT flight_id, CASE WHEN speed_knots > 400 THEN 'Fast' ELSE 'Normal' END FROM {radar_detections}",
    ]:
        with pytest.raises(AccessDenied):
            gov.sql("FlightRadarViewer", q)
    # The same statements work for the full-access role.
    assert gov.sql("DataScientist", "SELECT flight_id FROM {radar_detections} WHERE speed_knots > 400").count() == 4


def test_returned_frames_are_closed(gov):
    """What a role gets back does not lead to a hidden column in later calls either."""
    from pyspark.errors import AnalysisException

    t = "flightradar_db.radar_detections"
    frames = [
        gov.view("FlightRadarViewer", t),
        gov.select("FlightRadarViewer", t, "*"),
        gov.select("FlightRadarViewer", t, ["flight_id"]),
        gov.sql("FlightRadarViewer", "SELECT flight_id FROM {radar_detections}"),
    ]
    for df in frames:
        assert df.filter("flight_id is not null").count() == 5
        for later in (lambda d: d.filter("speed_knots > 0"), lambda d: d.where(F.col("speed_knots") > 0), lambda d: d.orderBy("speed_knots"), lambda d: d.select("speed_knots")):
            with pytest.raises(AnalysisException):
                later(df).collect()
    with pytest.raises(AccessDenied):
        gov.select("FlightRadarViewer", t, ["SPEED_KNOTS"])
    with pytest.raises(AccessDenied):
        gov.sql("FlightRadarViewer", "SELECT Speed_Knots FROM {radar_detections}")


def test_sql_reads_placeholders_only(spark, gov, tmp_dir):
    spark.range(3).write.parquet(f"{tmp_dir}/p")
    spark.range(3).createOrReplaceTempView("loose_view")
    refused = [
        f"SELECT * FROM parquet.`{tmp_dir}/p`",
        "SELECT * FROM loose_view",
        "SELECT flight_id FROM {radar_detections} WHERE flight_id IN (SELECT id FROM loose_view)",
        "WITH x AS (SELECT * FROM loose_view) SELECT * FROM x",
        "SELECT * FROM {radar_detections} r JOIN loose_view v ON true",
        "DROP VIEW loose_view",
        "CREATE TABLE stolen AS SELECT * FROM {radar_detections}",
        "INSERT INTO loose_view SELECT 1",
        "WITH x AS (SELECT 1) INSERT INTO loose_view SELECT * FROM x",
        "SET a = b",
        "SHOW TABLES",
        "SELECT * FROM range(3)",
    ]
    for q in refused:
        with pytest.raises(AccessDenied):
            gov.sql("FlightRadarViewer", q)
    assert spark.catalog.tableExists("loose_view")
    ok = "WITH x AS (SELECT flight_id FROM {radar_detections}) SELECT count(*) AS n FROM x WHERE flight_id IN (SELECT flight_id FROM {radar_detections}) UNION ALL SELECT 1 ORDER BY n LIMIT 5"
    assert sorted(r.n for r in gov.sql("FlightRadarViewer", ok).collect()) == [1, 5]
    assert gov.sql("FlightRadarViewer", "SELECT {x} AS c, flight_id FROM {radar_detections}", x=7).first().c == 7


def test_ambiguous_table_name_raises(spark):
    frames = {"a.t": spark.range(1), "b.t": spark.range(1)}
    gov = Governor(spark, frames, grants_frame(spark, [("r", "a", "t", None, ["SELECT"]), ("r", "b", "t", None, ["SELECT"])]))
    with pytest.raises(ValueError, match="ambiguous"):
        gov.sql("r", "SELECT * FROM {t}")


def test_count_star_allowed(gov):
    assert gov.sql("FlightRadarViewer", "SELECT COUNT(*) AS n FROM {radar_detections}").first()["n"] == 5


def test_table_not_granted_denied(gov):
    with pytest.raises(AccessDenied):
        gov.select("FlightRadarViewer", "aeronav_db.navigation_waypoints")
    with pytest.raises(AccessDenied):
        gov.sql("AeroNav", "SELECT * FROM {radar_detections}")
    with pytest.raises(AccessDenied):
        gov.select("AeroNav", "nosuch_db.nosuch_table")


def test_speed_category_golden(gov):
    v = gov.select("DataScientist", "flightradar_db.radar_detections", "*")
    got = {r["flight_id"]: r["c"] for r in v.select("flight_id", categorize("speed_knots", 400).alias("c")).collect()}
    assert got == {"FL001": "Fast", "FL002": "Fast", "FL003": "Fast", "FL004": "Normal", "FL005": "Fast"}
    # NULL → Normal
    assert v.select(categorize(F.lit(None).cast("double"), 400).alias("c")).first()["c"] == "Normal"


def test_like_underscore_is_single_char_wildcard(spark):
    df = spark.createDataFrame([("WP_POC_001",), ("WPXPOCX004",), ("WP001",), ("WP_POC",)], "w string")
    got = sorted(r.w for r in df.filter(F.col("w").like("WP_POC_%")).collect())
    assert got == ["WPXPOCX004", "WP_POC_001"]


def test_hidden_column_not_read_from_parquet(spark, tmp_dir):
    tables = fixture_tables(spark)
    path = f"{tmp_dir}/radar"
    tables["flightradar_db.radar_detections"].write.parquet(path)
    scan = {"flightradar_db.radar_detections": spark.read.parquet(path)}
    g = Governor(spark, scan, grants_frame(spark, policy_rows(tables)), roles=ROLES)
    plan = g.view("FlightRadarViewer", "flightradar_db.radar_detections")._jdf.queryExecution().executedPlan().toString()
    read_schema = plan[plan.index("ReadSchema") :]
    assert "speed_knots" not in read_schema and "heading_degrees" not in read_schema
    assert "flight_id" in read_schema


def test_full_grant_wins_and_conflict_listed(spark):
    tables = fixture_tables(spark)
    grants = grants_frame(spark, policy_rows(tables, conflict=True))
    g = Governor(spark, tables, grants, roles=ROLES)
    assert len(g.visible("FlightRadarViewer", "flightradar_db.radar_detections")) == 13
    conflicts = [tuple(r) for r in grant_conflicts(grants).collect()]
    assert conflicts == [("FlightRadarViewer", "flightradar_db", "radar_detections")]


def test_union_of_column_lists(spark):
    tables = fixture_tables(spark)
    cat = catalog_columns(spark, tables)
    grants = grants_frame(spark, [("r", "aeronav_db", "flight_routes", ["route_id"], ["SELECT"])])
    grants = grant(grants, "r", "aeronav_db", "flight_routes", ["route_name", "route_id", "no_such_col"])
    eff = effective_columns(grants, cat).collect()
    assert len(eff) == 1 and eff[0]["columns"] == ["route_id", "route_name"] and not eff[0]["full_table"]


def test_public_grant_reaches_every_role(spark):
    tables = fixture_tables(spark)
    grants = grants_frame(spark, [(PUBLIC, "aeronav_db", "flight_routes", None, ["SELECT"])])
    eff = effective_columns(grants, catalog_columns(spark, tables), roles=["a", "b"])
    assert sorted(r["role"] for r in eff.collect()) == ["a", "b"]


def test_revoke_matches_database_and_table(spark):
    grants = grants_frame(
        spark,
        [
            ("IAM_ALLOWED", "aeronav_db", "flight_routes", None, ["ALL"]),
            ("IAM_ALLOWED", "aeronav_db", "navigation_waypoints", None, ["ALL"]),
            ("AeroNav", "aeronav_db", "flight_routes", None, ["SELECT"]),
        ],
    )
    rev = spark.createDataFrame([("IAM_ALLOWED", "aeronav_db", "flight_routes")], "role string, database string, table string")
    left = sorted((r.role, r.table) for r in revoke(grants, rev).collect())
    assert left == [("AeroNav", "flight_routes"), ("IAM_ALLOWED", "navigation_waypoints")]


def test_visible_databases(spark):
    tables = fixture_tables(spark)
    grants = grants_frame(spark, policy_rows(tables))
    dbs = spark.createDataFrame([(d,) for d in ["flightradar_db", "aeronav_db", "aeroweather_db", "aerotraffic_db"]], "database string")
    assert sorted(r.database for r in visible_databases(grants, dbs, "AeroNav").collect()) == ["aeronav_db"]
    assert visible_databases(grants, dbs, "DataScientist").count() == 4


def test_grant_write_first_existing_candidate(spark):
    grants = grants_frame(spark, [])
    cat = spark.createDataFrame([("db", "b"), ("db", "c")], "database string, table string")
    out = grant_write(grants, "DataScientist", [("db", "a"), ("db", "c"), ("db", "b")], cat).collect()
    assert [(r.table, r.permissions) for r in out] == [("c", ["INSERT", "ALTER"])]


def test_allowed_columns_keeps_order(spark):
    df = spark.createDataFrame([(["a", "b", "c", "b"], ["b"])], "all array<string>, r array<string>")
    assert df.select(allowed_columns(F.col("all"), F.col("r")).alias("x")).first().x == ["a", "c"]


def test_role_schema_views(spark, tmp_dir):
    from veilgrid.sources.catalog import create_database, create_table

    tables = fixture_tables(spark)
    df = tables["flightradar_db.radar_detections"]
    create_database(spark, "flightradar_db")
    create_table(spark, "flightradar_db.radar_detections", df.schema, f"{tmp_dir}/radar", {"table_type": "ICEBERG"})
    df.write.insertInto("flightradar_db.radar_detections")
    cat_tables = {"flightradar_db.radar_detections": spark.table("flightradar_db.radar_detections")}
    g = Governor(spark, cat_tables, grants_frame(spark, policy_rows(tables)), roles=ROLES)
    made = g.create_role_schema("FlightRadarViewer", "flightradarviewer_alias")
    assert made == ["flightradarviewer_alias.radar_detections"]
    v = spark.table("flightradarviewer_alias.radar_detections")
    assert len(v.columns) == 11 and v.count() == 5
    with pytest.raises(Exception):
        spark.sql("SELECT speed_knots FROM flightradarviewer_alias.radar_detections").collect()


def test_like_prefix_rewrite_is_exact(spark):
    import random
    import re

    from veilgrid.functions.scalars import like

    rnd = random.Random(5)
    alphabet = "WP_OC%x1"
    strings = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 8))) for _ in range(1500)]
    patterns = ["WP_POC_%", "WP%", "W_P%", "%POC%", "WP", "WP_%_1", "x%", "_%", "WPxPOC"]
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    sel = df.select("s", *[like("s", p).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()

    def py_like(s, p):
        rx = "".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in p)
        return re.fullmatch(rx, s, flags=re.S) is not None

    for r in sel:
        for i, p in enumerate(patterns):
            assert r[f"p{i}"] == py_like(r.s, p), (r.s, p)


def test_governed_append_needs_insert_and_writes_all_columns(spark, tmp_dir):
    from veilgrid.operators.access import governed_append
    from veilgrid.sources.catalog import create_database, create_table

    create_database(spark, "w_db")
    create_table(spark, "w_db.t", "a string, hidden string", f"{tmp_dir}/t")
    grants = grants_frame(
        spark,
        [("viewer", "w_db", "t", ["a"], ["SELECT"]), ("writer", "w_db", "t", ["a"], ["SELECT", "INSERT"])],
    )
    rows = spark.createDataFrame([("x", "secret")], "a string, hidden string")
    with pytest.raises(AccessDenied):
        governed_append(grants, "viewer", "w_db.t", rows)
    governed_append(grants, "writer", "w_db.t", rows)
    assert [tuple(r) for r in spark.table("w_db.t").collect()] == [("x", "secret")]
    with pytest.raises(ValueError, match="other"):
        governed_append(grants, "writer", "w_db.t", spark.createDataFrame([("x", 1)], "a string, other int"))


@pytest.mark.parametrize(
    "sql",
    [
        "WITH raw_t AS (SELECT * FROM raw_t) SELECT secret FROM raw_t",
        "WITH `sales_db.t` AS (SELECT 1 x) SELECT secret FROM sales_db.t",
        "SELECT secret FROM raw_t WHERE 1 IN (WITH raw_t AS (SELECT 1 x) SELECT x FROM raw_t)",
        "SELECT * FROM (WITH raw_t AS (SELECT 1 x) SELECT x FROM raw_t) JOIN raw_t",
        "WITH a AS (SELECT * FROM b), b AS (SELECT 1 x) SELECT * FROM a",
        "WITH a AS (WITH raw_t AS (SELECT 1 x) SELECT x FROM raw_t) SELECT secret FROM raw_t, a",
        "WITH RECURSIVE raw_t AS (SELECT secret FROM raw_t) SELECT * FROM raw_t",
        "SELECT (SELECT max(secret) FROM raw_t) AS s FROM {t}",
        "SELECT x FROM {t} UNION ALL SELECT secret FROM raw_t",
    ],
)
def test_cte_names_open_no_base_table(spark, sql):
    base = spark.createDataFrame([(1, "s3cret")], "x int, secret string")
    base.createOrReplaceTempView("raw_t")
    base.createOrReplaceTempView("b")
    try:
        gov = Governor(spark, {"sales_db.t": base}, grants_frame(spark, [("r", "sales_db", "t", ["x"], ["SELECT"])]), roles=["r"])
        with pytest.raises(AccessDenied):
            gov.sql("r", sql)
    finally:
        spark.catalog.dropTempView("raw_t")
        spark.catalog.dropTempView("b")


def test_cte_scopes_that_are_right(spark):
    base = spark.createDataFrame([(1, "s"), (2, "s")], "x int, secret string")
    gov = Governor(spark, {"sales_db.t": base}, grants_frame(spark, [("r", "sales_db", "t", ["x"], ["SELECT"])]), roles=["r"])
    for sql in (
        "WITH a AS (SELECT x FROM {t}), b AS (SELECT x FROM A) SELECT x FROM b WHERE x IN (SELECT x FROM a)",
        "WITH a AS (WITH c AS (SELECT x FROM {t}) SELECT x FROM c) SELECT x FROM a",
        "WITH a AS (SELECT x FROM {t}) SELECT x FROM (WITH a AS (SELECT x FROM a) SELECT x FROM a)",
    ):
        assert sorted(r.x for r in gov.sql("r", sql).collect()) == [1, 2], sql
