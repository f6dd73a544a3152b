"""Verification reports V1–V10."""

from pyspark.sql import functions as F

from tests.fixtures import POLICY, fixture_tables, policy_rows
from veilgrid.operators.access import catalog_columns, effective_columns, grants_frame, hidden_columns
from veilgrid.operators.checks import (
    access_matrix,
    check_column_counts,
    check_property,
    classify_failure,
    compare_roles,
    missing_objects,
    preview,
    restricted_status,
    row_count,
    summarize,
    visible_fraction,
)

ROLES = ["DataScientist", "FlightRadarViewer", "AeroNav", "AeroWeather", "AeroTraffic"]


def _effective(spark):
    tables = fixture_tables(spark)
    cat = catalog_columns(spark, tables)
    return tables, cat, effective_columns(grants_frame(spark, policy_rows(tables)), cat, ROLES)


def test_column_counts_13_and_11(spark):
    _, _, eff = _effective(spark)
    expected = spark.createDataFrame(
        [("DataScientist", "flightradar_db", "radar_detections", 13), ("FlightRadarViewer", "flightradar_db", "radar_detections", 11), ("AeroNav", "flightradar_db", "radar_detections", 11)],
        "role string, database string, table string, expected_count int",
    )
    got = {(r.role): (r.actual_count, r.matches) for r in check_column_counts(eff, expected).collect()}
    assert got == {"DataScientist": (13, True), "FlightRadarViewer": (11, True), "AeroNav": (0, False)}


def test_restricted_status_words(spark):
    df = spark.createDataFrame(
        [("FULL", ["a", "h"]), ("FULL", ["a"]), ("RESTRICTED", ["a"]), ("RESTRICTED", ["a", "h"])],
        "exp string, cols array<string>",
    )
    got = [r.s for r in df.select(restricted_status(F.col("exp"), F.col("cols"), F.array(F.lit("h"))).alias("s")).collect()]
    assert got == ["EXPECTED", "NOTE", "CORRECT", "UNEXPECTED"]


def test_access_matrix_roles_by_database(spark):
    _, _, eff = _effective(spark)
    expectations = spark.createDataFrame(
        [
            ("DataScientist", ["flightradar_db", "aeronav_db"], "FULL"),
            ("FlightRadarViewer", ["flightradar_db"], "RESTRICTED"),
            ("AeroNav", ["aeronav_db", "aeroweather_db"], "RESTRICTED"),
        ],
        "role string, databases array<string>, expected_access string",
    )
    restricted = spark.createDataFrame(
        [(t.split(".")[0], t.split(".")[1], list(h)) for t, (_, h) in POLICY.items()],
        "database string, table string, restricted array<string>",
    )
    m = {(r.role, r.database, r.table): r.status for r in access_matrix(expectations, eff, restricted).collect()}
    assert m[("DataScientist", "flightradar_db", "radar_detections")] == "EXPECTED"
    assert m[("FlightRadarViewer", "flightradar_db", "radar_detections")] == "CORRECT"
    assert m[("AeroNav", "aeronav_db", "flight_routes")] == "CORRECT"
    assert m[("AeroNav", "aeroweather_db", None)] == "NO_ACCESS"


def test_missing_objects_skips_tables_of_missing_db(spark):
    expected = spark.createDataFrame(
        [("aeronav_db", ["navigation_waypoints", "flight_routes"]), ("aerotraffic_db", ["air_traffic_control"])],
        "database string, tables array<string>",
    )
    catalog = spark.createDataFrame([("aeronav_db", "navigation_waypoints")], "database string, table string")
    got = sorted((r.kind, r.database, r.table, r.status) for r in missing_objects(expected, catalog).collect())
    assert got == [
        ("database", "aeronav_db", None, "Found"),
        ("database", "aerotraffic_db", None, "Missing"),
        ("table", "aeronav_db", "flight_routes", "Missing"),
        ("table", "aeronav_db", "navigation_waypoints", "Found"),
    ]


def test_property_and_summary(spark):
    t = spark.createDataFrame(
        [("d", "a", {"table_type": "iceberg"}), ("d", "b", {}), ("d", "c", {"table_type": "HIVE"})],
        "database string, table string, properties map<string,string>",
    )
    checked = check_property(t, "table_type", "ICEBERG")
    got = {r.table: (r.property_value, r.ok) for r in checked.collect()}
    assert got == {"a": ("iceberg", True), "b": ("Unknown", False), "c": ("HIVE", False)}
    s = summarize(checked).first()
    assert (s.ok_count, s.error_count, s.total_count, s.verdict) == (1, 2, 3, "ISSUES")


def test_classify_failure(spark):
    df = spark.createDataFrame(
        [("Column 'SPEED_KNOTS' cannot be resolved", True), ("timeout", True), ("speed_knots missing", False)],
        "err string, restricted boolean",
    )
    got = [r.c for r in df.select(classify_failure(F.col("err"), ["speed_knots", "heading_degrees"], F.col("restricted")).alias("c")).collect()]
    assert got == ["EXPECTED_DENIAL", "FAILURE", "FAILURE"]


def test_compare_roles_and_fraction(spark):
    _, cat, eff = _effective(spark)
    facts = hidden_columns(eff, cat).filter(F.col("table") == "radar_detections")
    rows = {r.role: r for r in compare_roles(facts).collect()}
    assert rows["DataScientist"].column_count == 13 and rows["DataScientist"].access_level == "Full access"
    assert rows["FlightRadarViewer"].restrictions == "Cannot see speed_knots, heading_degrees"
    txt = facts.filter(F.col("role") == "FlightRadarViewer").select(visible_fraction(F.col("n_visible"), F.col("n_total")).alias("t")).first().t
    assert txt == "11/13 columns visible"


def test_preview_and_count(spark):
    tables = fixture_tables(spark)
    df = tables["flightradar_db.radar_detections"].select("flight_id", "speed_knots", "track")
    rows = preview(df.union(spark.createDataFrame([("FL000", None, None)], df.schema)), 2, ["flight_id"]).collect()
    assert [tuple(r) for r in rows] == [("FL000", "NULL", "NULL"), ("FL001", "450.50", "90")]
    assert row_count(df).first().row_count == 5


def test_check_restricted_lists_exposed_columns(spark):
    from veilgrid.operators.checks import check_restricted

    df = spark.createDataFrame(
        [("RESTRICTED", ["a", "speed_knots"], ["speed_knots", "heading_degrees"]), ("RESTRICTED", ["a"], ["speed_knots"])],
        "expected_access string, columns array<string>, restricted array<string>",
    )
    got = [(r.status, r.exposed) for r in check_restricted(df).collect()]
    assert got == [("UNEXPECTED", ["speed_knots"]), ("CORRECT", [])]


def test_access_matrix_five_roles_eight_pairs(spark):
    """The verification matrix of SURVEY §5: 5 roles, 8 role × database pairs, one test table per database."""
    _, _, eff = _effective(spark)
    dbs = ["flightradar_db", "aeronav_db", "aeroweather_db", "aerotraffic_db"]
    expectations = spark.createDataFrame(
        [("DataScientist", dbs, "FULL")] + [(r, [d], "RESTRICTED") for r, d in zip(ROLES[1:], dbs, strict=True)],
        "role string, databases array<string>, expected_access string",
    )
    test_tables = {"radar_detections", "navigation_waypoints", "weather_observations", "air_traffic_control"}
    restricted = spark.createDataFrame(
        [(t.split(".")[0], t.split(".")[1], list(h)) for t, (_, h) in POLICY.items()],
        "database string, table string, restricted array<string>",
    )
    m = access_matrix(expectations, eff, restricted).filter(F.col("table").isin(*test_tables))
    got = sorted((r.role, r.database, r.status) for r in m.collect())
    assert len(got) == 8
    assert [s for r, _, s in got if r == "DataScientist"] == ["EXPECTED"] * 4
    assert all(s == "CORRECT" for r, _, s in got if r != "DataScientist")


def test_run_scenarios_like_the_demo(spark):
    from veilgrid.operators.access import Governor
    from veilgrid.operators.checks import run_scenarios

    tables = fixture_tables(spark)
    gov = Governor(spark, tables, grants_frame(spark, policy_rows(tables)), roles=ROLES)
    t = "{radar_detections}"
    scenarios = [
        ("all_ds", "DataScientist", f"SELECT * FROM {t} LIMIT 2"),
        ("all_viewer", "FlightRadarViewer", f"SELECT * FROM {t} LIMIT 2"),
        ("cols_viewer", "FlightRadarViewer", f"SELECT flight_id, altitude_feet FROM {t}"),
        ("hidden_viewer", "FlightRadarViewer", f"SELECT flight_id, speed_knots FROM {t}"),
        ("other_db", "FlightRadarViewer", "SELECT * FROM {navigation_waypoints} LIMIT 2"),
    ]
    restricted = {n: ["speed_knots", "heading_degrees"] for n, _, _ in scenarios}
    access = {"DataScientist": "FULL", "FlightRadarViewer": "RESTRICTED"}
    got = {r.name: (r.success, r.n_columns, r.row_count, r.status) for r in run_scenarios(gov, scenarios, access, restricted).collect()}
    assert got["all_ds"] == (True, 13, 2, "EXPECTED")
    assert got["all_viewer"] == (True, 11, 2, "CORRECT")
    assert got["cols_viewer"] == (True, 2, 5, "CORRECT")
    assert got["hidden_viewer"][0] is False and got["hidden_viewer"][3] == "EXPECTED_DENIAL"
    assert got["other_db"][0] is False and got["other_db"][3] == "FAILURE"
