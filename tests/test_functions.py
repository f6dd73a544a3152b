"""Scalar helpers of SURVEY §2.8."""

import json

from pyspark.sql import functions as F

from veilgrid.functions import scalars as S
from veilgrid.operators.audit import ts_literal


def test_string_and_map_helpers(spark):
    df = spark.createDataFrame(
        [("arn:aws:iam::000000000000:role/DataScientist", {"s3": "s3", "logs": "cloudwatch-logs"}, "None", "x" * 120)],
        "arn string, m map<string,string>, v string, long_text string",
    )
    r = df.select(
        S.last_path_part("arn").alias("last"),
        S.identity_type("arn").alias("kind"),
        S.map_get_default("m", "logs", "?").alias("hit"),
        S.map_get_default("m", "ec2", F.lit("ec2")).alias("miss"),
        S.default_if_blank("v", "aeronav_db").alias("dflt"),
        S.truncate("long_text", 50).alias("t50"),
        S.contains_any(F.lit("Column SPEED_KNOTS not found"), ["speed_knots"]).alias("kw"),
    ).first()
    assert (r.last, r.kind, r.hit, r.miss, r.dflt, len(r.t50), r.kw) == ("DataScientist", "IAM Role", "cloudwatch-logs", "ec2", "aeronav_db", 50, True)


def test_time_and_json_helpers(spark):
    df = spark.createDataFrame([(1, None, 2.5)], "k int, v string, x double").withColumn("ts", ts_literal("2024-01-15 10:30:00"))
    r = df.select(
        S.minutes_before("ts", 60).alias("before"),
        F.date_format("ts", "yyyyMMdd_HHmmss").alias("export_stamp"),
        F.date_format("ts", "yyyyMMdd-HHmmss").alias("report_stamp"),
        S.row_json(["k", "v", "x"]).alias("j"),
    ).first()
    assert str(r.before) == "2024-01-15 09:30:00"
    assert (r.export_stamp, r.report_stamp) == ("20240115_103000", "20240115-103000")
    assert json.loads(r.j) == {"k": 1, "v": None, "x": 2.5}


def test_distinctness_and_padding(spark):
    df = spark.createDataFrame([(1, 1, None, None, "", "7"), (1, 2, "a", None, "12", None)], "a int, b int, c string, d string, p string, q string")
    got = [
        tuple(r)
        for r in df.select(
            S.distinct_from("a", "b"),
            S.distinct_from("c", "d"),
            S.rows_distinct([F.col("a"), F.col("c")], [F.col("b"), F.col("d")]),
            S.padded_increment("p", 4),
            S.padded_increment("q", 6),
            S.flip("q", "Y", "N"),
        ).collect()
    ]
    assert got == [(False, False, False, "000004", "000013", "Y"), (True, True, True, "000016", "000006", "Y")]
