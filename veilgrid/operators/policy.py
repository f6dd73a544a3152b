"""Policy graph: role reachability, policy flattening, bucket-bypass lint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgrid.functions.joins import broadcast_if_small
from veilgrid.operators.lookup import wildcard_to_like
from veilgrid.session import scratch_root

POLICY_SCHEMA = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField(
            "statements",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("effect", T.StringType()),
                        T.StructField("actions", T.ArrayType(T.StringType())),
                        T.StructField("resources", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
    ]
)


def reachable_roles(edges: DataFrame, max_hops: int | None = 2, max_rounds: int = 200) -> DataFrame:
    """``(src, dst, hops)`` for every role reachable by assume-role steps, with the fewest steps.

    Semi-naive: a round extends only the pairs that the last one found, by an
    equi join on the role, and an anti join drops the pairs known already, so
    cycles end. Rounds go on until ``max_hops``, or with None until nothing
    is new; more than ``max_rounds`` rounds are an error, never a cut. Each round is
    written below the shared folder, so the plan does not grow. A role is not
    listed as reaching itself; null ends of an edge lead nowhere.
    """
    spark = edges.sparkSession
    root = scratch_root(spark, "reachable")

    def kept(df: DataFrame, hop: int) -> DataFrame:
        df.write.parquet(f"{root}/hops={hop}")
        return spark.read.parquet(f"{root}/hops={hop}")

    e = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    e.write.parquet(f"{root}-edges")
    e = spark.read.parquet(f"{root}-edges")
    frontier = kept(e.filter("src <> dst"), 1)
    hop = 1
    while hop != max_hops and not frontier.isEmpty():
        hop += 1
        if hop > max_rounds:
            raise RuntimeError(f"roles reach further than {max_rounds} steps")
        known = spark.read.parquet(root).select("src", "dst")
        step = frontier.withColumnRenamed("dst", "via").join(e.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst")
        frontier = kept(step.filter("src <> dst").distinct().join(known, ["src", "dst"], "left_anti"), hop)
    return spark.read.schema(T.StructType([*e.schema.fields, T.StructField("hops", T.IntegerType())])).parquet(root)


def flatten_policies(policies: DataFrame) -> DataFrame:
    """Nested statements → one row per (role, effect, action, resource)."""
    s = policies.select("role", F.explode("statements").alias("s"))
    return s.select(
        "role",
        F.col("s.effect").alias("effect"),
        F.explode("s.actions").alias("action"),
        F.col("s.resources").alias("_res"),
    ).select("role", "effect", "action", F.explode("_res").alias("resource"))


def _before_star(pattern):
    return F.regexp_extract(pattern, r"^[^*]*", 0)


def covers(pattern, text):
    """Every string of the glob ``text`` is one of the glob ``pattern``: the pattern matches it, its stars taken as characters."""
    return F.like(text, wildcard_to_like(pattern))


def action_matches(action, pattern):
    """Action patterns hold wildcards and know no case."""
    return F.like(F.lower(action), wildcard_to_like(F.lower(pattern)))


def permitted(flat: DataFrame, requests: DataFrame) -> DataFrame:
    """G14's evaluation: the requests (role, action, resource, ...) that a policy allows and none denies.

    ``flat`` from ``flatten_policies``. ``resource`` is a place: the request asks
    for the objects below it. An Allow meets it if some object below it is named
    by the Allow's resource pattern; ``reach`` is the pattern of these objects.
    An explicit Deny wins if its patterns hold the action and all of ``reach``.
    Both joins are by role, so no policy is compared with another role's.
    """
    r = requests.withColumn("_at", F.concat(F.col("resource"), F.lit("/")))
    allow = flat.filter(F.col("effect") == "Allow").select("role", F.col("action").alias("_a"), F.col("resource").alias("allowed_by"))
    start = _before_star(F.col("allowed_by"))
    has_star = F.length(start) < F.length("allowed_by")
    # The place lies below the pattern's fixed start, or the pattern names objects below the place.
    below, within = F.startswith(F.col("_at"), start) & has_star, F.startswith(start, F.col("_at"))
    met = r.join(allow, "role").filter(action_matches(F.col("action"), F.col("_a")) & (below | within))
    rest = F.substr(F.col("allowed_by"), F.length(start) + 1)
    met = met.withColumn("reach", F.when(within, F.col("allowed_by")).otherwise(F.concat("_at", rest)))
    deny = flat.filter(F.col("effect") == "Deny").select(F.col("role").alias("_role"), F.col("action").alias("_d"), F.col("resource").alias("_res"))
    stopped = (met["role"] == deny["_role"]) & action_matches(met["action"], deny["_d"]) & covers(deny["_res"], met["reach"])
    return met.join(deny, stopped, "left_anti").drop("_at", "_a")


def bypass_findings(flat: DataFrame, visible: DataFrame, locations: DataFrame, read_actions=("s3:GetObject",)) -> DataFrame:
    """A role that sees a table only in part but may read that table's files directly.

    ``flat`` from ``flatten_policies``; ``visible (role, database, table, full_table)``;
    ``locations (database, table, location)``. One row per table and Allow that no
    Deny takes back, for any of ``read_actions`` (see ``permitted``).
    """
    partial = visible.filter(~F.col("full_table")).join(broadcast_if_small(locations), ["database", "table"])
    asked = partial.select("role", "database", "table", "location", F.col("location").alias("resource"), F.explode(F.array(*[F.lit(a) for a in read_actions])).alias("action"))
    return permitted(flat, asked).select("role", "database", "table", "location", F.col("allowed_by").alias("resource")).distinct()
