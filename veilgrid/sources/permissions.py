"""Nested permission configuration (S15, D12): service → list of actions."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.functions.joins import broadcast_if_small, values_frame


def _config_text(spark: SparkSession, path: str) -> str:
    """The whole text of a small configuration file, read through Spark (local or remote path)."""
    row = spark.read.text(path, wholetext=True).first()
    return row["value"] if row else ""


def load_config(spark: SparkSession, path: str) -> dict:
    """The ``config`` section of a JSON or YAML permission file (region, profile, description, …)."""
    data = _parse(path, _config_text(spark, path))
    return dict(data.get("config") or {})


def _parse(path: str, text: str) -> dict:
    if path.endswith((".yaml", ".yml")):
        import yaml  # configuration only; gated so JSON works without it

        return yaml.safe_load(text) or {}
    return json.loads(text) if text.strip() else {}


def load_permissions(spark: SparkSession, path: str, services: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Read ``{"permissions": {service: [actions]}}`` (or a bare map) from a JSON or YAML file.

    Returns ``(pairs, missing)``: one row per (service, permission) — for the
    chosen ``services`` when given — and the requested services that the file
    does not list (anti join), which the caller reports as a warning. The file
    is configuration (hundreds of entries): its text is parsed once and the
    pairs are exploded by Spark.
    """
    data = _parse(path, _config_text(spark, path))
    mapping = data.get("permissions", data) if isinstance(data, dict) else {}
    mapping = {k: list(v or []) for k, v in mapping.items() if k != "config"}
    m = values_frame(spark, [(json.dumps(mapping),)], "value string").select(
        F.from_json("value", "map<string, array<string>>").alias("m")
    )
    per_service = m.select(F.explode("m").alias("service", "actions"))
    pairs = per_service.select("service", F.explode("actions").alias("permission"))
    if services is None:
        return pairs, values_frame(spark, [], "service string")
    wanted = values_frame(spark, [(s,) for s in services], "service string")
    chosen = pairs.join(broadcast_if_small(wanted), "service", "left_semi")
    missing = wanted.join(per_service.select("service"), "service", "left_anti")
    return chosen, missing


def permissions_frame(spark: SparkSession, mapping: dict[str, list[str]]) -> DataFrame:
    """The same pairs from an in-memory mapping (tests, small configs)."""
    text = json.dumps(mapping)
    m = values_frame(spark, [(text,)], "value string").select(F.from_json("value", "map<string, array<string>>").alias("m"))
    return m.select(F.explode("m").alias("service", "actions")).select("service", F.explode("actions").alias("permission"))


def counts(pairs: DataFrame) -> DataFrame:
    """Number of permissions and services."""
    return pairs.agg(F.count(F.lit(1)).alias("n_permissions"), F.count_distinct("service").alias("n_services"))


def load_patterns(spark: SparkSession, path: str) -> DataFrame:
    """P12 input: ``service<TAB>pattern`` lines (``*`` is the wildcard) → ``(service, pattern)``."""
    return (
        spark.read.option("sep", "\t")
        .option("comment", "#")
        .schema("service string, pattern string")
        .csv(path)
        .filter(F.col("service").isNotNull() & F.col("pattern").isNotNull())
    )
