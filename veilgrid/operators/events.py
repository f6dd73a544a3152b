"""Change-event operators (T2–T13, P6, P8, P10) over parsed envelopes.

Every operator takes and returns a DataFrame with an ``event`` struct column
(see ``veilgrid.sources.events``) or the flat columns derived from it, and
works the same on a batch frame and on a streaming micro-batch. Routing rules
are a handful of configured patterns, compiled to column predicates.

Fields are carried flat through the steps (database, table, record count), so
the export and the notification see the event's real values — the wrapped
state of the reference lost them and always fell back to defaults.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.functions.joins import spread_join
from veilgrid.functions.scalars import default_if_blank

# The count of an event that names none, the required envelope
# fields, the export key and timestamp format, the archive
# status, and the notification text.
DEFAULT_RECORD_COUNT = 3
REQUIRED_FIELDS = ("id", "detail-type", "source", "time")
EXPORT_KEY = "{base}/exported-data/%s/%s/export_%s.csv"
EXPORT_STAMP = "yyyyMMdd_HHmmss"
ARCHIVE_STATUS = "completed"
NOTIFY_SUBJECT = "Data Export Completed"
NOTIFY_TEXT = "Data Export Completed!\n\nDatabase: %s\nTable: %s\nRecords: %d\nLocation: %s\nTime: %s"
NO_LOCATION = "Not available"


def _field(path: str) -> Column:
    """``detail.database`` → nested field of the ``event`` struct (backticks for ``detail-type``)."""
    parts = path.split(".")
    c = F.col("event")[parts[0]]
    for p in parts[1:]:
        c = c[p]
    return c


def match_pattern(pattern: Mapping[str, Sequence]) -> Column:
    """AND over fields of ``field IN (values)``; a missing/NULL field does not match."""
    cond = F.lit(True)
    for path, values in pattern.items():
        cond = cond & F.coalesce(_field(path).isin(*values), F.lit(False))
    return cond


def route_events(df: DataFrame, rules: Mapping[str, Mapping[str, Sequence]]) -> DataFrame:
    """One row per (event, matching rule) with the rule name in ``rule``.

    Rules are configuration (a few patterns); each becomes a predicate and the
    matches are exploded in-row — no join, no shuffle.
    """
    hits = F.array(*[F.when(match_pattern(p), F.lit(name)) for name, p in rules.items()])
    return df.withColumn("rule", F.explode(F.filter(hits, lambda x: x.isNotNull())))


def match_rule_table(df: DataFrame, rules: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """T2 with rules as a table ``(rule, field, values array<string>)``: one row per (row of ``df``, matching rule), as ``rule``.

    An inverted index: a rule is filed under the values of its most telling
    field, the one whose values the fewest rules share, and an event looks up
    its own values there. A candidate matches when as many of the rule's fields
    hit as it has. So a value that every rule names, like a common source, is
    never a join key unless a rule has nothing else. ``fields`` gives the
    event's value for each field; a NULL value, or a field that is not given,
    hits nothing. Several rows for one field of a rule count as one list. A
    value that a large share of the events or rules has goes to several tasks.
    """
    given = rules.filter(F.col("field").isNotNull()).groupBy("rule", "field").agg(F.array_distinct(F.flatten(F.collect_list("values"))).alias("values"))
    each = given.select("rule", "field", F.explode("values").alias("value"))
    shared = each.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    cost = spread_join(each, shared, ["field", "value"]).groupBy("rule", "field").agg(F.max("n").alias("cost"))
    # Fields that no event has come last: their rules match nothing either way.
    telling = cost.groupBy("rule").agg(F.min_by("field", F.struct(~F.col("field").isin(*fields), "cost", "field")).alias("field"))
    whole = given.groupBy("rule").agg(F.map_from_entries(F.collect_list(F.struct("field", "values"))).alias("_conds"))
    index = each.join(telling, ["rule", "field"]).join(whole, "rule").select(F.col("field").alias("_field"), F.col("value").alias("_value"), "rule", "_conds")
    # An event's values ride along as a struct, by the field's place.
    values = F.struct(*[c.cast("string").alias(f"f{i}") for i, c in enumerate(fields.values())])
    each_own = F.array(*[F.struct(F.lit(name).alias("_field"), F.col("_values")[f"f{i}"].alias("_value")) for i, name in enumerate(fields)])
    own = df.withColumn("_values", values).select(*df.columns, "_values", F.inline(each_own)).filter(F.col("_value").isNotNull())
    met = spread_join(own, index, ["_field", "_value"], tasks=int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hit = [F.coalesce(F.array_contains(F.element_at("_conds", F.lit(name)), F.col("_values")[f"f{i}"]), F.lit(False)) for i, name in enumerate(fields)]
    hits = functools.reduce(operator.add, [h.cast("int") for h in hit])
    return met.filter(hits == F.size("_conds")).select(*df.columns, "rule")


def forward(df: DataFrame, pattern: Mapping[str, Sequence]) -> DataFrame:
    """The events a forwarding rule copies to another bus (the caller writes them out)."""
    return df.filter(match_pattern(pattern))


def dedupe_events(df: DataFrame, id_col: str = "event_id", ts_col: str | None = None, delay: str | None = None) -> DataFrame:
    """T4: one delivery per event id.

    Streaming: ``withWatermark`` + ``dropDuplicatesWithinWatermark`` keeps
    state only for ``delay``. Batch: ``dropDuplicates`` (partial + final
    aggregation on the id, no data sent to one task).
    """
    if df.isStreaming and ts_col and delay:
        return df.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark([id_col])
    return df.dropDuplicates([id_col])


def normalize_event(
    df: DataFrame,
    default_database: str,
    default_table: str,
    default_count: int = DEFAULT_RECORD_COUNT,
) -> DataFrame:
    """T5 + P10: flat ``event_id, detail_type, source, event_time, database, table, record_count``.

    The fields come from the detail struct if it holds anything, else from the
    event's own root; a blank or ``None`` database or table falls back to the
    defaults, a missing count to 3.
    """
    e = F.col("event")
    d = e["detail"]
    names = [f.name for f in df.schema["event"].dataType["detail"].dataType.fields]
    filled = F.lit(False)
    for n in names:
        filled = filled | d[n].isNotNull()
    filled = F.coalesce(filled, F.lit(False))
    root = {f.name for f in df.schema["event"].dataType.fields}

    def field(name: str) -> Column:
        return F.when(filled, d[name]).otherwise(e[name]) if name in root else d[name]

    blanks = ("", "None")
    return df.select(
        "*",
        e["id"].alias("event_id"),
        e["detail-type"].alias("detail_type"),
        e["source"].alias("source"),
        e["time"].alias("event_time"),
        default_if_blank(field("database"), default_database, blanks).alias("database"),
        default_if_blank(field("table"), default_table, blanks).alias("table"),
        F.coalesce(field("recordCount"), F.lit(default_count)).alias("record_count"),
    )


def wrap_event(df: DataFrame, now: Column) -> DataFrame:
    """Validated flag and time added; the original kept as typed envelope (``original_event``) and whole (``original``, a VARIANT).

    ``original`` holds every field of the line, named in the envelope or not.
    A frame that never was text has no such column; its typed event is whole.
    """
    whole = F.col("raw") if "raw" in df.columns else F.to_variant_object(F.col("event"))
    return df.withColumns(
        {"event_validated": F.lit(True), "validated_at": now, "original_event": F.col("event"), "original": whole}
    )


def quality_gate(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``failed_rules`` (names of rules that are not true) and ``accepted``; nothing waits."""
    failed = F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])
    return df.withColumn("failed_rules", F.filter(failed, lambda x: x.isNotNull())).withColumn(
        "accepted", F.size("failed_rules") == 0
    )


def export_path(base: str, database: Column, table: Column, ts: Column) -> Column:
    """S12 key, for the write and for the notification alike: ``{base}/exported-data/{db}/{table}/export_{yyyyMMdd_HHmmss}.csv``."""
    return F.format_string(EXPORT_KEY.format(base=base), database, table, F.date_format(ts, EXPORT_STAMP))


def archive(df: DataFrame, now: Column, count_col: str = "record_count") -> DataFrame:
    """T10 + P8: events with ``record_count > 0`` become archive records; others are skipped."""
    return df.filter(F.col(count_col) > 0).withColumn("archive_status", F.lit(ARCHIVE_STATUS)).withColumn(
        "archived_at", now
    )


def notifications(
    df: DataFrame,
    now: Column,
    default_database: str,
    default_table: str,
    location_col: str = "export_location",
    count_col: str = "record_count",
) -> DataFrame:
    """Notification text per processed event (sending mail is not built)."""
    loc = F.coalesce(F.col(location_col), F.lit(NO_LOCATION))
    cnt = F.coalesce(F.col(count_col), F.lit(0))
    msg = F.format_string(
        NOTIFY_TEXT,
        default_if_blank(F.col("database"), default_database, ("Unknown",)),
        default_if_blank(F.col("table"), default_table, ("Unknown",)),
        cnt,
        loc,
        F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
    )
    return df.withColumn("subject", F.lit(NOTIFY_SUBJECT)).withColumn("message", msg)


def dead_letters(df: DataFrame, required: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """Lines that are no JSON, have a field of the wrong kind, or lack a required envelope field, with the reason."""
    e = F.col("event")
    broken = e.isNull() | e["_corrupt_record"].isNotNull()
    wrong = F.coalesce(e["_invalid"], F.array().cast("array<string>"))
    missing = F.filter(F.array(*[F.when(e[f].isNull(), F.lit(f)) for f in required]), lambda x: x.isNotNull())
    reason = (
        F.when(broken, F.lit("unparseable"))
        .when(F.size(wrong) > 0, F.concat(F.lit("invalid: "), F.array_join(wrong, ",")))
        .otherwise(F.concat(F.lit("missing: "), F.array_join(missing, ",")))
    )
    return df.filter(broken | (F.size(wrong) > 0) | (F.size(missing) > 0)).withColumn("reason", reason)


def valid_events(df: DataFrame, required: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """Complement of ``dead_letters``."""
    e = F.col("event")
    ok = e.isNotNull() & e["_corrupt_record"].isNull() & (F.coalesce(F.size(e["_invalid"]), F.lit(0)) == 0)
    for f in required:
        ok = ok & e[f].isNotNull()
    return df.filter(ok)


def export_increment(rows: DataFrame, exported_keys: DataFrame, keys: Sequence[str]) -> DataFrame:
    """T9 batch twin: rows whose key was not exported yet (left anti join on the key).

    The stream's twin is ``streaming.bus.export_new``, whose ledger holds the
    keys of every epoch.
    """
    return rows.join(exported_keys.select(*keys), list(keys), "left_anti")
