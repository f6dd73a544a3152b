"""Look-up joins: defaults (J3, J4), windowed audit look-up (J6), pattern join.

Small sides (code tables, patterns, policies) are policy/config data with a
bounded size; built with ``values_frame`` they pass the size check of
``broadcast_if_small``. The audit look-up (J6) never emits probe × event pairs:
it is one sorted pass over time-bucketed keys, so a hot key is split across
buckets and the work per probe is constant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veilgrid.functions.joins import broadcast_if_small

# Fixed texts of the audit look-up ("%d events in last %dmin" with count and minutes).
MSG_EVENTS = "%d events in last {minutes}min"
MSG_NO_EVENTS = "No recent events"

# ---------------------------------------------------------------- J3, J4


def lookup_default(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    value_col: str,
    out_col: str,
    default: Column,
) -> DataFrame:
    """Left join on ``keys`` to a mapping (one row per key); missing → ``default`` (a column, e.g. the key itself).

    The mapping is broadcast if its estimated size is small (see ``values_frame``).
    """
    t = table.select(*keys, F.col(value_col).alias("_v"))
    return df.join(broadcast_if_small(t), list(keys), "left").withColumn(out_col, F.coalesce(F.col("_v"), default)).drop("_v")


# ---------------------------------------------------------------- J6


def _micros(df: DataFrame, col: str) -> Column:
    """Microseconds on the time line of ``col``.

    A ``timestamp_ntz`` (wall clock) is measured from the wall-clock epoch, so
    the session time zone (and its daylight-saving jumps) never moves a window;
    a zoned ``timestamp`` uses its instant.
    """
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(col))
    return F.unix_micros(F.col(col).cast("timestamp"))


def audit_lookup(
    probes: DataFrame,
    audit: DataFrame,
    *,
    key: str,
    probe_ts: str,
    audit_ts: str,
    audit_id: str,
    payload: Sequence[str] = (),
    minutes: int = 60,
    split: int = 1,
    prefix: str = "ct_",
) -> DataFrame:
    """For each probe row: audit events with the same ``key`` in ``[t - minutes, t]``.

    Returns the probe columns plus ``{prefix}count`` (all events in the
    window), the latest event's id/time/payload and ``{prefix}message``
    ("n events in last 60min" / "No recent events").

    Plan: time buckets of ``minutes / split``; each audit row is also copied
    into the next ``split`` buckets, so partition ``(key, bucket)`` holds every
    event a probe of that bucket can see, and a hot key is spread over its
    buckets. A probe becomes two marks, at its window's start (before the
    events of that time) and at its end (after them). One pass in time order
    carries the running number of events and the last event to every mark; the
    count is the difference of a probe's two marks, which a group-by brings
    together within the same partitioning. So there is one shuffle, no pairwise
    join, no cap, and constant work per row. Probes with a NULL key or time
    find nothing; they are spread over buckets of their own.
    """
    window = minutes * 60 * 1_000_000
    width = window // split
    # SQL equality and BETWEEN never match NULL.
    a = audit.filter(F.col(key).isNotNull() & F.col(audit_ts).isNotNull()).select(
        F.col(key).alias("_k"),
        _micros(audit, audit_ts).alias("_us"),
        F.struct(
            F.col(audit_ts).alias("ts"), F.col(audit_id).alias("id"), *[F.col(c).alias(f"p_{c}") for c in payload]
        ).alias("_ev"),
    )
    b0 = F.floor(F.col("_us") / F.lit(width)).cast("long")
    a = a.withColumn("_b", F.explode(F.sequence(b0, b0 + F.lit(split))))
    p_cols = probes.columns
    named = probes.select(F.struct(*[F.col(c) for c in p_cols]).alias("_pr"), F.col(key).alias("_k"), _micros(probes, probe_ts).alias("_us"))
    able = F.col("_k").isNotNull() & F.col("_us").isNotNull()
    p = named.withColumn("_pid", F.monotonically_increasing_id())
    # A probe that can find nothing has no key, and a bucket of its own.
    p = p.withColumn("_b", F.when(able, F.floor(F.col("_us") / F.lit(width)).cast("long")).otherwise(F.col("_pid")))
    p = p.withColumn("_k", F.when(able, F.col("_k"))).withColumn("_us", F.coalesce("_us", F.lit(0)))
    marks = F.array(
        F.struct((F.col("_us") - F.lit(window)).alias("us"), F.lit(0).alias("kind")),
        F.struct(F.col("_us").alias("us"), F.lit(2).alias("kind")),
    )
    p = p.select("_k", "_b", "_pid", "_pr", F.inline(marks).alias("_us", "_kind"))
    # Only the mark at the end needs the probe's columns.
    p = p.withColumn("_pr", F.when(F.col("_kind") == 2, F.col("_pr")))
    event_type, probe_type = a.schema["_ev"].dataType, p.schema["_pr"].dataType
    both = a.select(
        "_k", "_b", "_us", F.lit(1).alias("_kind"), "_ev", F.lit(None).cast("long").alias("_pid"), F.lit(None).cast(probe_type).alias("_pr")
    ).unionByName(p.withColumn("_ev", F.lit(None).cast(event_type)))
    order = Window.partitionBy("_k", "_b").orderBy("_us", "_kind", "_ev.id").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.select(
        "_k", "_b", "_kind", "_pid", "_pr",
        F.count("_ev").over(order).alias("_n"), F.last("_ev", ignorenulls=True).over(order).alias("_last"),
    ).filter(F.col("_kind") != 1)
    end = F.col("_kind") == 2
    found = seen.groupBy("_k", "_b", "_pid").agg(
        (F.max(F.when(end, F.col("_n"))) - F.max(F.when(~end, F.col("_n")))).cast("int").alias("_count"),
        F.first(F.when(end, F.col("_pr")), ignorenulls=True).alias("_pr"),
        F.first(F.when(end, F.col("_last")), ignorenulls=True).alias("_last"),
    )
    hit = F.col("_count") > 0
    out = found.select(
        *[F.col(f"_pr.{c}").alias(c) for c in p_cols],
        F.col("_count").alias(f"{prefix}count"),
        F.when(hit, F.col("_last.id")).alias(f"{prefix}latest_id"),
        F.when(hit, F.col("_last.ts")).alias(f"{prefix}latest_time"),
        *[F.when(hit, F.col(f"_last.p_{c}")).alias(f"{prefix}latest_{c}") for c in payload],
    )
    return out.withColumn(
        f"{prefix}message",
        F.when(F.col(f"{prefix}count") > 0, F.format_string(MSG_EVENTS.format(minutes=minutes), F.col(f"{prefix}count")))
        .otherwise(F.lit(MSG_NO_EVENTS)),
    )


# ---------------------------------------------------------------- P12 / J7, G14


def wildcard_to_like(pattern: Column) -> Column:
    """``List*`` → ``List%``; literal ``%`` and ``_`` are escaped so only ``*`` is a wildcard."""
    esc = F.replace(F.replace(F.replace(pattern, F.lit("\\"), F.lit("\\\\")), F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))
    return F.replace(esc, F.lit("*"), F.lit("%"))


def expand_patterns(
    actions: DataFrame,
    patterns: DataFrame,
    action_col: str = "permission",
    pattern_col: str = "pattern",
    on: Sequence[str] = ("service",),
) -> DataFrame:
    """Pattern (theta) join: each action row × every pattern it matches (same ``on`` keys).

    A prefix index: a pattern is met by the literal text before its first
    wildcard, by equality with the action's start of that length, and only then
    the rest of the pattern is checked. So the join's keys are (``on``, prefix),
    not ``on`` alone, and no LIKE runs over all patterns of a service. An action
    is cut at the lengths that patterns have, of which there are no more than a
    pattern is long. Give it distinct actions where they repeat.
    """
    start = F.regexp_extract(F.col(pattern_col), r"^[^*]*", 0)
    pats = patterns.withColumn("_like", wildcard_to_like(F.col(pattern_col))).withColumn("_start", start)
    lengths = sorted(r[0] for r in pats.select(F.length("_start")).distinct().collect() if r[0] is not None)
    own = [F.col(c).alias(f"_own_{c}") for c in on]
    cut = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(action_col))
    starts = actions.withColumn("_n", F.explode(cut)).withColumn("_start", F.expr(f"substring(`{action_col}`, 1, _n)")).drop("_n")
    pats = pats.select(*own, F.col("_start").alias("_own_start"), "_like", *[c for c in patterns.columns if c not in on])
    cond = starts["_start"] == pats["_own_start"]
    for c in on:
        cond = cond & (starts[c] == pats[f"_own_{c}"])
    out = starts.join(broadcast_if_small(pats), cond).filter(F.like(starts[action_col], pats["_like"]))
    return out.drop("_start", "_own_start", "_like", *[f"_own_{c}" for c in on])


# ---------------------------------------------------------------- O5


def latest_per_group(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], tiebreak: str | None = None) -> DataFrame:
    """Per group, the newest row's ``cols`` (``latest``) and the group size (``n``).

    One group-by with ``max_by`` and ``count``, both partially aggregated
    map-side, so a hot group is combined before the shuffle and never
    collected whole. ``tiebreak`` orders rows with equal ``ts``.
    """
    order = F.struct(F.col(ts), F.col(tiebreak)) if tiebreak else F.col(ts)
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in cols]), order).alias("latest"),
        F.count(F.lit(1)).alias("n"),
    )
