"""Row-change audit (C1–C10, S9, S10): one audit row per changed column.

Set-based instead of per-row triggers:

* ``audit_update`` — the UPDATE and its audit in one narrow pass: the old and
  the new value of each column sit in the same row, so there is **no shuffle**
  at all (filter → project → explode). Rows outside the UPDATE's condition are
  pruned at the scan when the condition is pushable.
* ``audit_rows`` — two snapshots of a keyed table joined on the key
  (sort-merge, or broadcast when AQE sees a small side), then the same
  per-column explode. Inserts and deletes are not audited (inner join).

The per-column comparison is typed and null-safe (``IS DISTINCT FROM``) and is
used both for ``changed_keys`` and for the per-column rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veilgrid.functions.scalars import distinct_from
from veilgrid.session import scratch_root

# Fixed values of the audit: meta columns, the default process step, the
# optional id columns and the action code.
META_COLUMNS = ("created_dt", "created_by", "modified_dt", "modified_by")
DEFAULT_STEP = "3-Normalize"
ID_COLUMNS = ("cmid", "pnum")
ACTION_UPDATE = "UPDATE"

# Fixed length limits of the audit log (varchar(n) there; longer values are
# an error, not cut).
LENGTH_LIMITS = {
    "response_table": 50,
    "action_code": 10,
    "process_step": 20,
    "var_name": 63,
    "original_value": 200,
    "modified_value": 200,
}


def ts_literal(value: str | datetime | Column | None) -> Column:
    """A wall-clock timestamp (``timestamp_ntz``) literal; columns pass through; None = now."""
    if value is None:
        return F.localtimestamp()
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(value).cast("timestamp_ntz")


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _user(v) -> Column:
    """The acting user: given, else the session user (``SESSION_USER``)."""
    return F.session_user() if v is None else _lit(v).cast("string")


# ---------------------------------------------------------------- S9, C1, C2, C8


def add_meta_columns(df: DataFrame, now=None, user=None) -> DataFrame:
    """Idempotent ``ADD COLUMN IF NOT EXISTS … NOT NULL DEFAULT``: existing columns are kept.

    Defaults are ``now`` (else the current wall-clock time) and ``user`` (else
    the session user).
    """
    defaults = {
        "created_dt": ts_literal(now),
        "created_by": _user(user),
        "modified_dt": ts_literal(now),
        "modified_by": _user(user),
    }
    out = df
    for name in META_COLUMNS:
        if name not in df.columns:
            out = out.withColumn(name, defaults[name])
    return out


def stamp_modified(df: DataFrame, cond: Column, now=None, user=None) -> DataFrame:
    """Every updated row gets ``modified_dt``/``modified_by``, even if nothing else changed."""
    return df.select(*_set_exprs(df, cond, {}, ts_literal(now), _user(user)))


def _set_exprs(df: DataFrame, cond: Column, assignments: Mapping[str, Column], now=None, user=None) -> list[Column]:
    """Output columns of ``UPDATE df SET … WHERE cond``, each computed from the OLD row."""
    sets = dict(assignments)
    if now is not None and "modified_dt" in df.columns:
        sets["modified_dt"] = ts_literal(now)
    if user is not None and "modified_by" in df.columns:
        sets["modified_by"] = _lit(user).cast("string")
    hit = F.coalesce(cond, F.lit(False))
    return [
        (F.when(hit, sets[c]).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in sets else F.col(c))
        for c in df.columns
    ]


def update(
    df: DataFrame,
    cond: Column,
    assignments: Mapping[str, Column],
    now=None,
    user=None,
) -> DataFrame:
    """C2 (+C1): new snapshot of ``UPDATE df SET col = expr … WHERE cond``.

    All SET expressions see the OLD row (one ``select``), as in SQL. A NULL
    condition does not update. With ``now``/``user`` the row is stamped.
    """
    return df.select(*_set_exprs(df, cond, assignments, now, user))


def resolve_step(arg: str | Column | None, setting: str | Column | None, default: str = DEFAULT_STEP) -> Column:
    """Trigger argument, else session setting, else the default ('' counts as absent)."""
    a = F.nullif(_lit(arg).cast("string"), F.lit(""))
    s = F.nullif(_lit(setting).cast("string"), F.lit(""))
    return F.coalesce(a, s, F.lit(default))


# ---------------------------------------------------------------- C3–C7 core


def _audit_from_pair(
    pairs: DataFrame,
    old_cols: Sequence[str],
    new_cols: Sequence[str],
    *,
    table: str,
    step: Column,
    now,
    user,
    exclude_cols: Iterable[str],
    id_cols: Sequence[str],
    carry: Sequence[str],
    snapshots: bool,
    action: str,
) -> DataFrame:
    """``pairs`` has struct columns ``o`` (OLD row) and ``n`` (NEW row) plus ``carry`` columns."""
    excluded = set(exclude_cols)
    common = [c for c in new_cols if c in set(old_cols) and c not in excluded]
    # One typed, null-safe comparison per column, used for both outputs below.
    changed = {c: distinct_from(F.col(f"o.{c}"), F.col(f"n.{c}")) for c in common}
    any_changed = F.lit(False)
    for c in common:
        any_changed = any_changed | changed[c]
    # Sorted names of the changed columns; NULLs (unchanged) removed without a lambda.
    changed_keys = F.array_except(
        F.array(*[F.when(changed[c], F.lit(c)) for c in sorted(common)]),
        F.array(F.lit(None).cast("string")),
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("var_name"),
                F.col(f"o.{c}").cast("string").alias("original_value"),
                F.col(f"n.{c}").cast("string").alias("modified_value"),
                changed[c].alias("changed"),
            )
            for c in sorted(common)
        ]
    )
    ids = [
        (F.col(f"n.{c}").cast("string") if c in new_cols else F.lit(None).cast("string")).alias(c) for c in id_cols
    ]
    snaps = (
        [
            F.to_json(F.col("o"), {"ignoreNullFields": "false"}).alias("old_row"),
            F.to_json(F.col("n"), {"ignoreNullFields": "false"}).alias("new_row"),
        ]
        if snapshots
        else []
    )
    # Rows with no changed column are dropped before any text is built;
    # Inline the per-column entries (a codegen'd generator) and keep the changed ones.
    staged = pairs.filter(any_changed).select(
        *ids, *[F.col(c) for c in carry], changed_keys.alias("changed_keys"), *snaps, F.inline(entries)
    )
    out = staged.filter(F.col("changed"))
    return out.select(
        F.lit(table).cast("string").alias("response_table"),
        F.lit(action).alias("action_code"),
        step.alias("process_step"),
        *id_cols,
        *carry,
        "var_name",
        "original_value",
        "modified_value",
        "changed_keys",
        *(["old_row", "new_row"] if snapshots else []),
        ts_literal(now).alias("created_dt"),
        _user(user).alias("created_by"),
        F.lit(table).cast("string").alias("table_name"),
        F.lit(None).cast("string").alias("note"),
    )


def audit_pairs(
    pairs: DataFrame, cols: Sequence[str], *, table: str, carry: Sequence[str], now=None, user=None, step=None, setting=None, exclude_cols: Iterable[str] = (), snapshots: bool = True
) -> DataFrame:
    """Audit rows of ``pairs``, whose struct columns ``o`` and ``n`` hold the OLD and the NEW row (fields ``cols``); ``carry`` is kept."""
    return _audit_from_pair(
        pairs, cols, cols, table=table, step=resolve_step(step, setting), now=now, user=user, exclude_cols=exclude_cols,
        id_cols=[c for c in ID_COLUMNS if c not in carry], carry=list(carry), snapshots=snapshots, action=ACTION_UPDATE,
    )


def audit_update(
    df: DataFrame,
    cond: Column,
    assignments: Mapping[str, Column],
    *,
    table: str,
    now=None,
    user=None,
    step: str | Column | None = None,
    setting: str | Column | None = None,
    keys: Sequence[str] = (),
    exclude_cols: Iterable[str] = (),
    id_cols: Sequence[str] = ID_COLUMNS,
    snapshots: bool = True,
    stamp: bool = True,
) -> DataFrame:
    """Audit rows of ``UPDATE df SET … WHERE cond`` without a join (J1, in-row).

    The BEFORE stamper (C1) runs first when ``stamp`` is set, so with no
    exclusions ``modified_dt`` (and ``modified_by`` for another user) are
    audited as well.

    No shuffle; a row is audited on its own, so a repeated key cannot mix rows
    up (``assert_unique_keys`` checks a keyed table beforehand).
    """
    updated = df.filter(cond)  # plain predicate: NULL drops the row and the scan gets the pushed filter
    stamp_now, stamp_user = (ts_literal(now), _user(user)) if stamp else (None, None)
    new_exprs = _set_exprs(df, F.lit(True), assignments, stamp_now, stamp_user)
    # Old and new values side by side in one row: one projection, no join.
    pairs = updated.select(
        *[F.col(k) for k in keys],
        F.struct(*[F.col(c) for c in df.columns]).alias("o"),
        F.struct(*new_exprs).alias("n"),
    )
    return _audit_from_pair(
        pairs,
        df.columns,
        df.columns,
        table=table,
        step=resolve_step(step, setting),
        now=now,
        user=user,
        exclude_cols=exclude_cols,
        id_cols=id_cols,
        carry=list(keys),
        snapshots=snapshots,
        action=ACTION_UPDATE,
    )


def audit_rows(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    *,
    table: str,
    now=None,
    user=None,
    step: str | Column | None = None,
    setting: str | Column | None = None,
    exclude_cols: Iterable[str] = (),
    id_cols: Sequence[str] = ID_COLUMNS,
    snapshots: bool = True,
    check_keys: bool = True,
) -> DataFrame:
    """C3–C7 over two snapshots joined on ``keys``.

    ``check_keys`` fails the job when a key that is in both snapshots repeats
    on either side (the audit of a keyed table is undefined then); a key
    repeated on one side only is not audited anyway (inner join).
    """
    o = old.select(*keys, F.struct(*[F.col(c) for c in old.columns]).alias("o"))
    n = new.select(*keys, F.struct(*[F.col(c) for c in new.columns]).alias("n"))
    pairs = o.join(n, list(keys), "inner")
    if check_keys:
        # The join's partitioning already brings equal keys together, so this count
        # needs no extra shuffle. A key repeated on either side shows up as more than one joined
        # row and fails the job.
        dup = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        msg = F.concat(F.lit("duplicate key in audited snapshots: "), F.to_json(F.struct(*keys)))
        pairs = (
            pairs.withColumn("_dup", dup)
            .filter(F.coalesce(F.when(F.col("_dup") > 1, F.raise_error(msg)).cast("boolean"), F.lit(True)))
            .drop("_dup")
        )
    return _audit_from_pair(
        pairs,
        old.columns,
        new.columns,
        table=table,
        step=resolve_step(step, setting),
        now=now,
        user=user,
        exclude_cols=exclude_cols,
        id_cols=id_cols,
        carry=list(keys),
        snapshots=snapshots,
        action=ACTION_UPDATE,
    )


def assert_unique_keys(df: DataFrame, keys: Sequence[str], what: str = "table") -> None:
    """Raise ``ValueError`` if any key value occurs twice (one bounded driver round trip)."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"duplicate key in {what}: {dict(dup[0].asDict())}")


# ---------------------------------------------------------------- S10, C9, C10


def with_sequence_id(df: DataFrame, start: int = 1, id_col: str = "audit_log_id") -> DataFrame:
    """Unique ids from ``start`` on that rise in the order of the frame's rows.

    Partition and position make the id, so numbering takes no sort, no shuffle
    and no second pass. Like a database sequence, ids may leave gaps.
    """
    return df.select((F.lit(start) + F.monotonically_increasing_id()).cast("bigint").alias(id_col), *df.columns)


def with_ordered_id(df: DataFrame, order_cols: Sequence[str], start: int = 1, id_col: str = "audit_log_id") -> DataFrame:
    """The ids ``start``, ``start`` + 1, ... without gaps, in the order of ``order_cols``.

    Rows are range-partitioned and sorted, and written with their place in
    their range below the shared folder, so that a range is settled whatever is
    computed again. The ranges' sizes, summed up in order, are the offsets; only
    they, one row a range, pass through one task. Rows equal in ``order_cols``
    are numbered one way or the other.
    """
    spark = df.sparkSession
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    path = scratch_root(spark, "ordered-ids")
    ranged.select(*df.columns, F.shiftright(place, 33).alias("_range"), place.bitwiseAND((1 << 33) - 1).alias("_place")).write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("_range").agg((F.max("_place") + 1).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", before.alias("_before"))
    # One row a range: bounded by the number of partitions.
    numbered = rows.join(F.broadcast(offsets), "_range")
    return numbered.select((F.lit(start) + F.col("_before") + F.col("_place")).cast("bigint").alias(id_col), *df.columns)


def next_id(log: DataFrame, id_col: str = "audit_log_id") -> int:
    """The first id after all of the log's (1 for an empty log): a one-row aggregate."""
    return int(log.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]) + 1


def append_audit(rows: DataFrame, path: str, id_col: str = "audit_log_id", order_cols: Sequence[str] | None = None) -> None:
    """Append audit rows to the Parquet log at ``path``, created if absent.

    Their ids follow the log's largest (S10): without gaps and in the order of
    ``order_cols`` where given, else in the order of the frame's rows, with
    gaps. A value over its length limit fails the write and leaves the log as
    it was (C10). One writer at a time.
    """
    spark = rows.sparkSession
    try:
        start = next_id(spark.read.parquet(path), id_col)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        start = 1
    checked = enforce_lengths(rows)
    numbered = with_ordered_id(checked, order_cols, start, id_col) if order_cols else with_sequence_id(checked, start, id_col)
    numbered.write.mode("append").parquet(path)


# ---------------------------------------------------------------- J1, C4, C5, F22, F23 on rows of varying keys


def json_cells(text: Column) -> Column:
    """A JSON object's fields as a map from key to a struct of the value's text (strings without quotes, the rest as JSON).

    A key with a JSON null has a struct of NULL, a key that is not there has none.
    """
    return F.transform_values(F.from_json(text, "map<string,string>"), lambda _, v: F.struct(v.alias("v")))


def audit_json(
    df: DataFrame,
    old: str,
    new: str,
    *,
    table: str,
    keys: Sequence[str] = (),
    now=None,
    user=None,
    step: str | Column | None = None,
    setting: str | Column | None = None,
    exclude_keys: Sequence[str] = (),
) -> DataFrame:
    """Audit rows of JSON objects ``old`` and ``new`` that need not have the same keys, nor the same ones as other rows.

    The keys that both objects hold are compared as text, null-safe; a key that
    only one holds is not audited. The two maps are aligned inside the row, so
    there is no explode before a change is found, no join and no shuffle. A row
    whose side is NULL or no JSON object has no audit rows.
    """
    both = F.map_zip_with(json_cells(F.col(old)), json_cells(F.col(new)), lambda k, a, b: F.struct(a.alias("a"), b.alias("b")))
    cells = F.filter(
        F.map_entries(both),
        lambda e: e["value"]["a"].isNotNull()
        & e["value"]["b"].isNotNull()
        & ~e["value"]["a"]["v"].eqNullSafe(e["value"]["b"]["v"])
        & (~e["key"].isin(*exclude_keys) if exclude_keys else F.lit(True)),
    )
    changed = F.array_sort(F.transform(cells, lambda e: F.struct(e["key"].alias("var_name"), e["value"]["a"]["v"].alias("original_value"), e["value"]["b"]["v"].alias("modified_value"))))
    rows = df.select(*keys, F.col(old).alias("old_row"), F.col(new).alias("new_row"), F.explode(F.array(changed)).alias("_changed"))
    rows = rows.filter(F.size("_changed") > 0).withColumn("changed_keys", F.col("_changed.var_name"))
    rows = rows.select(*keys, "changed_keys", "old_row", "new_row", F.inline("_changed"))
    return rows.select(
        F.lit(table).alias("response_table"), F.lit(ACTION_UPDATE).alias("action_code"), resolve_step(step, setting).alias("process_step"), *keys,
        "var_name", "original_value", "modified_value", "changed_keys", "old_row", "new_row",
        ts_literal(now).alias("created_dt"), _user(user).alias("created_by"), F.lit(table).alias("table_name"), F.lit(None).cast("string").alias("note"),
    )


def latest(log: DataFrame, k: int, id_col: str = "audit_log_id") -> DataFrame:
    """O3: newest first, ``ORDER BY id DESC LIMIT k`` → distributed top-k."""
    return log.orderBy(F.col(id_col).desc_nulls_first()).limit(k)


def length_violations(df: DataFrame, limits: Mapping[str, int] = LENGTH_LIMITS) -> DataFrame:
    """Rows with a value longer than its limit, with the offending column names."""
    present = {c: n for c, n in limits.items() if c in df.columns}
    too_long = F.array(*[F.when(F.length(c) > n, F.lit(c)) for c, n in present.items()])
    return df.withColumn("violations", F.filter(too_long, lambda x: x.isNotNull())).filter(
        F.size("violations") > 0
    )


def enforce_lengths(df: DataFrame, limits: Mapping[str, int] = LENGTH_LIMITS) -> DataFrame:
    """Fail the job on the first too-long value (as varchar(n) does), never cut it."""
    out = df
    for c, n in limits.items():
        if c in df.columns:
            out = out.withColumn(
                c,
                F.when(
                    F.length(c) > n,
                    F.raise_error(F.format_string(f"value too long for {c} ({n}): %s", F.col(c))),
                ).otherwise(F.col(c)).cast(T.StringType()),
            )
    return out
