"""Column-expression helpers (all built-in Spark functions, no UDFs).

Each helper returns a ``Column`` so it composes inside ``select``/``filter``
and stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for the same results.
# Read-only action prefixes (anything else is SKIPPED by the safety check).
READONLY_PREFIXES = ("Describe", "List", "Get", "Lookup", "Search")
# Keys that are response metadata, never the main list of a response.
RESPONSE_METADATA_KEYS = ("ResponseMetadata", "NextToken", "NextMarker", "Marker", "IsTruncated")
# Where a word starts inside a CamelCase name.
WORD_STARTS = (r"(.)([A-Z][a-z]+)", r"([a-z0-9])([A-Z])")
# Marker of an ARN and the kind of principal it names.
ARN_KINDS = ((":user/", "IAM User"), (":assumed-role/", "Assumed Role"), (":role/", "IAM Role"))
UNKNOWN_KIND = "Unknown"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def categorize(col: str | Column, threshold: float, above: str = "Fast", otherwise: str = "Normal") -> Column:
    """``CASE WHEN col > threshold THEN above ELSE otherwise END`` (NULL → otherwise)."""
    c = _c(col)
    return F.when(c > F.lit(threshold), F.lit(above)).otherwise(F.lit(otherwise))


def like_prefix(pattern: str) -> str:
    """Literal text before the first wildcard (or escape) of a LIKE pattern."""
    out = []
    for ch in pattern:
        if ch in "%_\\":
            break
        out.append(ch)
    return "".join(out)


def like(col: str | Column, pattern: str) -> Column:
    """SQL LIKE: ``%`` any run, ``_`` exactly one character (also ``_`` itself).

    Catalyst turns only simple patterns (``abc%``) into a pushable
    ``StartsWith``; a ``_`` inside (``WP_POC_%``) keeps the whole filter in
    Spark. The literal prefix is implied by the pattern, so it is added as a
    ``startswith`` conjunct: the Parquet scan then gets ``StringStartsWith``
    and can skip row groups by their min/max statistics. Same result.
    """
    c = _c(col)
    prefix = like_prefix(pattern)
    if prefix and prefix != pattern:
        return c.startswith(prefix) & c.like(pattern)
    return c.like(pattern)


def distinct_from(a: str | Column, b: str | Column) -> Column:
    """Null-safe difference: ``a IS DISTINCT FROM b``."""
    return ~_c(a).eqNullSafe(_c(b))


def rows_distinct(left_cols: Sequence[Column], right_cols: Sequence[Column]) -> Column:
    """Whole-row ``IS DISTINCT FROM`` over paired columns (False for zero columns)."""
    out = F.lit(False)
    for a, b in zip(left_cols, right_cols, strict=True):
        out = out | distinct_from(a, b)
    return out


def is_readonly(col: str | Column, prefixes: Iterable[str] = READONLY_PREFIXES) -> Column:
    """True when the action name starts with one of the read-only prefixes."""
    c = _c(col)
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def default_if_blank(col: str | Column, default, blanks: Iterable[str] = ("", "None")) -> Column:
    """Falsy fallback: NULL, or any of ``blanks`` as text, becomes ``default``."""
    c = _c(col)
    for b in blanks:
        c = F.nullif(c, F.lit(b))
    return F.coalesce(c, default if isinstance(default, Column) else F.lit(default))


def contains_any(col: str | Column, words: Iterable[str]) -> Column:
    """Case-insensitive: does the text contain any of ``words``? (NULL text → False)."""
    words = [w.lower() for w in words]
    if not words:
        return F.lit(False)
    text = F.lower(_c(col))
    return F.coalesce(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.instr(text, w) > 0), F.lit(False))


def snake_case(col: str | Column) -> Column:
    """CamelCase → snake_case: ``DescribeDBClusters`` → ``describe_db_clusters``."""
    out = _c(col)
    for start in WORD_STARTS:
        out = F.regexp_replace(out, start, "$1_$2")
    return F.lower(out)


def identity_type(arn: str | Column) -> Column:
    """Kind of principal named by an ARN-like string."""
    a = _c(arn)
    return F.coalesce(*[F.when(a.contains(mark), F.lit(kind)) for mark, kind in ARN_KINDS], F.lit(UNKNOWN_KIND))


def identity_name(arn: str | Column) -> Column:
    """Principal name: text after the marker; for an assumed role, up to the next ``/``."""
    a = _c(arn)
    after = {mark: F.substring_index(a, mark, -1) for mark, _ in ARN_KINDS}
    after[":assumed-role/"] = F.substring_index(after[":assumed-role/"], "/", 1)
    return F.coalesce(*[F.when(a.contains(mark), after[mark]) for mark, _ in ARN_KINDS], a)


def last_path_part(col: str | Column) -> Column:
    """Text after the last ``/``."""
    return F.substring_index(_c(col), "/", -1)


def truncate(col: str | Column, n: int) -> Column:
    """First ``n`` characters (Python ``s[:n]``)."""
    return F.substring(_c(col), 1, n)


def flip(col: str | Column, when_value: str, then_value: str) -> Column:
    """``CASE col WHEN when_value THEN then_value ELSE when_value END`` (NULL → ELSE)."""
    c = _c(col)
    return F.when(c == F.lit(when_value), F.lit(then_value)).otherwise(F.lit(when_value))


def padded_increment(col: str | Column, step: int, width: int = 6, blank: str = "000000") -> Column:
    """``LPAD((COALESCE(NULLIF(c,''), blank)::int + step)::text, width, '0')``.

    ``lpad`` truncates longer text, as PostgreSQL does.
    """
    base = F.coalesce(F.nullif(_c(col), F.lit("")), F.lit(blank)).cast("int") + F.lit(step)
    return F.lpad(base.cast("string"), width, "0")


def format_cell(col: str | Column, data_type: str) -> Column:
    """Result-cell text: doubles with 2 decimals, everything else as text, NULL → 'NULL'."""
    c = _c(col)
    if data_type in ("double", "float") or data_type.startswith("decimal"):
        # format_string would turn NULL into the text "nu" ("null" cut to 2), so test NULL first.
        txt = F.when(c.isNotNull(), F.format_string("%.2f", c))
    else:
        txt = c.cast("string")
    return F.coalesce(txt, F.lit("NULL"))


def row_json(cols: Sequence[str], prefix: str | None = None) -> Column:
    """Whole row as JSON text with NULL fields kept (``to_jsonb(row)``)."""
    fields = [F.col(f"{prefix}.{c}" if prefix else c).alias(c) for c in cols]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def minutes_before(ts: str | Column, minutes: int) -> Column:
    """``ts - INTERVAL minutes MINUTES``."""
    return _c(ts) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes), F.lit(0))


def map_get_default(m: str | Column, key: str | Column, default) -> Column:
    """``dict.get(key, default)`` on a map column."""
    k = key if isinstance(key, Column) else F.lit(key)
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.try_element_at(_c(m), k), d)
