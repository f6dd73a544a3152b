"""Change-event source and sink (S16, S17): JSON envelopes with a ``detail`` struct.

Batch and streaming share one parser. A line is read as text and parsed once
to a VARIANT, which keeps it whole: fields nobody named, details of any type,
nested lists. The typed envelope that the operators work on is read from it. A
line that is no JSON gets an envelope without fields whose ``_corrupt_record``
holds its text, so the dead-letter step (T13) can route it aside instead of
failing the job; a field of the wrong kind is named there.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DETAIL_SCHEMA = T.StructType(
    [
        T.StructField("database", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("recordCount", T.LongType()),
        T.StructField("queryExecutionId", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("sourceAccount", T.StringType()),
    ]
)

ENVELOPE_SCHEMA = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("detail-type", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("account", T.StringType()),
        T.StructField("time", T.TimestampNTZType()),
        T.StructField("region", T.StringType()),
        T.StructField("detail", DETAIL_SCHEMA),
    ]
)

CORRUPT_FIELD = "_corrupt_record"
# An event without a detail may carry these at its root.
ROOT_FIELDS = [T.StructField("database", T.StringType()), T.StructField("table", T.StringType()), T.StructField("recordCount", T.LongType())]
INVALID_FIELD = "_invalid"
# The parsed struct: the envelope, the text of a line that did not parse, and the names of fields whose value is of the wrong kind.
PARSE_SCHEMA = T.StructType(
    ENVELOPE_SCHEMA.fields + ROOT_FIELDS + [T.StructField(CORRUPT_FIELD, T.StringType()), T.StructField(INVALID_FIELD, T.ArrayType(T.StringType()))]
)
# A date, a time with or without a fraction, and a zone or none.
TIME_TEXT = r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?\s*(Z|UTC|GMT|[+-][0-9]{2}(:?[0-9]{2})?)?)?\s*$"

# Microsecond timestamps in the JSON text, so a round trip is exact.
JSON_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def envelope(
    *,
    id: Column,
    detail_type: Column,
    source: Column,
    time: Column,
    detail: Column,
    account: Column | None = None,
    region: Column | None = None,
    version: str = "0",
) -> Column:
    """The envelope struct (field order as in ``ENVELOPE_SCHEMA``)."""
    return F.struct(
        F.lit(version).alias("version"),
        id.cast("string").alias("id"),
        detail_type.alias("detail-type"),
        source.alias("source"),
        (account if account is not None else F.lit(None).cast("string")).alias("account"),
        time.cast("timestamp_ntz").alias("time"),
        (region if region is not None else F.lit(None).cast("string")).alias("region"),
        detail.alias("detail"),
    )


def to_json_text(env: Column) -> Column:
    """Serialise an envelope to one JSON line (NULL fields kept)."""
    return F.to_json(env, JSON_OPTIONS)


def utc_time(text: Column) -> Column:
    """A timestamp text as the time it names in UTC, whatever its zone or the session's; one without a zone is UTC."""
    told = F.when(text.rlike(TIME_TEXT), F.btrim(text))
    # Zones are written with a colon for the cast; a time without one gets UTC.
    zoned = F.regexp_replace(F.regexp_replace(told, r"([+-][0-9]{2}):?([0-9]{2})$", "$1:$2"), r"(:[0-9.]+)\s*([+-][0-9]{2})$", "$1$2:00")
    has_zone = told.rlike(r"[0-9]{2}:[0-9.]+\s*(Z|UTC|GMT|[+-][0-9]{2}(:?[0-9]{2})?)$")
    there = F.when(has_zone, zoned).when(F.length(told) > 10, F.concat(told, F.lit("Z"))).otherwise(F.concat(told, F.lit("T00:00:00Z")))
    # By the instant, not by the session's local time, where an hour comes twice in autumn.
    return F.timestamp_add("MICROSECOND", F.unix_micros(there.try_cast("timestamp")), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def _path(names: list[str]) -> str:
    return "$" + "".join(f"['{n}']" for n in names)


def _as_text(kind: T.DataType) -> str:
    """The type ``kind`` as DDL, with its plain fields as strings."""
    return "struct<" + ", ".join(f"`{f.name}`: {_as_text(f.dataType)}" for f in kind.fields) + ">" if isinstance(kind, T.StructType) else "string"


# What a line's VARIANT is read as in one go: the fields of the typed envelope as text, a detail only where it is an object.
READ_FIELDS = [f for f in PARSE_SCHEMA.fields if f.name not in (CORRUPT_FIELD, INVALID_FIELD)]
TEXT_TYPE = _as_text(T.StructType(READ_FIELDS))


def with_envelope(whole: DataFrame, event: str = "event") -> DataFrame:
    """``whole`` with the typed envelope (``PARSE_SCHEMA``) of each line's ``raw`` VARIANT and ``value``.

    Every text is read and every time parsed once, in a projection of its own;
    the steps that follow only name the columns.
    """
    texts = whole.withColumn("_text", F.try_variant_get("raw", "$", TEXT_TYPE))
    text = lambda *names: functools.reduce(lambda c, n: c[n], names, F.col("_text"))
    counts = [["recordCount"], ["detail", "recordCount"]]
    typed = {".".join(w): F.coalesce(F.try_variant_get("raw", _path(w), "long"), text(*w).try_cast("long")) for w in counts} | {"time": utc_time(text("time"))}
    read = texts.withColumns({f"_typed {name}": c for name, c in typed.items()})
    of = lambda name: F.col(f"`_typed {name}`")

    def field(names: list[str], kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.when(text(*names).isNotNull(), F.struct(*[field([*names, f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return of(".".join(names)) if ".".join(names) in typed else text(*names)

    invalid = [F.when(text(*name.split(".")).isNotNull() & of(name).isNull(), F.lit(name)) for name in ("time", "recordCount", "detail.recordCount")]
    envelope = F.struct(
        *[field([f.name], f.dataType).alias(f.name) for f in READ_FIELDS],
        F.when(F.col("raw").isNull(), F.col("value")).alias(CORRUPT_FIELD),
        F.array_compact(F.array(*invalid)).alias(INVALID_FIELD),
    )
    return read.select(*whole.columns, envelope.alias(event))


def parsed_frame(text: DataFrame, value_col: str = "value") -> DataFrame:
    """Text lines → ``value``, ``event`` (typed envelope) and ``raw`` (VARIANT) — the shape every T-operator takes.

    Both columns come from a one-element ``explode``: predicates on the event
    (validity, routing) cannot be pushed below a generator, so each line is
    parsed exactly once. As a plain projection, Catalyst would inline the
    parse into every pushed-down predicate and parse a line once per field
    tested. What is exploded is computed in projections before it, since a
    generator shares no common subexpressions. A query that does not read
    ``raw`` does not carry it further.
    """
    value = F.col(value_col).alias("value")
    whole = text.select(value, F.explode(F.array(F.try_parse_json(F.col(value_col)))).alias("raw"))
    return with_envelope(whole, "_event").select("value", F.explode(F.array("_event")).alias("event"), "raw")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """S16 batch twin: JSON lines under ``path``."""
    return parsed_frame(spark.read.text(path))


def read_event_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """File-source stream of JSON lines; offsets in the checkpoint give exactly the new files."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return parsed_frame(r.load(path))


def publish(df: DataFrame, path: str, env_col: str = "event") -> None:
    """Append envelopes as JSON lines to the bus folder ``path``."""
    df.select(to_json_text(F.col(env_col)).alias("value")).write.mode("append").text(path)
