"""Join helpers: configuration as local relations, broadcast only behind a size check."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Cap for hinting a broadcast: far above any policy, code or pattern table,
# far below an executor's memory.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
# Rows of one key that a task of a join takes, and the groups of keys in which they are counted.
SPREAD_ROWS = 200_000
SPREAD_GROUPS = 65_536


def values_frame(spark: SparkSession, rows: Iterable[Sequence], schema: str | T.StructType) -> DataFrame:
    """``rows`` as a local relation, whose exact size the optimizer knows.

    A frame from ``createDataFrame(list)`` is a scan of an RDD, whose size
    Spark takes to be unbounded; it would never pass the check below.
    """
    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = struct.fieldNames()
    table = pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=to_arrow_schema(struct))
    return spark.createDataFrame(table, schema=struct)


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate of ``df`` (no job runs); None for a client without plan access."""
    jdf = getattr(df, "_jdf", None)
    if jdf is None:
        return None
    return int(str(jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``broadcast(df)`` when its estimated size is at most ``max_bytes``; else ``df`` unchanged,
    so the planner (and AQE at run time) picks a shuffle join instead.
    """
    size = estimated_bytes(df)
    if size is not None and size <= max_bytes:
        return F.broadcast(df)
    return df


def spread_join(many: DataFrame, few: DataFrame, on: Sequence[str], most: int = SPREAD_ROWS, tasks: int | None = None) -> DataFrame:
    """Inner join on the columns ``on``, whatever share of the rows of ``many`` has one key.

    A small ``few`` is broadcast. Else the rows of ``many`` are counted by a
    digest of the key; those of a group of more than ``most`` are dealt to so
    many pieces, and the rows of ``few`` of that group go to each piece. Rows
    of groups that ``few`` does not have go no further. ``tasks`` fixes the
    number of tasks, where rows that pack well would leave a few large ones. A
    stream cannot be counted ahead and is joined as it is.
    """
    size = estimated_bytes(few)
    if many.isStreaming or (size is not None and size <= BROADCAST_MAX_BYTES):
        return many.join(broadcast_if_small(few), list(on))
    group = F.pmod(F.xxhash64(*on), F.lit(SPREAD_GROUPS)).alias("_group")
    counts = many.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_pieces"))
    # A row a group at most.
    pieces = F.broadcast(few.select(group).distinct().join(counts, "_group"))
    told = lambda df: df.select("*", group).join(pieces, "_group").drop("_group")
    dealt = told(many).withColumn("_piece", F.floor(F.rand(0) * F.col("_pieces")).cast("int")).drop("_pieces")
    spread = told(few).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_pieces")
    keys = [*on, "_piece"]
    if tasks:
        dealt, spread = dealt.repartition(tasks, *keys), spread.repartition(tasks, *keys)
    return dealt.join(spread, keys).drop("_piece")
