"""Structured Streaming event pipeline.

Topology (all file-based, so it runs anywhere Spark runs):

    bus A ──► forwarder (T3: pattern filter, JSON passes through) ──► bus B
    bus A ∪ bus B ──► parse ──► valid / dead letters (T13)
                  ──► route (T2) ──► dropDuplicatesWithinWatermark on arrival (T4)
                  ──► foreachBatch: normalise (T5), quality gate (T7),
                      export of the changed tables' rows (T8), archive (T10),
                      notifications (T11)

Every sink of a micro-batch writes to its own folder with overwrite (exports
to the path that the notification names, the others to ``…/batch_id=<epoch>``),
so a retried epoch (task retry, executor loss, restart from the checkpoint)
replaces its own output instead of duplicating it (T12). Offsets live in the
checkpoint folder, so each file of the bus is processed once (T9).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from veilgrid.functions.joins import broadcast_if_small
from veilgrid.operators.audit import ts_literal
from veilgrid.operators.events import (
    EXPORT_STAMP,
    archive,
    dead_letters,
    export_path,
    forward,
    normalize_event,
    notifications,
    quality_gate,
    route_events,
    valid_events,
)
from veilgrid.session import scratch_root
from veilgrid.sources.events import DETAIL_SCHEMA, envelope, parsed_frame, publish, read_event_stream
from veilgrid.sources.sinks import export_csv


def run_forwarder(
    spark: SparkSession, bus_in: str, bus_out: str, pattern: Mapping[str, Sequence], ckpt: str, max_files: int | None = None
) -> StreamingQuery:
    """Copy the events matching ``pattern`` from one bus to another (JSON text unchanged)."""
    s = read_event_stream(spark, bus_in, max_files)
    fwd = forward(valid_events(s), pattern).select("value")
    return (
        fwd.writeStream.format("text")
        .option("path", bus_out)
        .option("checkpointLocation", ckpt)
        .trigger(availableNow=True)
        .start()
    )


@dataclass
class ExportTable:
    """A table whose rows are exported when an event says that it changed: its rows and its key."""

    rows: DataFrame
    keys: Sequence[str]


def with_location(df: DataFrame, base: str, tables: Sequence[str]) -> DataFrame:
    """Normalised events with ``export_location``: one export per changed table, stamped with its latest event.

    Events of a table that is not in ``tables`` (``db.table`` names) have none.
    """
    known = F.concat_ws(".", "database", "table").isin(*tables) if tables else F.lit(False)
    last = df.filter(known).groupBy("database", "table").agg(F.max("event_time").alias("_last"))
    last = last.withColumn("export_location", export_path(base, F.col("database"), F.col("table"), F.col("_last")))
    # One row per configured table at most, so the broadcast's size is bounded by the configuration.
    return df.join(F.broadcast(last.drop("_last")), ["database", "table"], "left")


def written(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has finished: its success mark lies there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def export_new(table: ExportTable, ledger: str, epoch: int) -> DataFrame:
    """T9 in the stream: the rows of ``table`` that no earlier epoch exported.

    The ledger below ``ledger`` holds the keys of each epoch in a folder of its
    own, written before the rows are. An epoch that finds its own folder done is
    a retried one: it gets exactly those keys again, whatever the table has got
    since. One writer at a time. Rows whose key holds a NULL have no identity
    and go out every time.
    """
    spark = table.rows.sparkSession
    own, keys = f"{ledger}/epoch={epoch}", list(table.keys)
    if not written(spark, own):
        new = table.rows.select(*keys).distinct()
        schema = T.StructType([*new.schema.fields, T.StructField("epoch", T.IntegerType())])
        try:
            known = spark.read.schema(schema).parquet(ledger).filter(F.col("epoch") < epoch)
            new = new.join(known, keys, "left_anti")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        new.write.mode("overwrite").parquet(own)
    return table.rows.join(spark.read.schema(table.rows.select(*keys).schema).parquet(own), keys, "left_semi")


class EventConsumer:
    """The consumer side: dead letters, routing, de-duplication and the per-batch steps.

    ``tables`` maps ``db.table`` to the rows to export when it changes: all of
    them each time, or with ``only_new`` those that no earlier epoch exported
    (see ``export_new``), in a folder of the epoch. An
    event is processed once if its copies arrive within ``dedupe_delay`` of
    each other. The delay runs on arrival, not on the event's own time, so an
    event that comes days late is processed like any other.
    """

    def __init__(
        self,
        spark: SparkSession,
        buses: Sequence[str],
        out_dir: str,
        ckpt_dir: str,
        rules: Mapping[str, Mapping[str, Sequence]],
        *,
        default_database: str,
        default_table: str,
        tables: Mapping[str, ExportTable] | None = None,
        quality_rules: Mapping[str, object] | None = None,
        now: str = "2024-02-01 12:00:00",
        dedupe_delay: str = "1 day",
        max_files: int | None = None,
        export_base: str | None = None,
        only_new: bool = False,
    ):
        self.only_new = only_new
        self.export_base = export_base or out_dir
        self.spark, self.buses, self.out, self.ckpt = spark, list(buses), out_dir, ckpt_dir
        self.rules, self.now, self.delay = dict(rules), now, dedupe_delay
        self.quality_rules = quality_rules
        self.tables = dict(tables or {})
        self.defaults = (default_database, default_table)
        self.max_files = max_files

    def _source(self, buses: Sequence[str] | None = None) -> DataFrame:
        frames = [read_event_stream(self.spark, b, self.max_files) for b in (buses or self.buses)]
        src = frames[0]
        for f in frames[1:]:
            src = src.unionByName(f)
        return src.drop("raw")

    def start_dead_letters(self) -> StreamingQuery:
        """Bad lines of the producer bus (the first one) to their own append-only sink.

        Forwarded buses carry only events that already parsed and matched a rule.
        """
        # The day of arrival is the micro-batch's, which a retried one repeats.
        dl = dead_letters(self._source(self.buses[:1])).select("value", "reason", F.current_date().alias("arrived"))

        def keep(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").partitionBy("arrived").parquet(f"{self.out}/dead_letters/batch_id={epoch}")

        return dl.writeStream.foreachBatch(keep).option("checkpointLocation", f"{self.ckpt}/dead_letters").trigger(availableNow=True).start()

    def _dead_letter_days(self) -> list[tuple]:
        """(file system, folder, day) of the dead letters."""
        spark = self.spark
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/dead_letters/batch_id=*/arrived=*")
        fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
        return [(fs, s.getPath(), s.getPath().getName().removeprefix("arrived=")) for s in (fs.globStatus(place) or [])]

    def redrive(self, bus: str, mend: Callable[[Column], Column], today: str, days: int = 14) -> DataFrame:
        """Dead letters not older than ``days`` go back to ``bus`` where ``mend`` makes their line valid.

        Returns those that stay broken. A line sent back is an event like any
        other and is de-duplicated by its id, so doing this twice does no harm.
        """
        kept = self.spark.read.parquet(f"{self.out}/dead_letters").filter(F.col("arrived") > F.date_sub(F.lit(today).cast("date"), days))
        mended = parsed_frame(kept.select("reason", "arrived", mend(F.col("value")).alias("value"))).drop("raw")
        valid_events(mended).select("value").write.mode("append").text(bus)
        return dead_letters(mended).select("value", "reason")

    def drop_old_dead_letters(self, today: str, days: int = 14) -> int:
        """Removes the dead letters of days that lie ``days`` or more before ``today``; returns how many days went.

        A day of a micro-batch is a folder, so nothing is read or rewritten.
        """
        limit = (date.fromisoformat(today) - timedelta(days=days)).isoformat()
        old = [(fs, place, day) for fs, place, day in self._dead_letter_days() if day <= limit]
        for fs, place, _ in old:
            fs.delete(place, True)
        return len({day for _, _, day in old})

    def start(self) -> StreamingQuery:
        s = valid_events(self._source())
        s = route_events(s, self.rules).drop("rule")
        s = s.withColumn("_id", F.col("event.id")).withColumn("_arrived", F.current_timestamp())
        # T4: the same event reaches the consumer on two paths; state is kept only for the delay. The
        # time of a micro-batch is kept in the offset log, so a retried one gets the same.
        s = s.withWatermark("_arrived", self.delay).dropDuplicatesWithinWatermark(["_id"])
        return (
            s.drop("_id", "_arrived")
            .writeStream.foreachBatch(self._process_batch)
            .option("checkpointLocation", f"{self.ckpt}/main")
            .trigger(availableNow=True)
            .start()
        )

    def _process_batch(self, batch: DataFrame, epoch: int) -> None:
        now = ts_literal(self.now)
        n = normalize_event(batch, *self.defaults)
        if self.quality_rules:
            n = quality_gate(n, self.quality_rules)
        cached = n.persist()
        n = cached
        try:
            # The batch that only advances the watermark (state eviction) has no rows: write nothing.
            if n.isEmpty():
                return
            if self.quality_rules:
                n.filter(~F.col("accepted")).select("event_id", "failed_rules", "value").write.mode("overwrite").parquet(
                    f"{self.out}/rejected/batch_id={epoch}"
                )
                n = n.filter(F.col("accepted"))
            base = f"{self.export_base}/batch_id={epoch}" if self.only_new else self.export_base
            n = with_location(n, base, list(self.tables))
            self._export(n, base, epoch)
            archive(n, now).select("event_id", "database", "table", "record_count", "archive_status", "archived_at").write.mode(
                "overwrite"
            ).parquet(f"{self.out}/archive/batch_id={epoch}")
            notifications(n, now, *self.defaults).select("event_id", "export_location", "subject", "message").write.mode(
                "overwrite"
            ).parquet(f"{self.out}/notifications/batch_id={epoch}")
        finally:
            cached.unpersist()

    def _export(self, n: DataFrame, base: str, epoch: int) -> None:
        """The rows of every table that changed, or its new ones, in key order, where the notifications say.

        At most one row per configured table comes to the driver.
        """
        changed = n.filter(F.col("export_location").isNotNull()).groupBy("database", "table")
        for r in changed.agg(F.date_format(F.max("event_time"), EXPORT_STAMP).alias("stamp")).collect():
            name = f"{r['database']}.{r['table']}"
            t = self.tables[name]
            rows = export_new(t, f"{self.out}/ledger/{name}", epoch) if self.only_new else t.rows
            export_csv(rows, base, r["database"], r["table"], r["stamp"], order_by=t.keys)


def write_batch(df: DataFrame, table_path: str, batch_id: str) -> int:
    """T1, first step: ``df`` becomes the batch ``batch_id`` of the table; returns its rows.

    The rows go to the batch's own folder, then a manifest says that they are
    there. A call that finds the manifest has nothing to do, and one that finds
    rows without it replaces them, so a retry after a failure at any point
    leaves the batch once. Rows without a manifest are not part of the table
    (``read_batches``).
    """
    spark = df.sparkSession
    manifest = f"{table_path}/_manifest/batch_id={batch_id}"
    if not written(spark, manifest):
        obs = Observation(f"batch {batch_id}")
        df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{table_path}/batch_id={batch_id}")
        spark.range(1).select(F.lit(int(obs.get["rows"])).cast("long").alias("rows")).write.mode("overwrite").parquet(manifest)
    return int(spark.read.parquet(manifest).first().rows)


def _batches(spark: SparkSession, path: str) -> DataFrame:
    """(rows, batch_id) of the manifests or marks below ``path``."""
    try:
        return spark.read.schema("rows long, batch_id string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "rows long, batch_id string")


def read_batches(spark: SparkSession, table_path: str) -> DataFrame:
    """The rows of all batches that have a manifest, with their ``batch_id``; others are pruned as partitions."""
    rows = spark.read.option("basePath", table_path).parquet(table_path).withColumn("batch_id", F.col("batch_id").cast("string"))
    return rows.join(broadcast_if_small(_batches(spark, f"{table_path}/_manifest").select("batch_id")), "batch_id", "left_semi")


def publish_batches(
    spark: SparkSession, table_path: str, bus_path: str, *, database: str, table: str, now: str, source: str = "app.writer", detail_type: str = "Data Table Updated"
) -> int:
    """T1, second step: one change event for every batch that has a manifest and no mark; returns their number.

    An event's id is its batch's, so a batch that is published and loses its
    mark to a failure is published again as the same event, which consumers
    take once (T4). No event is lost and none tells of rows that are not there.
    """
    pending = _batches(spark, f"{table_path}/_manifest").join(_batches(spark, f"{table_path}/_published").select("batch_id"), "batch_id", "left_anti")
    pending = spark.createDataFrame(pending.collect(), "batch_id string, rows long")  # one row a batch that waits
    detail = F.struct(
        F.lit(database).alias("database"), F.lit(table).alias("table"), F.lit("INSERT").alias("operation"), F.col("rows").alias("recordCount"),
        F.col("batch_id").alias("queryExecutionId"), F.date_format(ts_literal(now), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), F.lit(None).cast("string").alias("sourceAccount"),
    ).cast(DETAIL_SCHEMA)
    event = envelope(id=F.col("batch_id"), detail_type=F.lit(detail_type), source=F.lit(source), time=ts_literal(now), detail=detail)
    n = pending.count()
    if n:
        publish(pending.select(event.alias("event")), bus_path)
        # As rows of one file, so all of these batches are marked or none.
        pending.select("rows", "batch_id").coalesce(1).write.mode("append").parquet(f"{table_path}/_published")
    return n


def write_and_publish(
    df: DataFrame,
    table_path: str,
    bus_path: str,
    *,
    database: str,
    table: str,
    event_id: str,
    now: str,
    source: str = "app.writer",
    detail_type: str = "Data Table Updated",
) -> dict:
    """Append ``df`` to a table, then publish one change event — only if the write succeeded.

    The record count comes from an observed metric of the write itself, not a
    second scan. Returns both outcomes.
    """
    obs = Observation("write")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    try:
        observed.write.mode("append").parquet(table_path)
    except Exception as e:  # noqa: BLE001 — the outcome is reported, not raised
        return {"written": False, "published": False, "error": str(e), "rows": 0}
    rows = int(obs.get["rows"])
    spark = df.sparkSession
    detail = F.struct(
        F.lit(database).alias("database"),
        F.lit(table).alias("table"),
        F.lit("INSERT").alias("operation"),
        F.lit(rows).cast("long").alias("recordCount"),
        F.lit(None).cast("string").alias("queryExecutionId"),
        F.date_format(ts_literal(now), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.lit(None).cast("string").alias("sourceAccount"),
    ).cast(DETAIL_SCHEMA)
    ev = spark.range(1).select(
        envelope(
            id=F.lit(event_id),
            detail_type=F.lit(detail_type),
            source=F.lit(source),
            time=ts_literal(now),
            detail=detail,
        ).alias("event")
    )
    try:
        publish(ev, bus_path)
    except Exception as e:  # noqa: BLE001
        return {"written": True, "published": False, "error": str(e), "rows": rows}
    return {"written": True, "published": True, "error": None, "rows": rows}
