"""The row-change audit as a stream (C1–C9): audit rows as changes arrive, against the last state of each key.

Every micro-batch writes its audit rows and then the rows it leaves behind,
each below its own epoch with overwrite, so a retried epoch replaces its own
output and reads the state that the first attempt read: that of the epochs
before it. The state is the set of these folders; the newest row of a key is
its state. ``compact`` folds them into one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from veilgrid.functions.joins import broadcast_if_small
from veilgrid.operators.audit import audit_pairs


class AuditStream:
    """Changed rows arrive as Parquet files below ``source``: whole rows with a key and a rising ``seq``.

    A key's first row is an insert and is not audited; each later one is
    compared with the one before it, in this micro-batch or an earlier one.
    Audit rows go to ``out/audit/batch_id=<epoch>``. ``seq`` itself is not audited.
    """

    def __init__(
        self, spark: SparkSession, source: str, out: str, ckpt: str, *, schema: str | T.StructType, keys: Sequence[str], seq: str, table: str, now=None, user=None, setting=None
    ):
        self.spark, self.source, self.out, self.ckpt = spark, source, out, ckpt
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.keys, self.seq = list(keys), seq
        self.audit = {"table": table, "now": now, "user": user, "setting": setting}

    def start(self) -> StreamingQuery:
        s = self.spark.readStream.schema(self.schema).parquet(self.source)
        return s.writeStream.foreachBatch(self._process).option("checkpointLocation", self.ckpt).trigger(availableNow=True).start()

    def state(self, before: int | None = None) -> DataFrame:
        """The newest row of every key in the epochs before ``before`` (all by default)."""
        kind = T.StructType([*self.schema.fields, T.StructField("epoch", T.IntegerType())])
        try:
            rows = self.spark.read.schema(kind).parquet(f"{self.out}/state")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], kind)
        if before is not None:
            rows = rows.filter(F.col("epoch") < before)
        return self._newest(rows)

    def _newest(self, rows: DataFrame) -> DataFrame:
        """Partial aggregation on the key: epochs meet combined, and no key's history is collected."""
        whole = F.struct(*self.schema.fieldNames())
        newest = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in self.keys]).agg(F.max_by(whole, F.struct("epoch", self.seq)).alias("r"))
        return newest.select("r.*")

    def _process(self, batch: DataFrame, epoch: int) -> None:
        cols = [c for c in self.schema.fieldNames() if c != self.seq]
        row = F.struct(*cols)
        batch = batch.persist()
        try:
            touched = broadcast_if_small(batch.select(*self.keys).distinct())
            known = self.state(epoch).join(touched, self.keys, "left_semi").select(*self.keys, row.alias("_known"))
            order = Window.partitionBy(*self.keys).orderBy(self.seq)
            pairs = batch.select(*self.keys, self.seq, row.alias("n"), F.lag(row).over(order).alias("_before")).join(known, self.keys, "left")
            pairs = pairs.select(*self.keys, self.seq, F.coalesce("_before", "_known").alias("o"), "n").filter("o is not null")
            out = audit_pairs(pairs, cols, carry=[*self.keys, self.seq], **self.audit)
            out.write.mode("overwrite").parquet(f"{self.out}/audit/batch_id={epoch}")
            self._keep_state(batch, epoch)
        finally:
            batch.unpersist()

    def _keep_state(self, batch: DataFrame, epoch: int) -> None:
        self._newest(batch.withColumn("epoch", F.lit(epoch))).write.mode("overwrite").parquet(f"{self.out}/state/epoch={epoch}")

    def compact(self, path: str) -> None:
        """The state as one folder elsewhere, from which a stream can be started anew as its first change file."""
        self.state().write.parquet(path)
