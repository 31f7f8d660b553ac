"""Stored entities: a shared folder of changes that batches and streams append to, read as a stream's rows or a table's latest."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rillstone.model import READ_ONLY, TABLE, WRITE_ONLY, Entity, ModelError
from rillstone.operators.bars import fill_gaps, rows_last
from rillstone.operators.windows import Frame

HIDDEN = T.StructType([T.StructField("_deleted", T.BooleanType()), T.StructField("_at", T.LongType()), T.StructField("_by", T.StringType()), T.StructField("_epoch", T.LongType())])


class ChangeLog:
    """Changes of one entity under `path`, a folder for each writer and epoch.

    A writer's epoch is written whole or again, so a batch that a stream repeats after a failure isn't there twice, and
    writers don't disturb each other. Readers find the latest row of a key by the time of writing, then by event time;
    a tombstone deletes its key. Nothing is rewritten: cost grows with the changes, and copy() starts a shorter log.
    """

    def __init__(self, spark: SparkSession, entity: Entity, path: str):
        self.spark, self.entity, self.path = spark, entity, path
        self._folder("").mkdirs(self._path(""))

    def _path(self, below: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}" if below else self.path)

    def _folder(self, below: str):
        return self._path(below).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, rows: DataFrame, by: str = "add", epoch: int | None = None, deleted: bool = False) -> None:
        """Rows with the entity's columns (tombstones: its keys); another write of the same writer and epoch replaces them."""
        if self.entity.access == READ_ONLY:
            raise ModelError(f"{self.entity.name} is read-only")
        if not re.fullmatch(r"[\w.-]+", by):
            raise ModelError("a writer's name is of letters, digits, _ . and -")
        now, schema = time.time_ns(), self.entity.schema()
        given = set(self.entity.keys) if deleted else set(schema.names)
        if missing := given - set(rows.columns):
            raise ModelError(f"{self.entity.name}: no column {sorted(missing)}")
        columns = [(F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        out = rows.select(*columns, F.lit(deleted).alias("_deleted"), F.lit(now).alias("_at"))
        out.write.mode("overwrite").parquet(f"{self.path}/_by={by}/_epoch={now if epoch is None else epoch}")

    def delete(self, keys: DataFrame, by: str = "remove", epoch: int | None = None) -> None:
        if not self.entity.keys:
            raise ModelError(f"{self.entity.name} has no key")
        self.write(keys.select(*self.entity.keys).distinct(), by, epoch, True)

    def changes(self) -> DataFrame:
        if self.entity.access == WRITE_ONLY:
            raise ModelError(f"{self.entity.name} is write-only")
        fields = [T.StructField(f.name, f.dataType) for f in self.entity.schema()]
        return self.spark.read.schema(T.StructType([*fields, *HIDDEN])).parquet(self.path)

    def read(self) -> DataFrame:
        """All rows of a stream; of a table the latest row of each key that isn't deleted."""
        rows, names = self.changes(), self.entity.schema().names
        if self.entity.kind == TABLE:
            rows = rows_last(rows, list(self.entity.keys), ["_at", *([self.entity.timestamp] if self.entity.timestamp else [])])
        return rows.where(~F.col("_deleted")).select(*names)

    def copy(self, path: str) -> ChangeLog:
        """A new log that holds only what read() gives."""
        made = ChangeLog(self.spark, self.entity, path)
        made.write(self.read(), "copy", 0)
        return made

    def follow(self, df: DataFrame, by: str, checkpoint: str, available_now: bool = True, mode: str | None = None) -> StreamingQuery:
        """Writes a stream into the log as it comes: changed rows of a table, new rows of a stream."""
        run = df.writeStream.outputMode(mode or ("update" if self.entity.kind == TABLE else "append")).queryName(by)
        run = run.foreachBatch(lambda batch, epoch: self.write(batch, by, epoch)).option("checkpointLocation", checkpoint)
        return (run.trigger(availableNow=True) if available_now else run).start()

    def follow_filled(self, bars: DataFrame, frame: Frame, by: str, checkpoint: str, close: str = "close", others: tuple[str, ...] = ("open", "high", "low"), available_now: bool = True) -> StreamingQuery:
        """As follow() for closed bars (a stream in append mode), with a flat bar in each empty bucket between a key's bars.

        The last bar of each key is kept beside the log, one small table for each epoch, made from the one before: a
        repeated epoch finds the same last bars. Only the last two are kept. A bar that comes after a later one of its key
        is written without filling.
        """
        keys = [k for k in self.entity.keys if k != "bucket"]
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in self.entity.schema()])
        prices = tuple(c for c in others if c in schema.names)

        def run(batch: DataFrame, epoch: int) -> None:
            beside = f"{self.path}/.last/{by}"
            batch.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.mode("overwrite").parquet(f"{beside}/new")
            before = [e for e in self._epochs(by) if e < epoch]
            held = self.spark.read.schema(schema).parquet(f"{beside}/{max(before)}") if before else self.spark.createDataFrame([], schema)
            last = held.select(*keys, F.col("bucket").alias("_last"))
            rows = self.spark.read.schema(schema).parquet(f"{beside}/new").join(last, keys, "left")
            late = F.col("bucket") <= F.coalesce("_last", F.lit("0001-01-01").cast(schema["bucket"].dataType))
            new = rows.where(~late).select(*schema.names)
            # a key without a new bar has only its old one, and that isn't written again
            both = held.withColumn("_old", F.lit(True)).unionByName(new.withColumn("_old", F.lit(False)))
            filled = fill_gaps(both, keys, frame, close, prices).where("filled or not _old").select(*schema.names)
            self.write(filled.unionByName(rows.where(late).select(*schema.names)), by, epoch)
            rows_last(held.unionByName(new), keys, ["bucket"]).select(*schema.names).write.mode("overwrite").parquet(f"{beside}/{epoch}")
            for old in sorted(before)[:-1]:
                self._folder("").delete(self._path(f".last/{by}/{old}"), True)

        writer = bars.writeStream.outputMode("append").queryName(by).foreachBatch(run).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def _epochs(self, by: str) -> list[int]:
        """Epochs of the last bars that were written whole."""
        fs, at = self._folder(""), self._path(f".last/{by}")
        if not fs.exists(at):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
        return [int(x) for x in found if x.isdigit() and fs.exists(self._path(f".last/{by}/{x}/_SUCCESS"))]
