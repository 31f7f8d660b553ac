"""Sources and sinks: declared schemas over files and streams, upserts, tombstones, retention, and a Kafka seam."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillstone.model import READ_ONLY, WRITE_ONLY, Entity, ModelError
from rillstone.operators.bars import rows_last


def read(spark: SparkSession, entity: Entity, path: str, fmt: str = "parquet") -> DataFrame:
    """All rows with the entity's columns and types; zone-less times are UTC."""
    if entity.access == WRITE_ONLY:
        raise ModelError(f"{entity.name} is write-only")
    reader = spark.read.format(fmt)
    df = (reader if fmt == "parquet" else reader.schema(entity.schema())).load(path)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in entity.schema()])


def read_stream(spark: SparkSession, entity: Entity, path: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as they come, with the file's name and time beside the columns as message metadata."""
    raw = spark.read.format(fmt).load(path).schema if fmt == "parquet" else entity.schema()
    reader = spark.readStream.format(fmt).schema(raw)
    df = (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in entity.schema()])


def kafka(spark: SparkSession, entity: Entity, servers: str, from_beginning: bool = False, **options) -> DataFrame:
    """A topic's JSON values with key, partition, offset and time; needs Spark's Kafka connector on the class path."""
    df = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": entity.name, "startingOffsets": "earliest" if from_beginning else "latest", **options}).load()
    value = F.from_json(F.col("value").cast("string"), entity.schema())
    return df.select(value.alias("v"), F.col("partition").alias("_partition"), F.col("offset").alias("_offset"), F.col("timestamp").alias("_ts")).select("v.*", "_partition", "_offset", "_ts")


def write(df: DataFrame, entity: Entity, path: str, mode: str = "append", fmt: str = "parquet") -> None:
    if entity.access == READ_ONLY:
        raise ModelError(f"{entity.name} is read-only")
    (df.repartition(entity.partitions, *entity.keys) if entity.partitions and entity.keys else df).write.mode(mode).format(fmt).save(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True) -> StreamingQuery:
    writer = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def without_deleted(log: DataFrame, keys: list[str], order: list[str], deleted: str = "_deleted") -> DataFrame:
    """A table from its change log: the latest row of each key, unless that is a tombstone."""
    return rows_last(log, keys, order).where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)


def remove(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def retained(df: DataFrame, ts: str, now: str, milliseconds: int) -> DataFrame:
    """Rows no older than the retention before `now`."""
    return df.where(F.col(ts) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {milliseconds / 1000} SECONDS"))


def key_prefix(table: DataFrame, keys: list[str], values: tuple) -> DataFrame:
    """Rows whose leading key columns equal the values."""
    for k, v in zip(keys, values, strict=False):
        table = table.where(F.col(k) == F.lit(v))
    return table
