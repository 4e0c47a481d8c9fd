"""Resumable ingestion: rows committed once, by key, through Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, StructField, StructType


#: Keys of a part of the target: a range of so many for whole numbers, a hash's remainder for others.
RANGE, PARTS = 1_000_000, 64


def part_of(key: str, kind: DataType) -> Column:
    """The part a key belongs to, by which the target is laid out."""
    if isinstance(kind, (LongType, IntegerType)):
        return F.floor(F.col(key) / RANGE).cast("long")
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("long")


def commit_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str) -> int:
    """Append rows of new files in `source` whose key isn't in `target`; how many rows there are then.

    A restart goes on from the checkpoint. A batch that is run again adds
    nothing: its rows are in the target already. The target is partitioned by
    ranges of keys, and a batch reads only the parts its own keys lie in.
    """
    kind = StructType.fromDDL(schema)
    laid_out = StructType([*kind, StructField("_part", LongType())])

    def committed() -> DataFrame:
        return spark.read.schema(laid_out).parquet(target)

    def commit(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key]).withColumn("_part", part_of(key, kind[key].dataType))
        touched = [r["_part"] for r in fresh.select("_part").distinct().limit(PARTS + 1).collect()]
        try:
            done = committed()
            if len(touched) <= PARTS:  # more parts than that: all are read
                known = [p for p in touched if p is not None]
                done = done.where(F.col("_part").isin(known) | F.lit(len(known) < len(touched)) & F.col("_part").isNull())
            fresh = fresh.join(done.select(key), key, "left_anti").select(laid_out.names)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").partitionBy("_part").parquet(target)

    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 64).parquet(source)
    stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return committed().count()


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Keys committed more than once; must be empty."""
    return rows.groupBy(key).count().where("count > 1")
