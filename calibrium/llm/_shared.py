"""What the operators share: the shared folder, written tables, order and components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ._files import make_folder, opened


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir.

    Only on one machine (a local master, as in tests) is one made and set where
    the session names none; elsewhere that is a ValueError.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="calibrium-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/calibrium-{name}-{uuid.uuid4().hex}"


class Tables:
    """Tables written to the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, shared_folder(spark, name), 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/t{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._calibrium_path = path
        return out

    def written(self, rows: DataFrame, run, schema: str | StructType) -> DataFrame:
        """The rows that `run` makes of `rows`, written where they are made.

        As `cut(rows.mapInArrow(run, schema))`, but they don't go back through
        the JVM. Each task writes a file of its own name and returns the name,
        so the table is the files of the attempts that succeeded; nothing is
        renamed, and what a lost executor leaves is not read.
        """
        self.n += 1
        folder = f"{self.folder}/t{self.n}"
        make_folder(folder)
        kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        made = rows.mapInArrow(_file_writer(folder, run, to_arrow_schema(kind)), "uri string")
        names = [r["uri"] for r in made.collect()]
        # its plan has the shuffles; Python would give it up some seconds later
        self.spark.sparkContext._gateway.detach(made._jdf)
        out = self.spark.read.schema(kind).parquet(*sorted(names)) if names else self.spark.createDataFrame([], kind)
        out._calibrium_path = folder
        return out

    def kept(self, df: DataFrame) -> DataFrame:
        """As `cut`, by `written`: for operators that run Python anyway."""
        names, own = [f"c{i}" for i in range(len(df.columns))], df.columns
        plain = df.toDF(*names)
        schema = StructType([StructField(n, f.dataType) for n, f in zip(names, df.schema)])
        out = self.written(plain, iter, schema)
        path, out = out._calibrium_path, out.toDF(*own)
        out._calibrium_path = path
        return out

    def free(self) -> None:
        """Let Spark delete the shuffle files of finished jobs now.

        It does so for what the driver's collector has found unused, which may
        take half an hour else; meanwhile each shuffle of texts stays on disk.
        """
        for _ in range(2):
            gc.collect()
            time.sleep(0.3)  # Python's references are given up by a thread of their own
            self.spark._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        delete(self.spark, df._calibrium_path)


#: Bytes of rows that are written together.
ROW_GROUP = 16 << 20


def _file_writer(folder: str, run, schema: pa.Schema):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.parquet"
        writer, held, size = None, [], 0

        def flush() -> None:
            nonlocal writer, held, size
            if held:
                if writer is None:
                    f, path = opened(uri)
                    writer = pq.ParquetWriter(path, schema, filesystem=f, compression="zstd")
                writer.write_table(pa.Table.from_batches(held, schema))
            held, size = [], 0

        for batch in run(batches):
            if batch.num_rows:
                held += pa.Table.from_batches([batch]).select(schema.names).cast(schema).to_batches()
                size += batch.nbytes
                if size >= ROW_GROUP:
                    flush()
        flush()
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"uri": [uri]})

    return write


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows: memory of Python workers follows batch bytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(tables: Tables, edges: DataFrame) -> DataFrame:
    """(id, root): every vertex of `edges` (a, b) with the smallest id it reaches.

    Alternates the large-star and small-star steps on the edge table until it
    no longer changes, which takes a logarithmic number of rounds. Only the
    edge table moves; a vertex with very many edges is reduced by a partial
    minimum and its join is split by the adaptive planner.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen = tables.kept(e), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = tables.kept(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        tables.drop(e)
        e = tables.kept(small)
        tables.drop(large)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def ordered_buckets(df: DataFrame, key: str, rows_per_bucket: int = 1024, bounds_at_most: int = 8192) -> tuple[DataFrame, int]:
    """Adds `bucket`, a number that rises with the numeric `key`; equal keys share one.

    Bounds are quantiles from one pass over the key column alone; each row finds
    its place among them by binary search. Where `bounds_at_most` of them, which
    travel with the plan, make larger buckets than wanted, keys between two
    bounds are dealt evenly by their distance from the lower one, so buckets
    keep their size at any number of rows. Null keys: bucket -1.
    """
    n, low, high = df.agg(F.count(key), F.min(key), F.max(key)).first()
    k = max(1, min(bounds_at_most, n // rows_per_bucket))
    bounds: list = []
    if k > 1:
        qs = F.array(*[F.lit(i / k) for i in range(1, k)])
        bounds = sorted(set(df.agg(F.percentile_approx(key, qs, F.lit(max(10000, 10 * k)))).first()[0] or []))
    at = F.lit(0)
    if bounds:
        table = F.lit(bounds)
        steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
        # the number of bounds below the key
        below = lambda lo, step: (lo + step <= len(bounds)) & (F.get(table, lo + step - 1) < F.col(key))
        at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, step: F.when(below(lo, step), lo + step).otherwise(lo))
    each = -(-n // (k * rows_per_bucket))
    df = df.withColumn("_at", at.cast("long"))
    if each > 1 and n:
        ends = F.lit([float(low), *map(float, bounds), float(high)])
        from_, to = F.get(ends, F.col("_at").cast("int")), F.get(ends, F.col("_at").cast("int") + 1)
        inner = F.floor((F.col(key).cast("double") - from_) / F.greatest(to - from_, F.lit(1.0)) * F.lit(each))
        df = df.withColumn("_at", F.col("_at") * F.lit(each) + F.greatest(F.lit(0), F.least(F.lit(each - 1), inner)))
    return df.withColumn("bucket", F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.col("_at").cast("long"))).drop("_at"), (len(bounds) + 1) * max(1, each)
