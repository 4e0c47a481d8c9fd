"""Work in blocks that are done once: a run goes on where the last one stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from ..sources.store import Files


class BlockStore:
    """Results of blocks in a folder, each with a mark that is put when it is complete."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark)

    def done(self) -> set[str]:
        return set(self.files.names(f"{self.folder}/done"))

    def run(self, blocks: Iterable[str], work: Callable[[str], DataFrame]) -> list[str]:
        """Do the blocks that are not done yet; their names. One that was left half done is done anew."""
        new = [b for b in blocks if b not in self.done()]
        for b in new:
            work(b).write.mode("overwrite").parquet(f"{self.folder}/rows/{b}")
            self.files.publish(f"{self.folder}/done/{b}", b)
        return new

    def rows(self) -> DataFrame | None:
        """The rows of all blocks that are done."""
        done = sorted(self.done())
        return self.spark.read.parquet(*[f"{self.folder}/rows/{b}" for b in done]) if done else None
