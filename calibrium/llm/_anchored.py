"""Compare documents with an anchor document without gathering a group anywhere.

Pairs (a, b) become a sorted stream per (a, salt): the anchor's text first, then
the texts of the b's one by one. A group of any size is dealt to as many salts
as it needs, and a task holds one anchor and one other document at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Tables

PER_SALT = 32


def anchored(tables: Tables, pairs: DataFrame, docs: DataFrame, run, schema: str) -> DataFrame:
    """What `run(batches)` makes of rows (a, salt, role, b, info, text) in that order, as a written table.

    pairs: (a, b, info) with distinct (a, b); docs: (doc_id, text). role is 0
    for the anchor's row (b and info null there) and 1 for the others.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PER_SALT)).cast("int").alias("salts"))
    others = pairs.join(counts, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), "b", "info")
    info_type = pairs.schema["info"].dataType
    anchors = counts.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("b"), F.lit(None).cast(info_type).alias("info"))
    wanted = others.union(anchors)
    # a merge join at any size: the ids wanted grow with the documents
    rows = wanted.join(docs.select(F.col("doc_id").alias("id"), "text").hint("merge"), "id").select("a", "salt", "role", "b", "info", "text")
    out = tables.written(rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "b"), run, schema)
    tables.free()
    return out
