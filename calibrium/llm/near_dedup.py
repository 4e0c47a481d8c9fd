"""MinHash near-dedup with odd sketches (op1).

Texts become sets of word shingles. One pass computes `SAMPLES` MinHash samples
per set; bands of `BANDS * ROWS` of them propose candidates, and all samples
folded by parity into an odd sketch of `SKETCH_BITS` bits estimate the
similarity of a candidate pair from one XOR and population count. Candidates the sketch can't rule out are
confirmed on the full shingle sets.

Equal sets are one vertex. Every bucket has a centre, the member with the most
neighbours in all its buckets, and the members are compared with it first.
Pairs already in one component need no further comparison. What is left are
members outside their centre's component. One that was compared with the centre
can be linked only to a member that shares more than 0.46 of its own
differences from that centre (see `rest_of_differences`), so an index of such differences,
rarest first, gives its candidates; it stays small in a large group of copies
where nearly all pairs are almost similar.
Members the sketch told from the centre are compared with the members of other
components directly, by their sketches, in a join of which only pairs alike come
out. Together that finds the components that all pairs of all buckets would give.

At 85 % similarity 25 bands of 5 miss a pair with probability 4e-7, and the
sketch bound is five standard deviations wide. A link is missed at no other
point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._anchored import anchored
from ._kernels import SPACED, U64, as_longs, groups, hash_words, mix, shingle_hashes, stream, utf8
from ._shared import Tables, components, small_batches

BANDS, ROWS = 25, 5
#: Samples folded into a sketch (those of the bands among them), and its bits.
SAMPLES, SKETCH_BITS = 375, 2048
SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>"


def _signatures(shingle: int):
    samples = SAMPLES
    mul = (stream(21, samples) >> U64(32)).astype(np.uint32) | np.uint32(1)
    add = (stream(22, samples) >> U64(32)).astype(np.uint32)
    salt = stream(23, samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for lo, hi in groups(off):
                words, at = hash_words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], SPACED)
                sh, sh_at = shingle_hashes(words, at, shingle)
                n = hi - lo
                count, set_a, set_b = np.zeros(n, np.int64), np.zeros(n, U64), np.zeros(n, U64)
                for d in range(n):
                    own = np.sort(sh[sh_at[d] : sh_at[d + 1]])
                    if len(own):
                        own = own[np.concatenate(([True], own[1:] != own[:-1]))]
                        count[d] = len(own)
                        set_a[d], set_b[d] = own.sum(), mix(own ^ U64(0x5851F42D4C957F2D)).sum()
                full = np.flatnonzero(count)
                mins = np.empty((samples, len(full)), np.uint32)
                if len(full):
                    h32, starts = (sh >> U64(32)).astype(np.uint32), sh_at[:-1][full]
                    for i in range(samples):
                        mins[i] = np.minimum.reduceat(h32 * mul[i] + add[i], starts)
                bits = mix(mins.astype(U64) + salt[:, None])
                keys = np.zeros((len(full), BANDS), U64)
                for b in range(BANDS):
                    keys[:, b] = mix(bits[b * ROWS : (b + 1) * ROWS].sum(axis=0) + U64(b))
                at_bit = (bits >> U64(40)) % U64(SKETCH_BITS)
                sketch = np.zeros((len(full), SKETCH_BITS // 64), U64)
                rows = np.arange(len(full))
                for i in range(samples):
                    np.bitwise_xor.at(sketch, (rows, (at_bit[i] >> U64(6)).astype(np.int64)), U64(1) << (at_bit[i] & U64(63)))
                have = (count > 0).astype(np.int64)
                lists = lambda x, w: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(have * w))).astype(np.int32)), as_longs(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(count), as_longs(set_a), as_longs(set_b), lists(keys, BANDS), lists(sketch, SKETCH_BITS // 64)], names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"])

    return run


def sketch_distance_limit(percent: int) -> int:
    """Most differing sketch bits of a pair at the similarity, five deviations out."""
    k, n, far = SAMPLES, SKETCH_BITS, 1 - percent / 100
    differ = k * far + 5 * (k * far * (1 - far)) ** 0.5
    expected = n / 2 * (1 - (1 - 2 / n) ** (2 * min(differ, k)))
    return int(expected + 2 * expected**0.5) + 1


def rest_of_differences(percent: int) -> float:
    """Share of Dy of which one element more must hold an element of Dx.

    x is not linked to the centre c: |Dx| > f |x u c|, where Dx are the elements
    that one of x and c has alone and f = 1 - percent / 100. x and y are linked:
    |Dx| + |Dy| - 2 o <= f |x u y|, where o is how many the differences share.
    As |x u y| <= |x u c| + |Dy| - o, it follows that o > |Dy| (1 - f) / (2 - f).
    """
    f = 1 - percent / 100
    return 1 - (1 - f) / (2 - f)


def estimated_similarity(bits: int) -> float:
    """Similarity from the differing bits of two odd sketches."""
    k, n = SAMPLES, SKETCH_BITS
    return max(0.0, 1 + n / (4 * k) * float(np.log(max(1e-9, 1 - 2 * bits / n))))


def _confirm(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_id = anchor = None
        for batch in batches:
            a, role, b = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            buf, off = utf8(batch.column(5))
            out = []
            for lo, hi in groups(off):
                words, at = hash_words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], SPACED)
                sh, sh_at = shingle_hashes(words, at, shingle)
                for d in range(lo, hi):
                    own = np.unique(sh[sh_at[d - lo] : sh_at[d - lo + 1]])
                    if role[d] == 0:
                        anchor_id, anchor = a[d], own
                    elif a[d] == anchor_id and len(own):
                        at_own = np.searchsorted(anchor, own)
                        at_own[at_own == len(anchor)] = 0
                        both = int((anchor[at_own] == own).sum()) if len(anchor) else 0
                        if 100 * both >= percent * (len(own) + len(anchor) - both):
                            out.append((a[d], b[d]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return run


def _differences(shingle: int):
    """Per (anchor, other): the shingles that one of the two sets has alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_id = anchor = None
        for batch in batches:
            a, role, b = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            buf, off = utf8(batch.column(5))
            out_a, out_b, out_e = [], [], []
            for lo, hi in groups(off):
                words, at = hash_words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], SPACED)
                sh, sh_at = shingle_hashes(words, at, shingle)
                for d in range(lo, hi):
                    own = np.unique(sh[sh_at[d - lo] : sh_at[d - lo + 1]])
                    if role[d] == 0:
                        anchor_id, anchor = a[d], own
                    elif a[d] == anchor_id:
                        out_a.append(a[d])
                        out_b.append(b[d])
                        out_e.append(np.setxor1d(anchor, own, assume_unique=True).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_e, pa.list_(pa.int64()))], names=["a", "b", "e"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of `docs`.

    Null or wordless text: an empty set, linked with nothing, its own
    component. Null id: component_id null and kept false; it takes no part in
    linking. Repeated rows share their text and so their component; rows of one
    id with different texts are judged each by its own text. Empty table: no
    rows. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tables = Tables(spark, "near-dedup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tables.free()  # also makes the driver's heap smaller, which hundreds of plans have widened
    sig = tables.written(docs, _signatures(shingle), SIGNATURE)
    sets = sig.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = tables.kept(sets)
    info = reps.select("rep", "n_shingles", "sketch")

    held = reps.select("rep", F.posexplode("bands").alias("band", "value")).select("rep", F.xxhash64("band", "value").alias("bucket"))
    shared = held.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    held = tables.kept(held.join(shared, "bucket"))
    weight = held.groupBy("rep").agg(F.sum("size").alias("weight"))
    held = held.join(weight, "rep").select("bucket", "rep", "weight")
    centers = held.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("top")).select("bucket", (-F.col("top.minus")).alias("center"))
    members = tables.kept(held.select("bucket", "rep").join(centers, "bucket"))

    limit = sketch_distance_limit(percent)
    differ = F.aggregate(F.zip_with("a_sketch", "b_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    alike = (F.lit(100) * F.least("a_n", "b_n") >= F.lit(percent) * F.greatest("a_n", "b_n")) & (differ <= limit)
    side = lambda x: info.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch"))
    to_text = docs.where("doc_id is not null")

    pairs = members.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = tables.kept(pairs.join(side("a"), "a").join(side("b"), "b").where(alike).select("a", "b"))
    confirm = lambda p: anchored(tables, p.withColumn("info", F.lit(0)), to_text, _confirm(shingle, percent), "a long, b long")
    edges = confirm(pairs)

    # Members outside their centre's component.
    root = components(tables, edges)
    tables.free()
    label = lambda df, c, to: df.join(root.select(F.col("id").alias(c), F.col("root").alias("_r")), c, "left").withColumn(to, F.coalesce("_r", c)).drop("_r")
    state = tables.kept(label(label(members, "rep", "own"), "center", "main"))
    told = pairs.select(F.col("a").alias("center"), F.col("b").alias("rep"), F.lit(True).alias("told"))
    mixed = state.where("own <> main").select("bucket").distinct()
    state = tables.kept(state.join(mixed, "bucket").join(told, ["center", "rep"], "left").withColumn("told", F.coalesce("told", F.lit(False))))

    # Both compared with the centre: by their shared differences from it.
    far = tables.kept(state.where("own <> main and told").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct())
    around = pairs.join(far.select("a").distinct(), "a")
    differ_by = anchored(tables, around.withColumn("info", F.lit(0)), to_text, _differences(shingle), "a long, b long, e array<long>")
    sizes = info.select(F.col("rep").alias("b"), F.col("n_shingles").alias("size"))
    each = differ_by.join(sizes, "b").select("a", "b", "size", F.size("e").alias("n"), F.explode("e").alias("e"))
    often = each.groupBy("a", "e").agg(F.count("*").alias("often"))
    rare = each.join(often.where("often > 1"), ["a", "e"])
    first = Window.partitionBy("a", "b").orderBy("often", "e")
    # elements of no other document come first in the order and find nothing
    lone = each.join(often.where("often = 1"), ["a", "e"]).groupBy("a", "b").agg(F.count("*").alias("lone"))
    rare = rare.withColumn("i", F.row_number().over(first)).join(lone, ["a", "b"], "left").where(F.col("i") + F.coalesce("lone", F.lit(0)) <= F.floor(F.col("n") * rest_of_differences(percent) + 1e-9) + 1)
    x = each.join(far, ["a", "b"]).join(often.where("often > 1"), ["a", "e"]).select("a", "e", F.col("b").alias("x"), F.col("n").alias("x_n"), F.col("size").alias("x_size"))
    x = label(x, "x", "x_own")
    y = label(rare.select("a", "e", F.col("b").alias("y"), F.col("n").alias("y_n"), F.col("size").alias("y_size")), "y", "y_own")
    # | |Dx| - |Dy| | is at most the difference of x and y, which a link bounds
    near = F.abs(F.col("x_n") - F.col("y_n")) * (100 + percent) <= (F.col("x_size") + F.col("y_size")) * (100 - percent)
    by_difference = x.join(y, ["a", "e"]).where((F.col("x_own") != F.col("y_own")) & near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    by_difference = by_difference.join(side("a"), "a").join(side("b"), "b").where(alike).select("a", "b")

    # One of them the sketch told from the centre: directly, by sketches alone; the planner splits a large bucket.
    x = state.where("own <> main").select("bucket", F.col("told").alias("x_told"), F.col("rep").alias("b"), F.col("own").alias("b_own")).join(side("b"), "b")
    y = state.where("rep <> center").select("bucket", F.col("told").alias("y_told"), F.col("rep").alias("a"), F.col("own").alias("a_own"), "main").join(side("a"), "a")
    more = x.join(y, (x.bucket == y.bucket) & ~(F.col("x_told") & F.col("y_told")) & (F.col("a_own") != F.col("b_own")) & ((F.col("a_own") == F.col("main")) | (F.col("a") < F.col("b"))) & alike)
    more = tables.kept(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(by_difference).distinct())
    edges = edges.union(confirm(more))

    root = components(tables, edges).withColumnRenamed("id", "rep")
    tables.free()
    sets = reps.join(root, "rep", "left").select("set_a", "set_b", F.col("n_shingles").alias("n"), F.coalesce("root", "rep").alias("component"))
    found = sig.where("n_shingles > 0 and doc_id is not null").join(sets, ["set_a", "set_b"]).where("n = n_shingles").select("doc_id", "n_shingles", "component")
    none = sig.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    return found.union(none).select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"))
