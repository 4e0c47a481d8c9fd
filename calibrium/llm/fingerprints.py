"""One-permutation MinHash fingerprints, in DataFrame expressions alone (op5).

Each five-word shingle is hashed once. The top bits of the hash name one of
`BINS` bins and the least hash of a bin is its sample. An empty bin borrows the
sample of a full one that an independent random sequence of its own picks
(optimal densification), so equal bins of two texts agree with a probability of
their Jaccard similarity. Only the lowest `BITS` bits of a sample are stored;
two unrelated samples then agree by chance with probability 2**-BITS, which
`likeness` takes off.

Texts are dealt to buckets of ascending id, which one shuffle of the texts
brings together; everything after that (the next text, the shingles as rows,
the least hash of each bin, the packed bins) groups by that bucket first and
needs no other shuffle. The hot loop is generated code: splitting, hashing and
a hash aggregation. Only the last step works on arrays, one of BINS for a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Tables, ordered_buckets

#: 2**BIN_BITS bins of BITS bits.
BIN_BITS, BITS, SHINGLE = 7, 8, 5
BINS = 1 << BIN_BITS
#: Bins whose stored bits share a 64-bit number.
PER_WORD = 64 // BITS
#: Random picks an empty bin tries before it takes the closest full bin of an order of its own.
TRIES = 12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Lower-cased words between white space; fewer than SHINGLE, but not none, are filled up with nulls."""
    trimmed = F.regexp_replace(F.lower(text), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed != "", F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def least_hashes(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and `bins`, array<tinyint> with null for empty bins, of texts with words.

    texts: (keys, text). Where `texts` is dealt by some of the keys, no shuffle.
    Words are zipped with those 1, 2, ... places on, so a shingle is a row; a
    hash skips nulls, so a short text's one shingle is all its words.
    """
    rows = texts.select(*keys, words_of(F.col("text")).alias("words"))
    n = F.size("words")
    filled = F.when((n > 0) & (n < SHINGLE), F.concat("words", F.array_repeat(F.lit(None).cast("string"), SHINGLE - n))).otherwise(F.col("words"))
    rows = rows.select(*keys, filled.alias("words"))
    n = F.greatest(F.size("words") - (SHINGLE - 1), F.lit(0))
    rows = rows.select(*keys, F.explode(F.arrays_zip(*[F.slice("words", j + 1, n) for j in range(SHINGLE)])).alias("s")).select(*keys, "s.*").toDF(*keys, *[f"w{j}" for j in range(SHINGLE)])
    rows = rows.select(*keys, F.xxhash64(*[f"w{j}" for j in range(SHINGLE)]).alias("h"))
    rows = rows.select(*keys, F.shiftrightunsigned("h", 64 - BIN_BITS).cast("int").alias("bin"), "h")
    least = rows.groupBy(*keys, "bin").agg(F.min("h").alias("h"))
    word, at = F.floor(F.col("bin") / PER_WORD).cast("int"), F.col("bin") % PER_WORD
    low = F.col("h").bitwiseAND(F.lit((1 << BITS) - 1))
    # the shifts are of columns, which only SQL's function takes
    stored = least.select(*keys, word.alias("word"), at.alias("at"), low.alias("low"))
    packs = stored.groupBy(*keys, "word").agg(F.expr(f"sum(shiftleft(low, at * {BITS}))").alias("v"), F.expr("sum(shiftleft(1, at))").alias("full"))
    n = BINS // PER_WORD
    across = [F.max(F.when(F.col("word") == k, F.col(c))).alias(f"{c}{k}") for k in range(n) for c in ("v", "full")]
    wide = packs.groupBy(*keys).agg(*across)
    v, full = F.array(*[f"v{k}" for k in range(n)]), F.array(*[F.coalesce(f"full{k}", F.lit(0)) for k in range(n)])
    wide = wide.select(*keys, v.alias("v"), full.alias("full"))
    each = f"transform(sequence(0, {BINS - 1}), i -> if((shiftright(full[i div {PER_WORD}], i % {PER_WORD}) & 1) = 1, cast((shiftright(v[i div {PER_WORD}], (i % {PER_WORD}) * {BITS}) & {(1 << BITS) - 1}) - {1 << (BITS - 1)} as tinyint), null))"
    return wide.select(*keys, F.expr(each).alias("bins"))


def densified(bins: Column) -> Column:
    """Every empty bin with the sample of a full one; at least one must be full."""

    def densify(o: Column) -> Column:
        def attempt(now: Column, t: Column) -> Column:
            filled = F.transform(now, lambda v, i: F.coalesce(v, F.get(o, F.pmod(F.xxhash64(i, t), F.lit(BINS)).cast("int"))))
            return F.when(F.exists(now, lambda v: v.isNull()), filled).otherwise(now)

        def closest(i: Column) -> Column:
            full = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get(o, j).isNotNull())
            return F.array_min(F.transform(full, lambda j: F.struct(F.xxhash64(j, i).alias("order"), F.get(o, j).alias("v"))))["v"]

        tried = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), o, attempt)
        return F.transform(tried, lambda v, i: F.coalesce(v, closest(i)))

    return F.when(F.exists(bins, lambda v: v.isNotNull()), let(bins, densify)).otherwise(F.array().cast("array<tinyint>"))


def packed(bins: Column) -> Column:
    """Fingerprint of samples: BITS / 4 hexadecimal digits for each bin."""
    digits = F.lit([f"{b:0{BITS // 4}x}" for b in range(1 << BITS)])
    return F.array_join(F.transform(bins, lambda v: F.get(digits, v.cast("int") + (1 << (BITS - 1)))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts from their samples, 0 to 1.

    Two texts without words are alike (1), one without and one with are not (0).
    """
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    chance = 2.0**-BITS
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every distinct id; null text counts as empty.

    Of an id with several texts, the fingerprint is that of all their shingles.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bins = least_hashes(docs.repartition("doc_id"), ["doc_id"])
    joined = docs.select("doc_id").distinct().join(bins, "doc_id", "left")
    return joined.select("doc_id", F.coalesce(packed(densified(F.col("bins"))), F.lit("")).alias("fingerprint"))


def _after(buckets: DataFrame) -> DataFrame:
    """(bucket, after): the next bucket, after the last the first. One row a bucket, of a bounded number."""
    first = F.min("bucket").over(Window.partitionBy(F.lit(0)))
    return buckets.withColumn("after", F.coalesce(F.lead("bucket").over(Window.orderBy("bucket")), first))


def fingerprints_of_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts, of their edited forms, and how alike they are.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next). The edit replaces the last half of a text by the
    beginning of the next text by ascending id, after the last the first. Null
    text is empty, and a text without words has an empty fingerprint. Null ids
    come first; repeated rows follow one another, each with its own row. Empty
    table: no rows. Other columns are not read.
    """
    tables = Tables(docs.sparkSession, "fingerprints")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt, _ = ordered_buckets(docs, "doc_id")
    inside = Window.partitionBy("bucket").orderBy("doc_id", "text")
    firsts = dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("first")).select(F.col("bucket").alias("after"), F.col("first.text").alias("bridge"))
    bridge = _after(dealt.select("bucket").distinct()).join(firsts, "after").select("bucket", "bridge")
    led = dealt.select("bucket", "doc_id", "text", F.row_number().over(inside).alias("row"), F.lead("text").over(inside).alias("led")).join(bridge, "bucket")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("led", "bridge"), F.lit(1), half))
    base = led.select("bucket", "row", "doc_id", "text", edited.alias("edited"))

    both = base.select("bucket", "row", F.explode(F.array(F.struct(F.lit(0).alias("kind"), "text"), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("x")).select("bucket", "row", "x.kind", "x.text")
    bins = least_hashes(both, ["bucket", "row", "kind"])
    pair = bins.groupBy("bucket", "row").agg(F.max(F.when(F.col("kind") == 0, F.col("bins"))).alias("own"), F.max(F.when(F.col("kind") == 1, F.col("bins"))).alias("changed"))
    rows = base.select("bucket", "row", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")).join(pair, ["bucket", "row"], "left")
    none = F.array().cast("array<tinyint>")
    rows = tables.cut(rows.withColumns({c: F.coalesce(densified(F.col(c)), none) for c in ("own", "changed")}))

    heads = rows.where("row = 1").select(F.col("bucket").alias("after"), F.col("own").alias("bridge"))
    bridge = _after(rows.select("bucket").distinct()).join(heads, "after").select("bucket", "bridge")
    led = rows.withColumn("led", F.lead("own").over(Window.partitionBy("bucket").orderBy("row"))).join(bridge, "bucket").withColumn("after", F.coalesce("led", "bridge"))
    return led.select("doc_id", "n_chars", "edited_sha256", packed(F.col("own")).alias("fingerprint"), packed(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"))
