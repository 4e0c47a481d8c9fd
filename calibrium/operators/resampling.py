"""Deterministic hash-seeded bootstraps.

A replicate's mean of per-row values is sum(w v) / sum(w), where w is how often
a row was drawn. So draws are reduced to weights before they meet the rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..functions import identity as I
from ..functions import sha256 as S


#: Replicates of a test bootstrap and of one that refits.
TEST_REPLICATES, REFIT_REPLICATES = 20_000, 2_000
#: Strata whose sizes travel with a plan; bytes of sums that are sent to all tasks; draws made in a row, and in one piece of a chunk.
MOST_STRATA, MOST_BYTES, RUN, PIECE = 100_000, 8 << 20, 1 << 18, 4096
#: Values that are sent to all tasks, as a multiple of a bootstrap's sums.
SENT = 8
#: Counts that a task holds at once, at most, as a block of replicates; units of a chunk, which two bytes number.
COUNTS, CHUNK = 4 << 20, 1 << 16
#: Units of a stratum whose counts a task holds, a byte each; bytes of such counts, of MOST_TOGETHER replicates at most and LEAST_TOGETHER at least.
DENSE, TOGETHER, LEAST_TOGETHER, MOST_TOGETHER = 1 << 26, 1 << 27, 4, 64
#: Draws of as many digits from which on they are hashed side by side.
SIDE_BY_SIDE = 6_000


def numbered(pool: DataFrame, unit: str, stratum: str, carry: Sequence[str] = ()) -> DataFrame:
    """(stratum, unit, carry, _place): the distinct units of each stratum, numbered in their order."""
    w = Window.partitionBy(stratum).orderBy(unit)
    units = pool.groupBy(stratum, unit).agg(*[F.any_value(c).alias(c) for c in carry]) if carry else pool.select(stratum, unit).distinct()
    return units.withColumn("_place", F.row_number().over(w).cast("bigint") - 1)


def stratum_sizes(units: DataFrame, stratum: str) -> list[tuple]:
    """(stratum, units) of all strata; more than MOST_STRATA: ValueError."""
    sizes = units.groupBy(stratum).agg(F.count("*").alias("_n")).limit(MOST_STRATA + 1).collect()
    if len(sizes) > MOST_STRATA:
        raise ValueError(f"more than {MOST_STRATA} strata")
    return [tuple(r) for r in sizes if r[0] is not None]


def _is_dense(draws, pool):
    """Whether the draws (numbers or columns) of a stratum go on as counts of all its units."""
    return (4 * draws >= pool) & (pool <= DENSE)


def _packed(counts: np.ndarray) -> tuple[int, bytes]:
    """(bits, counts of so many bits each), the fewest of 4, 8, 16 and 32."""
    most = int(counts.max(initial=0))
    if most < 16:
        of = np.zeros(len(counts) + len(counts) % 2, np.uint8)
        of[: len(counts)] = counts
        return 4, (of[::2] | of[1::2] << 4).tobytes()
    bits = 8 if most < 1 << 8 else 16 if most < 1 << 16 else 32
    return bits, counts.astype(f"<u{bits // 8}").tobytes()


def _unpacked(bits: int, packed, size: int) -> np.ndarray:
    if bits > 4:
        return np.frombuffer(packed, f"<u{bits // 8}")
    pairs = np.frombuffer(packed, np.uint8)
    out = np.empty(2 * len(pairs), np.uint8)
    out[::2], out[1::2] = pairs & 15, pairs >> 4
    return out[:size]


def _runs(population: str, wide: bool, extra: dict[str, str], chunk: int):
    """Runs of draws to pieces of them: counts of a chunk's units, or (bits 0) the places in it that were drawn, two bytes each."""
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def pieces(g, stratum, n, dense, low, high, first, last):
        if dense:
            counts = counts_of(population, range(low, high), stratum, n, last, wide, extra)
            for r, of in zip(range(low, high), counts):
                for at in range(0, n, chunk):
                    yield (g, at // chunk, r, *_packed(of[at : at + chunk]))
            return
        for r, places in places_of(population, range(low, high), stratum, n, first, last, wide, extra):
            of = places // chunk
            if n > chunk:
                order = np.argsort(of.astype(np.uint16), kind="stable")  # by radix; 65,536 chunks are 2**32 units
                places, of = places[order], of[order]
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            near = (places - of * chunk).astype("<u2")
            for a, b in zip(cuts, cuts[1:]):
                for k in range(a, b, PIECE):
                    yield g, int(of[a]), r, 0, near[k : min(b, k + PIECE)].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["_g", "_chunk", "replicate", "_bits", "_drawn"])
        for asked in batches:
            for one in zip(*(c.to_pylist() for c in asked.columns)):
                for row in pieces(*one):
                    rows.append(row)
                    held += len(row[-1])
                    if held >= 1 << 21 or len(rows) >= 10_000:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    return run


def _meet(columns: list[str], unit_counts, ready):
    """Rows of a chunk's units and then of its draws, by replicate, to what `unit_counts` makes of the counts of each replicate.

    unit_counts(ready(units), g, replicate, counts): a record batch, of the
    counts of the units in their order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, replicate, held, units, place, counts, out, n = None, -1, [], None, None, None, [], 0
        made = lambda: pa.Table.from_batches(out).combine_chunks().to_batches()
        for batch in batches:
            g, c, r = (batch.column(k).fill_null(-1).to_numpy() for k in range(3))
            cuts = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (r[1:] != r[:-1])) + 1).tolist(), len(g)] if len(g) else [0]
            for a, b in zip(cuts, cuts[1:]):
                if counts is not None and ((g[a], c[a]) != key or r[a] != replicate):
                    out.append(unit_counts(units, key[0], replicate, counts[place]))
                    counts, n = None, n + out[-1].num_rows
                    if n >= 1 << 16:
                        yield from made()
                        out, n = [], 0
                if (g[a], c[a]) != key:
                    key, held, units = (g[a], c[a]), [], None
                if r[a] < 0:
                    held.append(batch.slice(a, b - a))
                    continue
                if units is None:
                    rows = pa.Table.from_batches(held)
                    units, place = ready(rows.select(columns).combine_chunks()), rows.column("_at").to_numpy()
                    size = int(place.max()) + 1
                if counts is None:
                    replicate, counts = int(r[a]), np.zeros(size, np.int64)
                for bits, piece in zip(batch.column(3).slice(a, b - a).to_pylist(), batch.column(4).slice(a, b - a)):
                    counts += _unpacked(bits, piece.as_buffer(), size) if bits else np.bincount(np.frombuffer(piece.as_buffer(), "<u2"), minlength=size)
        if counts is not None:
            out.append(unit_counts(units, key[0], replicate, counts[place]))
        if out:
            yield from made()

    return run


def _counted(units: DataFrame, sizes: list[tuple], stratum: str, columns: list[str], unit_counts, out: StructType, replicates: int, population: str, draws: int | None, extra: dict[str, str], wide: bool, ready=lambda units: units) -> DataFrame:
    """`unit_counts` of each chunk of units and replicate, with the stratum.

    units: (stratum, _place, columns). n of n draws with replacement in each
    stratum, or `draws` of them; `wide` takes all 256 bits of the digest. Runs
    of draws are spread over all tasks before they are made, whatever the number
    of strata, and meet the units in chunks of CHUNK, so no row is made for a
    draw. Of up to DENSE units a task draws a block of replicates and sends
    counts, half a byte a unit; of more, or of few draws, places.
    """
    spark = units.sparkSession
    kind = units.schema[stratum].dataType
    local = spark.createDataFrame([(g, s, n) for g, (s, n) in enumerate(sizes)], StructType([StructField("_g", IntegerType()), StructField(stratum, kind), StructField("_n", LongType())]))
    total = sum(draws or n for _, n in sizes) * replicates
    tasks = max(1, min(replicates * len(sizes), max(4 * spark.sparkContext.defaultParallelism, total // (16 * RUN))))
    long = lambda v: F.lit(v).cast("long")
    asked = local.select("_g", F.col(stratum).cast("string").alias("_s"), "_n", long(draws).alias("_m") if draws else F.col("_n").alias("_m")).withColumn("_dense", _is_dense(F.col("_m"), F.col("_n")))
    many = F.when(F.col("_dense"), F.least(long(MOST_TOGETHER), F.greatest(long(LEAST_TOGETHER), F.floor(F.lit(TOGETHER) / F.col("_n"))))).otherwise(F.greatest(long(1), F.floor(F.lit(RUN) / F.col("_m"))))
    # small strata in smaller blocks, so that all tasks have some
    asked = asked.withColumn("_per", F.least(many, long(max(1, replicates * len(sizes) // tasks))) if total < 64 * RUN * tasks else many)
    asked = asked.select("*", F.explode(F.sequence(long(0), long(replicates - 1), F.col("_per"))).alias("_low"))
    step = F.when(F.col("_dense"), F.col("_m")).otherwise(long(RUN))
    asked = asked.withColumn("_step", step).select("*", F.explode(F.sequence(long(0), F.col("_m") - 1, F.col("_step"))).alias("_first"))
    asked = asked.select("_g", "_s", "_n", "_dense", "_low", F.least(F.col("_low") + F.col("_per"), long(replicates)).alias("_high"), "_first", F.least(F.col("_first") + F.col("_step"), F.col("_m")).alias("_last"))
    drawn = asked.repartition(tasks).mapInArrow(_runs(population, wide, extra, CHUNK), "_g int, _chunk long, replicate int, _bits int, _drawn binary")
    of = units.join(F.broadcast(local.drop("_n")), stratum)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    place = F.col("_place")
    of = of.select("_g", F.floor(place / CHUNK).alias("_chunk"), none("replicate", "int"), none("_bits", "int"), none("_drawn", "binary"), F.pmod(place, F.lit(CHUNK)).cast("int").alias("_at"), *columns)
    both = of.unionByName(drawn.select("*", none("_at", "int"), *[none(c, units.schema[c].dataType) for c in columns]))
    met = both.repartition("_g", "_chunk").sortWithinPartitions("_g", "_chunk", "replicate")
    return met.mapInArrow(_meet(columns, unit_counts, ready), out).join(F.broadcast(local.drop("_n")), "_g").drop("_g")


def weights(pool: DataFrame, unit: str, stratum: str, replicates: int, population: str, draws: int | None = None, extra: dict[str, str] | None = None, wide: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """(replicate, stratum, unit, w, carry): how often each unit was drawn, and the columns `carry` that it has.

    Rows without stratum are left out.
    """
    units, names = numbered(pool.where(F.col(stratum).isNotNull()), unit, stratum, carry), [unit, *carry]

    def rows(own: pa.Table, g: int, replicate: int, counts: np.ndarray) -> pa.RecordBatch:
        hit = np.flatnonzero(counts)
        got = own.take(pa.array(hit)).combine_chunks()
        each = [pa.array(np.full(len(hit), v, np.int32)) for v in (g, replicate)] + [pa.array(counts[hit])]
        return pa.RecordBatch.from_arrays([*each, *[got.column(c).combine_chunks() if isinstance(got.column(c), pa.ChunkedArray) else got.column(c) for c in names]], names=["_g", "replicate", "w", *names])

    out = StructType([StructField("_g", IntegerType()), StructField("replicate", IntegerType()), StructField("w", LongType()), *[StructField(c, units.schema[c].dataType) for c in names]])
    return _counted(units, stratum_sizes(units, stratum), stratum, names, rows, out, replicates, population, draws, extra or {}, wide).select("replicate", stratum, unit, "w", *carry)


def counts_of(population: str, replicates: range, stratum: str, pool: int, draws: int, wide: bool = False, extra: dict[str, str] | None = None, kind=np.uint8) -> np.ndarray:
    """(replicates x places) how often each replicate draws each place of a stratum, from RUN draws at a time."""
    counts = np.zeros((len(replicates), pool), kind)
    for k in range(0, draws, RUN):
        for r, places in places_of(population, replicates, stratum, pool, k, min(k + RUN, draws), wide, extra):
            np.add.at(counts[r - replicates.start], places, kind(1))
    if kind is np.uint8 and (counts.sum(axis=1, dtype=np.int64) != draws).any():  # a count beyond a byte
        return counts_of(population, replicates, stratum, pool, draws, wide, extra, np.uint32)
    return counts


def drawn_sums(pool: DataFrame, unit: str, stratum: str, replicates: int, population: str, columns: Sequence[str], sums: dict[str, Callable[..., int]], draws: int | None = None, extra: dict[str, str] | None = None, wide: bool = False) -> DataFrame:
    """(replicate, stratum, sums): whole numbers that are summed over the units drawn, without a row for a unit.

    sums: name to a function of counts and columns (whole numbers, null as 0) of
    a part of the units that were drawn. Rows without stratum are left out.
    """
    units = numbered(pool.where(F.col(stratum).isNotNull()), unit, stratum, [c for c in columns if c != unit])

    def totals(own: pa.Table, g: int, replicate: int, counts: np.ndarray) -> pa.RecordBatch:
        hit = np.flatnonzero(counts)
        values = [own.column(c).fill_null(0).to_numpy()[hit] for c in columns]
        made = [f(counts[hit], *values) for f in sums.values()]
        return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([replicate], pa.int32()), *[pa.array([int(v)], pa.int64()) for v in made]], names=["_g", "replicate", *sums])

    out = StructType([StructField("_g", IntegerType()), StructField("replicate", IntegerType()), *[StructField(c, LongType()) for c in sums]])
    made = _counted(units, stratum_sizes(units, stratum), stratum, list(columns) or [unit], totals, out, replicates, population, draws, extra or {}, wide)
    return made.groupBy("replicate", stratum).agg(*[F.sum(c).alias(c) for c in sums])


def whole_dot(a: np.ndarray, b: np.ndarray) -> int:
    """The sum of products of whole numbers, at any size."""
    most = np.abs(a).max(initial=0) * np.abs(b).astype(float).sum()
    return int(a @ b) if most < 2.0**62 else sum(x * y for x, y in zip(a.tolist(), b.tolist()))


def _ranks(strata: Broadcast, population: str, wide: bool, extra: dict[str, str], draws: int | None, levels: dict[str, float]):
    """Blocks of replicates of a stratum to nearest-rank percentiles of the values drawn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for g, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                stratum, values, there = strata.value[g]
                order = np.argsort(values, kind="stable")
                order = order[there[order]]
                ordered = values[order]
                at_once = max(LEAST_TOGETHER, min(MOST_TOGETHER, TOGETHER // max(1, len(values))))
                each = ((r, of) for at in range(low, high, at_once) for r, of in enumerate(counts_of(population, range(at, min(high, at + at_once)), stratum, len(values), draws or len(values), wide, extra), at))
                for r, of in each:
                    upto = of[order].cumsum(dtype=np.int64)
                    n = int(upto[-1]) if len(upto) else 0
                    if n:
                        rows.append((g, r, n, *[float(ordered[np.searchsorted(upto, max(1, math.ceil(f * n)))]) for f in levels.values()]))
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * len(levels)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names=["_g", "replicate", "n", *levels])

    return run


def bootstrap_ranks(pool: DataFrame, unit: str, stratum: str, value: str, replicates: int, population: str, levels: dict[str, float], draws: int | None = None, extra: dict[str, str] | None = None, wide: bool = False) -> DataFrame:
    """(replicate, stratum, n, levels): nearest-rank percentiles of a value (a double, of each unit) in each resampled stratum.

    n counts the values drawn; null ones are left out, and so is a stratum of
    none. Where the values are few enough to be sent to all tasks, up to SENT
    times a bootstrap's sums, a task draws a stratum and ranks it in place, so no
    row is made for a unit drawn; else units drawn are counted and ranked by cells.
    """
    from .shift import weighted_nearest_rank

    spark, pool = pool.sparkSession, pool.where(F.col(stratum).isNotNull())
    kind = pool.schema[stratum].dataType
    units = pool.groupBy(stratum, unit).agg(F.any_value(value).cast("double").alias("_v"))
    sizes = stratum_sizes(units, stratum)
    if sum(n for _, n in sizes) * 8 > SENT * MOST_BYTES:
        drawn = weights(units, unit, stratum, replicates, population, draws, extra, wide, carry=["_v"])
        return weighted_nearest_rank(drawn, ["replicate", stratum], "_v", "w", levels)
    number = {s: g for g, (s, _) in enumerate(sizes)}
    local = spark.createDataFrame([(g, s) for s, g in number.items()], StructType([StructField("_g", IntegerType()), StructField(stratum, kind)]))
    got = units.join(F.broadcast(local), stratum).select("_g", F.col(stratum).cast("string").alias("_s"), unit, "_v").orderBy("_g", unit).select("_g", "_s", "_v").toArrow()
    of, v = got.column("_g").to_numpy(), got.column("_v")
    values, there, cuts = v.fill_null(0.0).to_numpy(), v.is_valid().to_numpy(), np.searchsorted(of, np.arange(len(sizes) + 1))
    sent = spark.sparkContext.broadcast([(got.column("_s")[int(a)].as_py(), values[a:b], there[a:b]) for a, b in zip(cuts, cuts[1:])])
    per = max(1, replicates * len(sizes) // (4 * spark.sparkContext.defaultParallelism))
    blocks = spark.createDataFrame([(g, k, min(k + per, replicates)) for g in range(len(sizes)) for k in range(0, replicates, per)], "g int, low int, high int")
    made = blocks.repartition(max(1, -(-replicates // per) * len(sizes))).mapInArrow(_ranks(sent, population, wide, extra or {}, draws, levels), ", ".join(["_g int", "replicate int", "n long", *[f"{c} double" for c in levels]]))
    return made.join(F.broadcast(local), "_g").select("replicate", stratum, "n", *levels)


def _draw_parts(population: str, replicate: int, stratum: str, pool: int, extra: dict[str, str]) -> tuple[bytes, bytes]:
    """What stands before and after the draw's number in its canonical text."""
    fields = {"draw_index": -1, "pool_size": pool, "population_id": population, "protocol_id": "hash-bootstrap", "protocol_version": 1, "replicate_index": replicate, "stratum": stratum, **extra}
    head, _, tail = I.canonical_json(fields).partition('"draw_index":-1')
    return f'{head}"draw_index":'.encode(), tail.encode()


def places_drawn(population: str, replicate: int, stratum: str, pool: int, draws: int, wide: bool = False, extra: dict[str, str] | None = None, first: int = 0) -> np.ndarray:
    """The places that a replicate draws in a stratum, in order, from its draw `first` on."""
    head, tail = _draw_parts(population, replicate, stratum, pool, extra or {})
    begun, numbers, parts = hashlib.sha256(head).copy, _numbers(first, first + draws), []
    for i in range(0, draws, PIECE):  # few at a time stay in the processor's cache
        made = []
        for k in numbers[i : i + PIECE]:
            sha = begun()  # a copy takes less time than a new state
            sha.update(k + tail)
            made.append(sha.digest())
        parts.append(b"".join(made))
    digests = b"".join(parts)
    if not wide:
        return (np.frombuffer(digests, ">u8")[::4] % np.uint64(pool)).astype(np.int64)
    if pool >= 1 << 31:
        raise ValueError("256-bit indices are for pools under 2**31")
    acc = np.zeros(draws, np.uint64)
    for word in np.frombuffer(digests, ">u4").reshape(-1, 8).T.astype(np.uint64):
        acc = ((acc << np.uint64(32)) + word) % np.uint64(pool)
    return acc.astype(np.int64)


def _less(x: np.ndarray, n: int) -> np.ndarray:
    """x modulo n; a division by one number is made side by side, a remainder is not."""
    return x - x // np.uint64(n) * np.uint64(n)


def places_of(population: str, replicates: range, stratum: str, pool: int, first: int, last: int, wide: bool = False, extra: dict[str, str] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(replicate, the places of its draws from first to last - 1, as `places_drawn`).

    Draws whose texts differ between replicates in their last block only are
    hashed side by side from there on.
    """
    if wide and pool >= 1 << 31:
        raise ValueError("256-bit indices are for pools under 2**31")
    cuts = [first, *[10**k for k in range(1, 19) if first < 10**k < last], last]
    told = {r: _draw_parts(population, r, stratum, pool, extra or {}) for r in replicates}
    sign = b'"replicate_index":'
    parts = []
    for low, high in zip(cuts, cuts[1:]):
        head, tail = told[replicates[0]]
        common = tail[: tail.index(sign) + len(sign)]
        state = S.begun(head, low, high, common) if len(replicates) >= LEAST_TOGETHER and high - low >= SIDE_BY_SIDE and (len(head) + len(str(low)) + len(common)) % 64 + len(tail) - len(common) <= 55 else None
        parts.append((low, high, common, state))
    for r in replicates:
        out, (head, tail) = np.empty(last - first, np.int64), told[r]
        for low, high, common, state in parts:
            of = out[low - first : high - first]
            rest = b"" if state is None else state[1] + tail[len(common) :]
            if state is None or len(rest) > 55:
                of[:] = places_drawn(population, r, stratum, pool, high - low, wide, extra, low)
                continue
            at = 0
            for words in S.ended(state[0], rest, len(head) + len(str(low)) + len(common) - len(state[1])):
                words = words.astype(np.uint64)
                if wide:
                    acc = np.zeros(words.shape[1], np.uint64)
                    for w in words:
                        acc = _less((acc << np.uint64(32)) + w, pool)
                else:
                    acc = _less((words[0] << np.uint64(32)) + words[1], pool)
                of[at : at + len(acc)] = acc
                at += len(acc)
        yield r, out


@functools.lru_cache(2)
def _numbers(low: int, high: int) -> list[bytes]:
    return [b"%d" % k for k in range(low, high)]


def _series(strata: Broadcast, population: str, wide: bool):
    """Blocks of replicates to their sums: counts of a block (replicates x units) times the units' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for stratum, sums in strata.value.items():
                    n, at = len(sums), low
                    finite, odd = np.where(np.isfinite(sums), sums, 0.0), np.flatnonzero(~np.isfinite(sums).all(axis=1))
                    while at < high:
                        own = range(at, min(high, at + max(1, COUNTS // n)))
                        counts = counts_of(population, own, stratum, n, n, wide).astype(np.float64)
                        made = counts @ finite
                        for i in odd:  # infinite sums count where they are drawn, and only there
                            made[counts[:, i] > 0] += np.where(np.isfinite(sums[i]), 0.0, sums[i])
                        yield pa.RecordBatch.from_pydict({"replicate": pa.array(own, pa.int32()), "stratum": pa.array([stratum] * len(own), pa.string()), "sums": pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), made.shape[1]).cast(pa.list_(pa.float64()))})
                        at = own.stop

    return run


def bootstrap_means(pool: DataFrame, unit: str, stratum: str, columns: list[str], replicates: int = TEST_REPLICATES, population: str = "p", wide: bool = False, by_stratum: bool = False) -> DataFrame:
    """(replicate, n, columns): the means over all rows of the units drawn, n of them.

    A unit is summed over its rows once, for all columns; a replicate is drawn
    once for all of them. Where the sums of all units are few enough to be sent
    to every task, a task counts the draws of a block of replicates and
    multiplies the counts with the sums; else draws and sums meet in chunks of
    the units. `by_stratum`: means of each stratum (a text). Strata and units
    that are null are left out.
    """
    spark = pool.sparkSession
    pool = pool.where(F.col(stratum).isNotNull() & F.col(unit).isNotNull())
    names = ["_rows", *columns]
    sums = pool.groupBy(stratum, unit).agg(F.count("*").cast("double").alias("_rows"), *[F.sum(F.col(c).cast("double")).alias(c) for c in columns])
    keys = ["replicate", *([stratum] if by_stratum else [])]
    means = lambda df: df.groupBy(*keys).agg(F.sum("_rows").cast("bigint").alias("n"), *[(F.sum(c) / F.sum("_rows")).alias(c) for c in columns])
    sizes = stratum_sizes(sums, stratum)
    if sum(n for _, n in sizes) * len(names) * 8 > MOST_BYTES:
        units = sums.withColumn("_place", F.row_number().over(Window.partitionBy(stratum).orderBy(unit)).cast("bigint") - 1)

        def matrix_of(own: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            whole = np.column_stack([own.column(c).to_numpy() for c in names])
            return whole, np.where(np.isfinite(whole), whole, 0.0), np.flatnonzero(~np.isfinite(whole).all(axis=1))

        def totals(own: tuple, g: int, replicate: int, counts: np.ndarray) -> pa.RecordBatch:
            whole, finite, odd = own
            made = counts.astype(np.float64) @ finite
            for i in odd[counts[odd] > 0]:  # infinite sums count where they are drawn, and only there
                made += np.where(np.isfinite(whole[i]), 0.0, whole[i])
            return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([replicate], pa.int32()), *[pa.array([v]) for v in made.tolist()]], names=["_g", "replicate", *names])

        out = StructType([StructField("_g", IntegerType()), StructField("replicate", IntegerType()), *[StructField(c, DoubleType()) for c in names]])
        return means(_counted(units, sizes, stratum, names, totals, out, replicates, population, None, {}, wide, matrix_of))
    got = sums.select(F.col(stratum).cast("string").alias("_s"), unit, "_rows", *columns).orderBy("_s", unit).toArrow()
    names = np.array(got.column("_s").to_pylist(), object)
    matrix = np.column_stack([got.column(i).to_numpy() for i in range(2, got.num_columns)]) if got.num_rows else np.zeros((0, len(columns) + 1))
    cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)] if len(names) else [0]
    strata = spark.sparkContext.broadcast({str(names[a]): np.ascontiguousarray(matrix[a:b]) for a, b in zip(cuts, cuts[1:])})
    tasks = max(1, min(replicates, 4 * spark.sparkContext.defaultParallelism))
    edges = [replicates * k // tasks for k in range(tasks + 1)]
    blocks = spark.createDataFrame(list(zip(edges, edges[1:])), "low long, high long").repartition(tasks, "low")
    made = blocks.mapInArrow(_series(strata, population, wide), "replicate int, stratum string, sums array<double>")
    return means(made.select("replicate", F.col("stratum").alias(stratum), *[F.get("sums", F.lit(i)).alias(c) for i, c in enumerate(["_rows", *columns])]))


def percentile_interval(series: DataFrame, value: str, low: float, high: float, by: list[str] | None = None) -> DataFrame:
    """Nearest-rank percentiles and the median of a series, and whether 0 lies outside."""
    at = lambda f: F.expr(f"percentile_disc({f!r}) within group (order by {value})")
    rows = series.groupBy(*(by or [])).agg(F.count("*").alias("n"), at(low).alias("lower"), at(0.5).alias("median"), at(high).alias("upper"))
    return rows.withColumn("excludes_zero", (F.col("lower") > 0) | (F.col("upper") < 0))
