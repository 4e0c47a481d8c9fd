"""Content identity: canonical text, SHA-256 digests and indices drawn from them."""

from __future__ import annotations

import json
import math
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(value: Any) -> str:
    """Sorted keys, no spaces, nulls kept, floats as their shortest text, -0.0 as 0.0.

    Only null, booleans, finite numbers, strings, lists and string-keyed
    mappings have a canonical text.
    """

    def plain(v: Any) -> Any:
        if v is None or isinstance(v, (bool, int, str)):
            return v
        if isinstance(v, float):
            if not math.isfinite(v):
                raise ValueError("only finite numbers have a canonical text")
            return v + 0.0
        if isinstance(v, list):
            return [plain(x) for x in v]
        if isinstance(v, dict) and all(isinstance(k, str) for k in v):
            return {k: plain(x) for k, x in v.items()}
        raise TypeError(f"{type(v).__name__} has no canonical text")

    text = json.dumps(plain(value), ensure_ascii=False, separators=(",", ":"), sort_keys=True, allow_nan=False)
    text.encode("utf-8")  # lone surrogates are refused
    return text


def canonical_text(document: Column) -> Column:
    """Canonical text of JSON texts, by an Arrow-batched function."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else canonical_json(json.loads(t)))

    return run(document)


def quoted(text: Column) -> Column:
    """JSON string of text without control characters: quotes and backslashes escaped."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def record_text(fields: dict[str, Column]) -> Column:
    """Canonical text of a record of strings and integers, whose values are given as JSON texts."""
    parts: list[Column] = []
    for k in sorted(fields):
        parts += [F.lit(("," if parts else "{") + json.dumps(k) + ":"), F.coalesce(fields[k].cast("string"), F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _small(n: Column) -> Column:
    """n, whose products with 32-bit words fit a long."""
    n = n.cast("bigint")
    return F.when(n < 1 << 31, n).otherwise(F.raise_error(F.lit("a pool of 2**31 or more")).cast("bigint"))


def index64(hex_digest: Column, n: Column) -> Column:
    """The first 64 bits of a digest modulo n, in 64-bit integers; n from 2**31 on is an error."""
    word = lambda at: F.conv(F.substring(hex_digest, at, 8), 16, 10).cast("bigint")
    n = _small(n)
    return ((word(1) % n) * (F.lit(1 << 32).cast("bigint") % n) + word(9)) % n


def index256(hex_digest: Column, n: Column) -> Column:
    """All 256 bits of a digest modulo n, eight digits at a time; n from 2**31 on is an error."""
    n = _small(n)
    word = [F.conv(F.substring(hex_digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(8)]
    acc = F.lit(0).cast("bigint")
    for w in word:
        acc = (acc * F.lit(1 << 32).cast("bigint") + w) % n
    return acc


def multiset_digest(fingerprints: Column) -> Column:
    """Digest of a group's fingerprints: of any order, counting repetitions.

    The digest is of all fingerprints in one order, so a group meets in one
    task: 65 bytes a fingerprint, 30 million of them in the 2 GB a value may
    have. Larger sets are to be digested by parts.
    """
    return F.sha2(F.array_join(F.array_sort(F.collect_list(fingerprints)), ","), 256)
