"""JSON objects that refuse what a lenient reader hides: repeated keys, NaN, deep nesting."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: deepest nesting of objects and arrays.
DEPTH = 64


def nesting(text: str) -> int:
    """Depth of brackets outside strings."""
    depth = most = 0
    inside = escaped = False
    for c in text:
        if inside:
            inside, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
        elif c == '"':
            inside = True
        elif c in "[{":
            depth += 1
            most = max(most, depth)
        elif c in "]}":
            depth -= 1
    return most


def levels(document: Any) -> int:
    """Levels of a document: the root is one, and so is all that stands in a level's objects and arrays."""
    row, n = [document], 0
    while row:
        row, n = [x for d in row if isinstance(d, (dict, list)) for x in (d.values() if isinstance(d, dict) else d)], n + 1
    return n


def parse(text: str) -> dict[str, Any]:
    """The object of a text; ValueError says why there is none, whatever a text holds."""
    if nesting(text) > DEPTH:
        raise ValueError("too deep")

    def pairs(items: list[tuple[str, Any]]) -> dict[str, Any]:
        if len({k for k, _ in items}) < len(items):
            raise ValueError("repeated key")
        return dict(items)

    def constant(name: str) -> Any:
        raise ValueError(f"{name} is no number")

    def finite(digits: str) -> float:
        out = float(digits)
        return out if math.isfinite(out) else constant(digits[:40])

    def whole(digits: str) -> int:
        try:
            return int(digits)
        except ValueError:
            raise ValueError("too many digits") from None

    out = json.loads(text, object_pairs_hook=pairs, parse_constant=constant, parse_float=finite, parse_int=whole)
    if not isinstance(out, dict):
        raise ValueError("not an object")
    if levels(out) > DEPTH:
        raise ValueError("too deep")
    return out


def reason(text: str | None) -> str | None:
    """Why a text is no strict object; null if it is one."""
    if text is None:
        return "null"
    try:
        parse(text)
    except json.JSONDecodeError:
        return "not JSON"
    except RecursionError:
        return "too deep"
    except ValueError as e:
        return str(e)
    return None


def checked(rows: DataFrame, column: str) -> DataFrame:
    """`rows` with `reason`, on Arrow batches: Spark's own reader keeps the last repeated key silently."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(reason)

    return rows.withColumn("reason", run(F.col(column)))


def parsed_batches(batches: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(**{column: b[column].map(lambda t: json.dumps(parse(t), sort_keys=True))})
