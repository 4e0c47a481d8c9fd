"""Cutting spans of words out of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ._kernels import placed_words, utf8
from ._shared import small_batches


def _cut(is_word: np.ndarray, text_at: int, spans_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text_at)
            buf, off = utf8(column)
            texts = column.to_pylist()
            for d, spans in enumerate(batch.column(spans_at).to_pylist()):
                if not spans:
                    continue
                own = buf[off[d] : off[d + 1]]
                _, _, starts, ends = placed_words(own, np.array([0, len(own)]), is_word)
                parts, place = [], 0
                for s in spans:
                    if s["first"] < len(starts):
                        parts.append(own[place : starts[s["first"]]].tobytes())
                        place = int(ends[min(s["end"], len(ends)) - 1])
                texts[d] = b"".join([*parts, own[place:].tobytes()]).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == text_at else c for i, c in enumerate(batch.columns) if i != spans_at], names=[n for i, n in enumerate(batch.schema.names) if i != spans_at])

    return run


def cut_spans(rows: DataFrame, is_word: np.ndarray, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """`rows` with the words of their spans cut out of the text, without the spans.

    spans: array<struct<first, end>> of word numbers, ascending and apart, in the
    last column of that name; null or none leaves the text as it is, and words
    past a text's end are not there to cut.
    """
    small_batches(rows.sparkSession)
    at = len(rows.columns) - 1 - rows.columns[::-1].index(spans_col)
    schema = StructType([f for i, f in enumerate(rows.schema) if i != at])
    return rows.mapInArrow(_cut(is_word, rows.columns.index(text_col), at), schema)
