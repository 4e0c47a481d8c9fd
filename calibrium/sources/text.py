"""Text normalisation: line ends, composed characters, outer white space."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space among ASCII characters.
BLANK = r"[\x09-\x0D\x1C-\x20]"


def normalize(text: str) -> str:
    return unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n")).strip()


def normalize_text(text: Column) -> Column:
    """Spark folds line ends and trims; only texts with other characters than ASCII go to Python, for NFC."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else normalize(t))

    plain = F.regexp_like(text, F.lit(r"^[\x00-\x7F]*$"))
    folded = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), f"^{BLANK}+|{BLANK}+$", "")
    return F.when(plain, folded).otherwise(run(F.when(~plain, text)))
