"""Labels that a tokenizer must continue a prompt with by exactly one token."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tokenize = Callable[[str], list[int]]


def bytes_as_tokens(text: str) -> list[int]:
    """A stand-in tokenizer: one token for every space-led word, numbered by its bytes."""
    return [int.from_bytes(w.encode()[:6], "big") for w in text.split(" ")]


def library(path: str) -> Tokenize:
    """A vocabulary file of the tokenizers library, loaded where it is used; its path is the caller's."""

    def run(text: str) -> list[int]:
        return _loaded(path).encode(text, add_special_tokens=False).ids

    return run


@functools.lru_cache(maxsize=4)
def _loaded(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def resolve(tokenize: Tokenize, prompt: str, label: str) -> int | None:
    """The one token that `label` adds to `prompt`; none if it adds more or changes what was there."""
    before, after = tokenize(prompt), tokenize(f"{prompt} {label}")
    return after[-1] if after[:-1] == before else None


def resolve_pair(tokenize: Tokenize, prompt: str, yes: str, no: str) -> tuple[int, int] | None:
    """Both verbalizers' tokens, which must differ."""
    a, b = resolve(tokenize, prompt, yes), resolve(tokenize, prompt, no)
    return None if a is None or b is None or a == b else (a, b)


def single_token_continuations(prompts: DataFrame, prompt_col: str, labels: list[str], tokenize: Tokenize = bytes_as_tokens) -> DataFrame:
    """(item_id, label, token_id): token_id is null where the label isn't one token."""

    kind = prompts.schema["item_id"].dataType.simpleString()
    # a prompt that many items share is looked at once
    once = prompts.select(F.col(prompt_col).alias("prompt")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, x, resolve(tokenize, p or "", x)) for p in b["prompt"] for x in labels], columns=["prompt", "label", "token_id"]).astype({"token_id": "Int64"})

    told = once.mapInPandas(run, "prompt string, label string, token_id long")
    items = prompts.select("item_id", F.col(prompt_col).alias("prompt"))
    return items.join(told, items["prompt"].eqNullSafe(told["prompt"])).select(F.col("item_id").cast(kind).alias("item_id"), "label", "token_id")
