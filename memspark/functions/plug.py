"""Slots for what a caller brings: a tokenizer, an embedder. Arrow batches; loaded once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from . import text


def token_counter(load: Callable[[], Callable[[list[str]], list[int]]]):
    """A column function that counts tokens with load()(texts). A null text counts as empty."""

    @pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = load()
        for s in batches:
            yield pd.Series(own(s.fillna("").tolist()), dtype="int64")

    return count


def token_cutter(load: Callable[[], tuple[Callable[[str], list[int]], Callable[[list[int]], str]]]):
    """A column function of text and budget: empty for no budget, the text where it fits, else its first budget - 1 tokens and an ellipsis. load() gives encode and decode."""

    @pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        encode, decode = load()
        for texts, budgets in batches:
            out = []
            for t, b in zip(texts.fillna(""), budgets):
                ids = encode(t) if b > 0 else []
                out.append("" if b <= 0 else t if len(ids) <= b else decode(ids[: int(b) - 1]) + "...")
            yield pd.Series(out, dtype="object")

    return cut


def embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32):
    """A column function that embeds texts with load()(texts), batch texts at a time. A null text has no vector."""

    @pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = load()
        for s in batches:
            known = s[s.notna()]
            out: list = []
            for a in range(0, len(known), batch):
                out += own(known.iloc[a : a + batch].tolist())
            yield pd.Series(dict(zip(known.index, out)), dtype="object").reindex(s.index).where(lambda x: x.notna(), None)

    return embed


def encode(df: DataFrame, embed, content: str = "content", importance: Column | None = None) -> DataFrame:
    """df with embedding and text metadata, and its importance where a score is given."""
    out = df.withColumn("embedding", embed(F.col(content))).withColumn("text_metadata", text.text_metadata(F.col(content)))
    return out.withColumn("importance", importance) if importance is not None else out
