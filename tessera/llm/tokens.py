"""Token counts with a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of other characters than white space are encoded in slices of this length; the encoder's time is not linear in them.
LONGEST_RUN = 4_000

_encoders: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_count(text: Column | str, path: str = VOCABULARY) -> Column:
    """Tokens of a text; null counts as 0."""

    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re

        own, long_run = encoder(path), re.compile(r"\S{%d,}" % LONGEST_RUN)

        def size(value: str | None) -> int:
            if not value:
                return 0
            if long_run.search(value):
                return sum(len(own.encode_ordinary(value[i : i + LONGEST_RUN])) for i in range(0, len(value), LONGEST_RUN))
            return len(own.encode_ordinary(value))

        for batch in batches:
            yield pd.Series([size(v) for v in batch], dtype="int64")

    # not deterministic for the planner: a filter on the count would else be pushed below the shuffle and count twice
    return count.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def with_tokens(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    return documents.withColumn("tokens", token_count("text", path))
