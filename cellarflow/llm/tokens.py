"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabularies lie; the environment variable overrides the folder.
DEFAULT_VOCABULARY = os.path.join(os.environ.get("CELLARFLOW_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_multi_50k.tiktoken")
# Fixed value: the public split pattern that belongs to these byte-level vocabularies.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(vocabulary: str = DEFAULT_VOCABULARY):
    """The tokenizer of a rank file; loaded once per worker process."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str, vocabulary: str = DEFAULT_VOCABULARY) -> int:
    return len(encoding(vocabulary).encode_ordinary(text))


def n_tokens(text: Column | str, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Tokens of each whole text; 0 for an empty text, null for null. Arrow batches in, one integer a row out."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(vocabulary)
        return pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in texts], dtype="Int64")

    return count(F.col(text) if isinstance(text, str) else text)
