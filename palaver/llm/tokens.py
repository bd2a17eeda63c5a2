"""Sizes of texts in tokens of a public tokenizer, and a weight of their quality."""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter, never copied.
FOLDER = os.environ.get("PALAVER_TOKENIZERS", "/opt/tokenizers")
FILE = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this vocabulary pre-splits texts.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict[str, object] = {}


def encoder(path: str):
    """One encoder per worker process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def count_tokens(text: Column | str, path: str | None = None) -> Column:
    """INT, 0 for null and empty texts."""
    path = path or os.path.join(FOLDER, FILE)

    @F.pandas_udf("int")
    def count(t: pd.Series) -> pd.Series:
        enc = encoder(path)
        return pd.Series([len(enc.encode_ordinary(x)) if x else 0 for x in t], dtype="int32")

    return count(text)
