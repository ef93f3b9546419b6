"""Encoding and decoding with a public byte-level BPE, read from a file whose path is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that texts are cut by before this vocabulary's merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoding(path: str = TOKENIZER, pattern: str = PATTERN):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(texts: pd.Series, path: str = TOKENIZER) -> pd.Series:
    """Token numbers of each text; null and empty texts have none."""
    return pd.Series(encoding(path).encode_ordinary_batch([t or "" for t in texts], num_threads=1))


def decode(tokens: pd.Series, path: str = TOKENIZER) -> pd.Series:
    return pd.Series([encoding(path).decode(list(map(int, t))) for t in tokens])
