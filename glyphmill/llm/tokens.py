"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from glyphmill.operators.lineage import spread

#: Vocabulary file used where none is named: byte-level BPE for many languages.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=2)
def encoder(path: str | None = None):
    """The tiktoken encoder of a vocabulary file; ``None``: ``VOCABULARY`` of the installed public files."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """``(*keep, tokens)``: the size of each whole text; null and empty texts have 0 tokens."""
    rows = spread(documents.select(*keep, text))
    kinds = dict(documents.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for batch in batches:
            out = batch[keep].copy()
            out["tokens"] = [len(enc.encode_ordinary(t)) if t else 0 for t in batch[text]]
            yield out

    return rows.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", tokens long")
