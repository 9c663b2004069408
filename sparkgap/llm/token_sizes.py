"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread_out

DEFAULT_TOKENIZER = "byte_bpe_50k.tiktoken"
LONGEST_PIECE = 100_000  # characters encoded at once


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """Where the installed public tokenizer file lies; any other path may be given instead."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def load_encoding(path: str):
    """The byte-level BPE of a rank file, loaded once per worker process."""
    import base64

    import public_tokenizers
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_loaded_rank_files", {})
    if path not in kept:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        kept[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


def count_tokens(text: str | None, encoding) -> int:
    """Tokens of the whole text; strings of special tokens are ordinary text; null has none."""
    if not text:
        return 0
    return len(encoding.encode_ordinary(text))


def token_sizes(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), tokenizer: str | None = None) -> DataFrame:
    """(doc_id, *keep, n_tokens) of every document, whole texts; null and empty texts have 0 tokens.

    One pass; a shuffle only if there are fewer partitions than cores. Repeated rows each get their size.
    """
    path = tokenizer or tokenizer_path()
    used = documents.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in used.schema if f.name != "__text")

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_encoding(path)
        for batch in batches:
            batch["n_tokens"] = [count_tokens(t, encoding) for t in batch["__text"]]
            yield batch.drop(columns="__text")

    return spread_out(used).mapInPandas(sized, f"{schema}, n_tokens bigint")
