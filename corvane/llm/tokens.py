"""Token counts and token places by a public tokenizer's vocabulary file.

``vocabulary`` names a rank file (``*.tiktoken``): one base64 token and its rank per line. The file must be
readable under the same path on every executor; it is never part of this repository.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenization pattern published with that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

@cache
def encoding(vocabulary: str) -> object:
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corvane", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def token_bytes(vocabulary: str) -> np.ndarray:
    """Length in bytes of each token."""
    ranks = encoding(vocabulary)._mergeable_ranks
    out = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        out[rank] = len(token)
    return out


def encode(text: str, vocabulary: str) -> list[int]:
    return encoding(vocabulary).encode_ordinary(text)


def _count(key: str, vocabulary: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary).encode_ordinary
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            counts = [0 if t is None else len(enc(t)) for t in batch.column(at).to_pylist()]
            rest = [i for i in range(batch.num_columns) if i != at]
            names = [batch.schema.field(i).name for i in rest]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], pa.array(counts, pa.int64())], [*names, key])

    return run


def with_tokens(df: DataFrame, text: str, keep: list[str], out: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``out``: the number of tokens of each whole text; 0 for a null or empty one."""
    chosen = df.select(*keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "_text")
    return chosen.mapInArrow(_count(out, vocabulary), f"{fields}, `{out}` bigint")
