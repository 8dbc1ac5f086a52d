"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files of public tokenizers are; every executor needs the folder.
TOKENIZERS = "/opt/tokenizers"
#: The vocabulary used by default: byte-level pairs for many languages.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Ids of that vocabulary are below this.
VOCABULARY_SIZE = 50_257
#: Fixed value: the pattern that splits text before the merges, published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoding(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):  # noqa: ANN201
    """The tokenizer of a rank file."""
    import tiktoken

    with open(f"{folder}/{vocabulary}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Documents whose tokens are counted together.
COUNTED_DOCS = 256


def _bags(ids: list[np.ndarray]) -> tuple[pa.ListArray, pa.ListArray]:
    """The distinct tokens of each text and how often each occurs, by one sort of all."""
    owner = np.repeat(np.arange(len(ids), dtype=np.int64), [len(x) for x in ids])
    pairs, counts = np.unique(owner << 32 | np.concatenate(ids).astype(np.int64), return_counts=True)
    offsets = pa.array(np.searchsorted(pairs, np.arange(len(ids) + 1, dtype=np.int64) << 32).astype(np.int32))
    return tuple(pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (pairs & 0xFFFFFFFF, counts))


def _tokenise(folder: str, vocabulary: str, bags: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64 as b64

        import tiktoken

        with open(f"{folder}/{vocabulary}", "rb") as lines:
            ranks = {b64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for whole in batches:
            for start in range(0, whole.num_rows, COUNTED_DOCS):
                batch = whole.slice(start, COUNTED_DOCS)
                kept = [n for n in batch.schema.names if n != "text"]
                ids = [coder.encode_to_numpy(t, disallowed_special=()) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
                columns = [batch.column(batch.schema.get_field_index(n)) for n in kept]
                columns.append(pa.array(np.array([len(x) for x in ids], dtype=np.int32)))
                names = [*kept, "n_tokens"]
                if bags:
                    columns += _bags(ids)
                    names += ["token_ids", "token_counts"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def token_sizes(docs: DataFrame, key: str, text: str, *keep: str, bags: bool = False, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, keep..., n_tokens) of the documents; with `bags` also the distinct token ids and how often each occurs. Documents with a
    null key or a null or empty text have no tokens and are left out."""
    rows = docs.where(F.col(key).isNotNull() & (F.col(text) != "")).select(F.col(key), *keep, F.col(text).alias("text"))
    types = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in (key, *keep)] + ["n_tokens int"] + (["token_ids array<int>", "token_counts array<int>"] if bags else []))
    return rows.select(key, *keep, "text").mapInArrow(_tokenise(folder, vocabulary, bags), schema)
