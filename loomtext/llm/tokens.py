"""Sizes of texts in tokens of a public byte-level vocabulary."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import spread

#: Vocabulary file: one base64 token and its rank a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A blank next to other white space: only there a split before blanks could cut through a piece of the pattern.
_TIGHT = re.compile(r" \s|\s ")


@lru_cache(maxsize=2)
def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class TokenCounter:
    """Number of tokens of a text. Words between single blanks are encoded once and remembered."""

    def __init__(self, path: str = VOCABULARY, keep: int = 1_000_000) -> None:
        self.encode = encoding(path).encode_ordinary
        self.keep, self.known = keep, {}

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if _TIGHT.search(text):
            return len(self.encode(text))
        first, *rest = text.split(" ")
        known, total = self.known, len(self.encode(first))
        for w in rest:
            n = known.get(w)
            if n is None:
                if len(known) > self.keep:
                    known.clear()
                n = len(self.encode(" " + w))
                if len(w) < 64:
                    known[w] = n
            total += n
        return total


def token_counts(docs: DataFrame, id_col: str, text_col: str, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The id, the columns of ``keep`` and n_tokens; a null text has none."""
    names = [id_col, *keep]
    src = spread(docs.select(*names, F.col(text_col).alias("_text")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = TokenCounter(vocabulary)
        for b in batches:
            n = [size(t) for t in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(n, pa.int64())], names=[*names, "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", n_tokens long"
    return src.mapInArrow(count, schema)
