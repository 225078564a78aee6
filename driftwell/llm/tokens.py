"""Token counts of texts under a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's published pattern, and merges never cross pieces, so the count of a text is
the sum over its pieces. Pieces repeat heavily; their counts are remembered per worker, which makes counting several times
faster than encoding every text in full, with the same result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rank file on the executors; a parameter everywhere it is used.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern for texts of ASCII only, where the standard library's engine is faster.
_ASCII = re.compile(r""" ?[A-Za-z]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\t\n\x0b\x0c\r A-Za-z0-9]+|[\t\n\x0b\x0c\r ]+(?![^\t\n\x0b\x0c\r ])|[\t\n\x0b\x0c\r ]+""")
_ANY = regex.compile(PATTERN)
#: Pieces remembered per worker, and the longest that is.
REMEMBERED, LONGEST = 400_000, 48


class TokenCounter(dict):
    """Counts tokens; as a dict, pieces to their counts."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str | None) -> int:
        """Tokens of *text*; NULL and empty have none."""
        if not text:
            return 0
        return sum(map(self.__getitem__, (_ASCII if text.isascii() else _ANY).findall(text)))


_counters: dict[str, TokenCounter] = {}


def counter(path: str = TOKENIZER) -> TokenCounter:
    """The process's counter of a rank file."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def n_tokens(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of each text as a bigint column; the other columns stay on the JVM side."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path).count
        for texts in batches:
            yield texts.map(lambda x: count(x) if isinstance(x, str) else 0).astype("int64")

    return counted(text)
