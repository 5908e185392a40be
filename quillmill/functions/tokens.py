"""Token counts and token pieces, by words or by a byte-pair vocabulary.

The word tokenizer is native: a token is a run of non-blank characters with the blanks
before it, so a text's pieces joined are the text. A byte-pair tokenizer runs in Arrow
batches, made once in a worker from a rank file whose path is a parameter.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = re.compile(r"\s*\S+|\s+\Z")
_encoders: dict[str, object] = {}


def encoder(path: str):
    """The byte-pair encoder of a rank file, one for each worker process."""
    if path not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def counter(bpe: str | None = None) -> Callable[[str], int]:
    """Counts the tokens of one text; special-token strings count as ordinary text."""
    if bpe is None:
        return lambda text: len(text.split())
    encode = encoder(bpe).encode_ordinary
    return lambda text: len(encode(text))


def windows(text: str, width: int, step: int, bpe: str | None = None) -> list[str]:
    """Overlapping windows of tokens; the last one ends with the text."""
    tokens = PIECE.findall(text) if bpe is None else encoder(bpe).encode_ordinary(text)
    join = "".join if bpe is None else encoder(bpe).decode
    last = max(len(tokens) - width, 0)
    starts = range(0, last + step, step) if last else (0,)
    return [join(tokens[s : s + width]) for s in starts]


def count_tokens(text: Column, bpe: str | None = None) -> Column:
    if bpe is None:
        return F.regexp_count(text, F.lit(r"(?U)\S+"))

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(counter(bpe), na_action="ignore")

    return counted(text)


def pieces(text: Column) -> Column:
    """Lossless word pieces."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(\s*\S+|\s+\z)"), F.lit(1))
