"""Exact token counts of a public byte-level BPE tokenizer, fast over whole texts.

The tokenizer first cuts a text by a pattern and merges bytes inside each cut only. White space never joins
what precedes it, so a text may be taken apart before every run of white space (and, in CJK text, between
letters and punctuation) without changing its tokens. The counts of such *units* add up exactly, and most
units are short words that recur, so a bounded memo answers nearly all of them.
"""

from __future__ import annotations

import base64
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("TIDELINE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")  # default of the parameter

# The pattern of the vocabulary's public tokenizer, and the white space of its \s.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RARE_SPACE = "\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CJK = "\u3400-\u4dbf\u4e00-\u9fff\u3041-\u3096\u30a1-\u30fa"
CJK_MARKS = "、。，；：（）「」！？"

LONG_UNIT = 24  # characters; longer ones are not remembered
MEMO = 400_000  # units remembered at most

_SPACED = re.compile(f"[ \\n{RARE_SPACE}]*[^ \\n{RARE_SPACE}]+|[ \\n{RARE_SPACE}]+")
_CJK_CUT = re.compile(f"(?<=[{CJK}])(?=[{CJK_MARKS}])|(?<=[{CJK_MARKS}])(?=[{CJK}])")
_RUNS = ["".join(r) for r in itertools.product(" \n", repeat=3)]


def units(text: str) -> list[str]:
    """``text`` in pieces whose token counts add up to that of ``text``; joined they are ``text``."""
    rare = "\x00" in text or text[-2:].isspace() or any(r in text for r in _RUNS)
    rare = rare or any(c in text for c in (RARE_SPACE[:4] if text.isascii() else RARE_SPACE))
    parts = _SPACED.findall(text) if rare else [p for p in text.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00") if p]
    if not text.isascii() and any(c in text for c in CJK_MARKS[:3]):
        return [q for p in parts for q in (_CJK_CUT.split(p) if len(p) > 4 and not p.isascii() else (p,))]
    return parts


class TokenCounter(dict):
    """Token count by unit, for one vocabulary file; as a dict it is the bounded memo."""

    _own: dict[str, TokenCounter] = {}

    def __init__(self, vocabulary: str) -> None:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, unit: str) -> int:
        # Lone surrogates cannot be encoded; they count as the replacement character.
        n = len(self.encoding.encode_ordinary(unit.encode("utf-8", "replace").decode()))
        if len(unit) <= LONG_UNIT and len(self) < MEMO:
            self[unit] = n
        return n

    @classmethod
    def of(cls, vocabulary: str) -> TokenCounter:
        """The counter of this process; a worker reads the vocabulary once."""
        if vocabulary not in cls._own:
            cls._own[vocabulary] = cls(vocabulary)
        return cls._own[vocabulary]

    def counts(self, parts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, units(text))) if text else 0


def with_tokens(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``tokens`` (BIGINT) of every row; a NULL or empty text has 0 tokens. The text itself is left behind."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", tokens long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter.of(vocabulary)
        for batch in batches:
            tokens = pa.array([counter.count(x) for x in batch.column("_text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], tokens], [*keep, "tokens"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(count, schema)
