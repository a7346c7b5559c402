"""Token counts by a public byte-level BPE vocabulary, in Arrow batches."""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Place of the vocabulary (ranks file); overridden by the environment or by parameters.
VOCABULARY = os.environ.get("CASEWRIGHT_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# Fixed value: the word pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Vocabulary of many languages; its whole words tell common words from rare ones.
WORDS = os.environ.get("CASEWRIGHT_WORDS", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

_ENCODINGS: dict[str, object] = {}
_COMMON: dict[str, frozenset[str]] = {}


def ship(spark: SparkSession, path: str) -> None:
    """Send a vocabulary file of the driver to the executors, once per session; they need no copy of their own."""
    sc = spark.sparkContext
    if not any(os.path.basename(x) == os.path.basename(path) for x in sc.listFiles):
        sc.addFile(path)


def _ranks(path: str) -> dict[bytes, int]:
    place = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
    with open(place, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def common_words(path: str = WORDS) -> frozenset[str]:
    """Whole words of a vocabulary as they are spelled there, loaded once per process."""
    if path not in _COMMON:
        spelled = (x[1:].decode("utf-8", "ignore") for x in _ranks(path) if x[:1] == b" ")
        _COMMON[path] = frozenset(x for x in spelled if x.isalpha())
    return _COMMON[path]


def encoding(path: str = VOCABULARY):
    """The encoder, loaded once per Python worker."""
    if path not in _ENCODINGS:
        import tiktoken

        _ENCODINGS[path] = tiktoken.Encoding("casewright", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})
    return _ENCODINGS[path]


def count_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of a text as bigint; 0 for null and empty texts."""
    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(path)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)
