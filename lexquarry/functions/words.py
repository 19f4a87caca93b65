"""Words and trigrams of normal texts, made in Python: equal to text.tokens and text.trigrams, with numbers for trigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

LETTERS = b" 0123456789abcdefghijklmnopqrstuvwxyz"
_KEPT = bytes(b if b in LETTERS else 32 for b in bytes(range(256)).lower())
_CODES = bytes(max(0, LETTERS.find(bytes([b]))) for b in range(256))
N = len(LETTERS)
#: Numbers for windows of three letters; after them those of texts of two letters and of one.
TRIGRAMS = N**3 + N**2 + N


def words(text: str | None) -> list[bytes]:
    text = text or ""
    if not text.isascii():  # the two other characters that have an ASCII letter in lower case
        text = text.replace("\u0130", "i?").replace("\u212a", "k")
    return text.encode("ascii", "replace").translate(_KEPT).split()


def trigrams(tokens: list[bytes]) -> np.ndarray:
    """The numbers of the different trigrams of these words with a space between them, in order."""
    code = np.frombuffer(b" ".join(tokens).translate(_CODES), np.uint8).astype(np.uint16)
    if len(code) > 2:
        every = np.sort(code[:-2] * np.uint16(N * N) + code[1:-1] * np.uint16(N) + code[2:], kind="stable")  # by radix
        first = np.ones(len(every), bool)
        np.not_equal(every[1:], every[:-1], out=first[1:])
        return every[first].astype(np.int32)
    if len(code) == 2:
        return np.array([N**3 + N * int(code[0]) + int(code[1])], np.int32)
    return np.array([N**3 + N**2 + int(c) for c in code], np.int32)


@F.pandas_udf(ArrayType(IntegerType()))
def _trigrams(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([trigrams(words(t)) for t in texts], dtype=object)


def trigram_numbers(text: Column) -> Column:
    return _trigrams(text)


@F.pandas_udf(StructType([StructField("size", IntegerType()), StructField("grams", IntegerType())]))
def _lengths(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        found = [words(t) for t in texts]
        yield pd.DataFrame({"size": [len(w) for w in found], "grams": [len(trigrams(w)) for w in found]}, dtype="int32")


def lengths(text: Column) -> Column:
    """Struct: size (tokens) and grams (different trigrams)."""
    return _lengths(text)


@F.pandas_udf(ArrayType(StringType()))
def _tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([[w.decode() for w in words(t)] for t in texts], dtype=object)


def tokens(text: Column) -> Column:
    return _tokens(text)
