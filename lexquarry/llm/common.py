"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.sources.shared import materialize, shared_dir  # noqa: F401 (the operators take them from here)

#: What counts as white space in the operators' contracts: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def shrunk(text: Column) -> Column:
    """The text's UTF-8 bytes, compressed: for texts that are moved and then read in Python."""

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([zstandard.compress(t.encode(), 1) for t in texts], dtype=object)

    return of(text)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def unclashed(df: DataFrame, name: str) -> str:
    """name itself, or a fresh name if df has a column of that name."""
    return fresh(df, name) if name.lower() in {c.lower() for c in df.columns} else name


def word_bytes(digits: bool) -> bytes:
    """A table for bytes.translate: ASCII letters (lower-cased), digits if asked for, and the bytes of all other characters
    stay; the rest become spaces, so that split() gives the words."""
    return bytes(ord(chr(b).lower()) if chr(b).isalpha() or b > 127 or digits and chr(b).isdigit() else 32 for b in range(128)) + bytes(range(128, 256))


def stored_at(path: str):
    """pyarrow's file system for a URI or a plain path, and the path in it: for files that tasks write in the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def open_stored(path: str):
    files, place = stored_at(path)
    return files.open_input_file(place)
