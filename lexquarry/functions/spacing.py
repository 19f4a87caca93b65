"""Lines, white space and inline articles of whole texts, made in Python. Its white space is that of patterns.WS."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType

#: A run of white space is only looked at from its front, and never given back, so it costs its length once.
_RUN = r"\s(?<!\s\s)\s*+"
_UNEVEN = re.compile(r"[\s(\[{](?:(?<=\s)[,.;:!?)\]}]|(?<=[(\[{])\s)")
_BLANKS = re.compile(r"[ \t]{2,}|\t")
_BEFORE = re.compile(rf"{_RUN}([,.;:!?])")
_OPENED = re.compile(r"([(\[{])\s++")
_CLOSED = re.compile(rf"{_RUN}([)\]}}])")
_DASH = re.compile(rf"{_RUN}-\s++")
_PLAIN = (("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("−", "-"), ("…", "..."))
_INLINE = re.compile(r"([.;:?!»\"]\s*+)((?i:art)\.?\s*+\d)")
_INLINE_START = re.compile(r"(?i:art)\.?\s*+\d")


def spaces(x: str) -> str:
    if "\xa0" in x:
        x = x.replace("\xa0", " ")
    if "\t" in x or "  " in x:
        x = _BLANKS.sub(" ", x)
    if _UNEVEN.search(x):
        x = _CLOSED.sub(r"\1", _OPENED.sub(r"\1", _BEFORE.sub(r"\1", x)))
    return x.strip()


def typography(x: str) -> str:
    if not x.isascii():
        for curly, plain in _PLAIN:
            x = x.replace(curly, plain)
    return spaces(_DASH.sub(" - ", x) if "-" in x else x)


def articles(x: str) -> list[str]:
    """A block cut where articles start, if there are several: at the front, or after a mark that ends a sentence."""
    marked, n = _INLINE.subn("\\1\x1e\\2", x)
    if n + bool(_INLINE_START.match(x)) < 2:
        return [x]
    return [p for part in marked.split("\x1e") if (p := part.strip())]


class Pairs:
    """Finds texts that hold one of some pairs of neighbouring bytes (UTF-8), or a space at an end, without making them."""

    def __init__(self, *pairs: tuple[bytes, bytes]):
        self.first, self.second = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
        for bit, (before, after) in enumerate(pairs):
            self.first[list(before)] |= np.uint8(1 << bit)
            self.second[list(after)] |= np.uint8(1 << bit)

    def rows(self, texts: pa.Array) -> np.ndarray:
        """The numbers of such texts, and of some others: a pair may lie across two texts."""
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        ends = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        if ends[0] == ends[-1]:
            return np.zeros(0, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        at = np.flatnonzero(self.first[np.concatenate([[32], data[:-1]]).astype(np.uint8)] & self.second[data])
        inner = np.searchsorted(ends, at + ends[0], "right") - 1
        some = np.flatnonzero(ends[1:] > ends[:-1])
        padded = some[(data[ends[some] - ends[0]] == 32) | (data[ends[some + 1] - ends[0] - 1] == 32)]
        return np.unique(np.concatenate([inner, padded]))


_ANY, _ODD = bytes(range(256)), bytes([*range(9, 14), *range(28, 32)])
#: White space other than a space alone: odd characters, and the first two bytes of those beyond ASCII.
_WIDE = ((_ANY, _ODD), (b" ", b" "), (b"\xc2", b"\x85\xa0"), (b"\xe1", b"\x9a"), (b"\xe2", b"\x80\x81"), (b"\xe3", b"\x80"))
_JOINED = Pairs(*_WIDE)
_SPACED = Pairs(*_WIDE, (b" ", b",.;:!?)]}"), (b"([{", b" "))
#: A dash between two single spaces stays as it is; quotes, dashes and dots to be made plain begin with \xe2\x80, the minus with \xe2\x88.
_TYPED = Pairs(*_WIDE[:4], (b"\xe2", b"\x80\x81\x88"), *_WIDE[5:], (b" ", b",.;:!?)]}"), (b"([{", b" "))


def _arrow(make: Callable[[pa.Array], pa.Array], kind: DataType) -> Callable[[Column], Column]:
    @F.arrow_udf(kind)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield make(texts)

    # Lists are exploded, and Spark then asks first if a list has members: it would make it twice, once below an exchange.
    return of.asNondeterministic() if isinstance(kind, ArrayType) else of


def changed(make: Callable[[str], str], pairs: Pairs) -> Callable[[pa.Array], pa.Array]:
    """make of each text; it is only called for those in which pairs finds something, as it leaves all others alone."""

    def of(texts: pa.Array) -> pa.Array:
        rows = pairs.rows(texts)
        if not len(rows):
            return texts
        mask = np.zeros(len(texts), bool)
        mask[rows] = True
        new = [None if t is None else make(t) for t in texts.take(pa.array(rows)).to_pylist()]
        return pc.replace_with_mask(texts, pa.array(mask), pa.array(new, texts.type))

    return of


def listed(make: Callable[[str], list[str]]) -> Callable[[pa.Array], pa.Array]:
    return lambda texts: pa.array([None if t is None else make(t) for t in texts.to_pylist()], pa.list_(pa.string()))


def cut(texts: pa.Array) -> pa.Array:
    """articles of each text; those without a word that ends as art and no letter after it are not looked at."""
    maybe = pc.fill_null(pc.match_substring_regex(texts, "(?i)art[^a-z]"), False).to_pylist()
    return pa.array([t if t is None else articles(t) if look else [t] for t, look in zip(texts.to_pylist(), maybe, strict=True)], pa.list_(pa.string()))


split_lines = _arrow(listed(str.splitlines), ArrayType(StringType()))
normalize_spaces = _arrow(changed(spaces, _SPACED), StringType())
normalize_typography = _arrow(changed(typography, _TYPED), StringType())
single_spaced = _arrow(changed(lambda x: " ".join(x.split()), _JOINED), StringType())
split_articles = _arrow(cut, ArrayType(StringType()))
