"""Quality of recognised text: score, reasons and tiers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lexquarry.functions import patterns as P
from lexquarry.functions.text import is_heading


@dataclass(frozen=True)
class TierLimits:
    trusted: float = 0.88
    quarantine: float = 0.70
    low_ratio: float = 0.20
    critical: int = 2
    suspicious: float = 0.78
    low_block: float = 0.70


def rounded(x: Column, places: int) -> Column:
    """Half up on the binary value, as the SQL twins do it."""
    scale = F.lit(float(10**places))
    return F.floor(x * scale + F.lit(0.5)) / scale


_BYTES = bytes(range(256)).decode("latin-1")
#: By Latin-1 character: 1 if tokens are made of it, 2 if it is a consonant, 4 if it is a Roman number; other characters are
#: read as a question mark.
_KINDS = np.array([bool(re.match(P.TOKEN, c)) + 2 * bool(re.match(P.CONSONANTS.removesuffix("{5,}"), c)) + 4 * bool(re.match(P.ROMAN, c)) for c in _BYTES], np.uint8)
#: patterns.BAD and patterns.CLUSTER, whose white space and word characters are Python's own.
_BAD = re.compile(r"""[^\w\s.,;:!?()\[\]{}%/\-+'"°ªº€$£]""")
_CLUSTER = re.compile(rf"(?:\b[{P.LATIN}]\s++(?=[{P.LATIN}]\b)){{3,}}+[{P.LATIN}]\b")
#: Latin-1 characters that are not bad.
_GOOD = bytes(b for b in range(256) if not _BAD.match(chr(b)))
#: Letters of texts that are looked at together, about.
TOGETHER = 4_000_000


def _bad(text: str) -> int:
    try:
        return len(text.encode("latin-1").translate(None, _GOOD))
    except UnicodeEncodeError:
        return len(_BAD.findall(text))


def _token_counts(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of each text: its tokens, those of one letter that is no Roman number, those of five or more consonants alone, rows of
    four or more spaced letters, and bad characters."""
    raw = [t.encode("latin-1", "replace") for t in texts]
    data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
    kind = _KINDS[data]
    text_starts = np.cumsum([1, *(len(r) + 1 for r in raw)])
    edges = np.flatnonzero(np.diff(kind & 1)) + 1  # a token's front and what follows it, in turn
    fronts, ends = edges[::2], edges[1::2]
    size, hard = ends - fronts, np.concatenate([[0], np.cumsum((kind & 2) > 0)])
    single, vowelless = (size == 1) & (kind[fronts] & 4 == 0), (size >= 5) & (hard[ends] - hard[fronts] == size)
    upto = np.searchsorted(fronts, text_starts)
    # The inner letters of a row are tokens of their own; the outer ones are too, but for an apostrophe on their other side.
    one = size == 1
    last, first = one | (data[np.maximum(ends - 2, 0)] == 39), one | (data[np.minimum(fronts + 1, len(data) - 1)] == 39)
    row = np.zeros(len(size), bool)
    if len(size) > 3:
        row[:-3] = last[:-3] & one[1:-2] & one[2:-1] & first[3:]
    clusters = np.zeros(len(texts), np.int64)
    for i in np.unique(np.searchsorted(text_starts, fronts[row], "right") - 1).tolist():
        clusters[i] = sum(1 for _ in _CLUSTER.finditer(texts[i]))
    bad = np.array([_bad(t) for t in texts], np.int64)
    return np.diff(upto), *(np.diff(np.concatenate([[0], np.cumsum(x)])[upto]) for x in (single, vowelless)), clusters, bad


_COUNTS = ("n", "single", "vowelless", "clusters", "bad")


@F.pandas_udf(StructType([StructField(x, IntegerType()) for x in _COUNTS]))
def _counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        values, at, parts = texts.fillna("").tolist(), 0, []
        ends = np.cumsum([len(t) for t in values])
        while at < len(values):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
            parts.append(_token_counts(values[at:upto]))
            at = upto
        columns = [np.concatenate(x) if x else np.zeros(0) for x in zip(*parts, strict=True)] or [np.zeros(0)] * len(_COUNTS)
        yield pd.DataFrame(dict(zip(_COUNTS, columns, strict=True))).astype("int32")


def token_counts(text: Column) -> Column:
    """Struct: n (tokens), single and vowelless (such tokens), clusters (rows of spaced letters), bad (characters)."""
    return _counted(text)


def ocr_measures(text: Column, counts: Column) -> Column:
    """Struct: n (tokens), single, vowelless, cluster, bad (ratios), heading. counts: the text's token_counts."""
    n, clusters = counts["n"], counts["clusters"]
    some = F.greatest(n, F.lit(1)).cast("double")
    return F.struct(
        n.alias("n"),
        (counts["single"] / some).alias("single"),
        (counts["vowelless"] / some).alias("vowelless"),
        clusters.alias("clusters"),
        (clusters / F.greatest(some / 35.0, F.lit(1.0))).alias("cluster"),
        (counts["bad"] / F.greatest(F.length(text), F.lit(1)).cast("double")).alias("bad"),
        is_heading(text).alias("heading"),
    )


def ocr_quality(text: Column) -> Column:
    return ocr_score(ocr_measures(text, token_counts(text)))


def ocr_score(m: Column) -> Column:
    """Struct score, reasons. Texts without letters, and headings, are perfect; very short ones nearly so."""
    loss = 0.7 * m["single"] + 1.3 * m["cluster"] + 1.0 * m["vowelless"] + 1.4 * m["bad"]
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.least(F.lit(1.0), loss)))
    flags = zip(P.REASONS, (m["single"] > 0.22, m["cluster"] > 0.18, m["vowelless"] > 0.08, m["bad"] > 0.015), strict=True)
    reasons = F.array_compact(F.array(*(F.when(test, name) for name, test in flags)))
    none = F.array().cast("array<string>")
    perfect, short = (m["n"] == 0) | m["heading"], (m["n"] <= 5) & (m["clusters"] == 0)
    return F.struct(
        F.when(perfect, 1.0).when(short, 0.95).otherwise(score).alias("score"),
        F.when(perfect | short, none).otherwise(reasons).alias("reasons"),
    )


def tier(score: Column, critical: Column, low: Column, blocks: Column, limits: TierLimits = TierLimits()) -> Column:
    """A, B or C by an article's score, blocks with critical reasons, low blocks and blocks."""
    ratio = low / F.greatest(blocks, F.lit(1)).cast("double")
    return (
        F.when((score < limits.quarantine) | (critical >= limits.critical) | (ratio > limits.low_ratio), "C")
        .when((score >= limits.trusted) & (critical == 0) & (low == 0), "A")
        .otherwise("B")
    )


def tier_reason(name: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in P.TIER_REASONS.items() for x in pair)), name)
