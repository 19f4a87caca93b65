"""Relevance: overlap, trigrams, vectors, and their fusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexquarry.functions.quality import rounded

TIER_WEIGHT = {"A": 1.0, "B": 0.82}
OTHER_TIER = 0.55


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def overlap(common: Column, n_query: Column, n_doc: Column) -> Column:
    """Common tokens over the geometric mean of the lengths; 0 if either is empty."""
    size = F.sqrt(n_query.cast("double") * n_doc.cast("double"))
    return F.when((n_query > 0) & (n_doc > 0), common / size).otherwise(0.0)


def jaccard(common: Column, n_query: Column, n_doc: Column) -> Column:
    union = n_query + n_doc - common
    return F.when(union > 0, common / union.cast("double")).otherwise(0.0)


def tier_weight(tier: Column) -> Column:
    out = F.when(tier == "A", TIER_WEIGHT["A"])
    return out.when(tier == "B", TIER_WEIGHT["B"]).otherwise(OTHER_TIER)


def fused(reference: Column, exact: Column, lexical: Column, vector: Column, trigram: Column, tier: Column, quality: Column) -> Column:
    cited = 0.55 * exact + 0.25 * lexical + 0.10 * vector + 0.10 * trigram
    free = 0.45 * vector + 0.30 * lexical + 0.20 * trigram + 0.05 * exact
    base = F.when(reference.isNotNull(), cited).otherwise(free)
    return rounded(base * tier_weight(tier) * (0.7 + 0.3 * clamp01(quality)), 5)


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    square = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    norm = F.sqrt(inner(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(v.cast("array<double>"))


def vector_score(raw: Column, metric: str) -> Column:
    return clamp01((raw + 1.0) / 2.0) if metric == "ip" else 1.0 / (1.0 + F.greatest(F.lit(0.0), raw))
