"""The pairs of query and article that can be among a tier's best: exact bounds before any pair is made.

A pair without a vector or a cited number needs tokens and trigrams in common. How many follows from the score to reach
(the limit, or the k-th best score that pairs with a vector or a cited number have already), from both lengths, and from
the article's tier and quality. An article that has r of a query's n tokens has one of the n - r + 1 rarest: so a pair is
only made at a token or trigram that stands early enough in its query's order. Articles are put into blocks by tier and
length; what the best article of a block could reach decides, once a block, which of a query's tokens are looked up there
at all. Scores are then made exactly, for these pairs alone.

That is for many queries. A block of few short ones is scored against each article by postings (together.py), in one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import scoring as S
from lexquarry.functions import text as T
from lexquarry.functions import words as W
from lexquarry.operators import search
from lexquarry.operators.together import block_of, scored
from lexquarry.sources.shared import materialize

#: Weights of words and trigrams in the score with and without a reference; what a rounded score may gain.
CITED, FREE, SLACK = (0.25, 0.10), (0.30, 0.20), 0.000006
#: Of a score that words and trigrams reach together, the words' part: less than that, and trigrams have to bring the rest.
WORDS_PART = 0.375


def gram_count(clean: Column) -> Column:
    """Different trigrams of a text, without an array of them."""
    return W.lengths(clean)["grams"]


def facts(articles: DataFrame) -> DataFrame:
    """ord, tier, factor (what a score is multiplied with), size (tokens), grams (different trigrams), block."""
    measured = articles.select("ord", "tier", "quality", W.lengths(F.col("text")).alias("lengths"))
    factor = S.tier_weight(F.col("tier")) * (0.7 + 0.3 * S.clamp01(F.coalesce("quality", F.lit(0.0))))
    rows = measured.select("ord", "tier", factor.alias("factor"), "lengths.size", "lengths.grams")
    return rows.withColumn("block", F.concat_ws(":", "tier", F.floor(F.log2(F.col("size") + 1))))


def words_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(key, F.explode_outer(W.tokens(F.col(text))).alias("unit"))


def grams_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key and grams, an array of their numbers."""
    return rows.select(key, W.trigram_numbers(F.col(text)).alias("grams"))


def needed(q: dict[str, Column], least: Column, factor: Column, size: Column, small: Column, large: Column) -> tuple[Column, Column]:
    """Tokens, and trigrams, of which a query and an article must have one or the other number in common. The article has at
    least small and at most large trigrams and at least size tokens; a score over least / factor is to be reached."""
    score = (least - SLACK) / factor
    ratio = F.when(q["grams"] < small, q["grams"] / F.greatest(small, F.lit(1))).when(q["grams"] > large, large / F.greatest(q["grams"], F.lit(1))).otherwise(1.0)
    words, grams = q["words_weight"], q["grams_weight"]
    overlap = F.greatest((score - grams * ratio) / words, WORDS_PART * score / words)
    jaccard = (1 - WORDS_PART) * score / grams
    root = F.sqrt(q["size"].cast("double") * size.cast("double"))
    tokens = F.greatest(F.ceil(overlap * root - 1e-9), F.lit(1))
    # Trigrams are needed only if the lengths let their similarity get there.
    common = F.when(ratio < jaccard - 1e-9, F.lit(2**31 - 1)).otherwise(F.ceil(jaccard / (1 + jaccard) * (q["grams"] + small) - 1e-9))
    return tokens, F.greatest(common, F.lit(1))


def met(asked: DataFrame, held: DataFrame, least: DataFrame, blocks: list, grams: bool, limits: search.SearchLimits, send) -> DataFrame:
    """query_id, ord of the pairs that have a unit in common early enough in the query's order, the rarest first.
    asked: query_id, unit, n (its times) and the query's measures; held: ord, unit and the article's facts."""
    seen = held.groupBy("unit").agg(F.count("*").alias("df"))
    order = Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "unit")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = materialize(asked.join(seen, "unit", "left").withColumn("before", before).where("df is not null").drop("df", "n"), "placed")
    q = {c: F.col(c) for c in ("size", "grams", "words_weight", "grams_weight")}
    total = F.col("grams" if grams else "size")
    table = F.array(*(F.struct(*(F.lit(b[c]).alias(f"b_{c}") for c in ("block", "tier", "factor", "size", "small", "large"))) for b in blocks))
    each = placed.withColumn("b", F.explode(table)).select("*", "b.*").drop("b")
    each = each.join(least.withColumnRenamed("tier", "b_tier"), ["query_id", "b_tier"], "left").withColumn("least", F.coalesce("least", F.lit(limits.min_score)))
    bound = needed(q, F.col("least"), F.col("b_factor"), F.col("b_size"), F.col("b_small"), F.col("b_large"))[grams]
    each = materialize(each.where(F.col("before") + bound <= total).select("query_id", "unit", F.col("b_block").alias("block"), "before", "least", *(F.col(c).alias(f"q_{c}") for c in q)), "asked-blocks")
    both = held.join(send(each), ["unit", "block"])
    q = {c: F.col(f"q_{c}") for c in q}
    exact = needed(q, F.col("least"), F.col("factor"), F.col("size"), F.col("grams"), F.col("grams"))[grams]
    return materialize(both.where(F.col("before") + exact <= q["grams" if grams else "size"]).select("query_id", "ord"), "met")


def sure_pairs(parsed: DataFrame, articles: DataFrame, vectors: DataFrame | None, send) -> DataFrame:
    """query_id, ord of the pairs with a cited number or a vector."""
    numbers = articles.select("ord", T.plain_number(F.col("article_number")).alias("number"))
    sure = numbers.join(send(parsed.select("query_id", "reference")), F.col("number") == F.col("reference")).select("query_id", "ord")
    return sure if vectors is None else sure.union(vectors.select("query_id", "ord")).distinct()


def best_candidates(parsed: DataFrame, articles: DataFrame, vectors: DataFrame | None = None, limits: search.SearchLimits = search.SearchLimits()) -> DataFrame:
    """As search.candidates, without the pairs that can't be among the top_k of their tier or don't reach min_score. vectors
    may also have tier and id in place of ord."""
    send = search.sender(parsed, limits)
    if (few := block_of(parsed, limits)) is not None:
        scores = scored(parsed, articles, few, vectors, ((*CITED, 0.10, 0.55), (*FREE, 0.45, 0.05)), 2 * SLACK, limits, send)
        return materialize(search.fused_pairs(scores, parsed, articles.drop("text"), vectors is not None, send), "scores")
    if vectors is not None and "ord" not in vectors.columns:
        vectors = materialize(articles.select("ord", "tier", "id").join(vectors, ["tier", "id"]).select("query_id", "ord", "vector"), "vectors")
    known = materialize(facts(articles), "facts")
    words = words_of(parsed, "query_id", "expanded").groupBy("query_id", "unit").agg(F.count("*").alias("n"))
    asked_grams = materialize(grams_of(parsed, "query_id", "expanded"), "asked-grams")
    cited = F.col("reference").isNotNull()
    measures = parsed.select("query_id", F.size(T.tokens(F.col("expanded"))).alias("size"), *(F.when(cited, F.lit(c)).otherwise(F.lit(f)).alias(n) for c, f, n in zip(CITED, FREE, ("words_weight", "grams_weight"), strict=True)))
    measures = measures.join(asked_grams.select("query_id", F.size("grams").alias("grams")), "query_id")
    measures = materialize(measures, "measures")
    asked = materialize(words.join(measures, "query_id"), "asked")
    vocabulary = send(asked.select("unit").distinct())
    held = words_of(articles, "ord", "text").join(vocabulary, "unit", "left_semi").groupBy("ord", "unit").agg(F.count("*").alias("n")).join(known, "ord")
    held = materialize(held, "held")

    sure = materialize(sure_pairs(parsed, articles, vectors, send), "sure")
    first = score_pairs(sure, parsed, articles, asked, held, asked_grams, vectors)
    rank = F.row_number().over(Window.partitionBy("query_id", "tier").orderBy(F.desc("fused"), "ord"))
    least = first.withColumn("rank", rank).where(F.col("rank") == limits.top_k).select("query_id", "tier", F.greatest("fused", F.lit(limits.min_score)).alias("least"))
    least = materialize(least, "least")

    # A row a tier and power of two of the length.
    own = F.min("size").alias("size"), F.min("grams").alias("small"), F.max("grams").alias("large"), F.max("factor").alias("factor")
    blocks = known.groupBy("block", "tier").agg(*own).collect()
    if not blocks:
        return score_pairs(sure, parsed, articles, asked, held, asked_grams, vectors)
    by_words = met(asked, held.drop("n"), least, blocks, False, limits, send)
    lengths = measures.agg(F.min("grams").alias("lo"), F.max("grams").alias("hi")).first()
    top = (1 - WORDS_PART) * (limits.min_score - SLACK) / max(CITED[1], FREE[1])  # the least similarity that trigrams need
    short = known.where((F.col("grams") * top <= F.col("factor") * (lengths["hi"] or 0)) & (F.col("grams") * F.col("factor") >= top * (lengths["lo"] or 0)))
    each = grams_of(articles.join(short.select("ord"), "ord", "left_semi"), "ord", "text").select("ord", F.explode_outer("grams").alias("unit"))
    each = materialize(each.join(short, "ord"), "grams")
    gram_asked = asked_grams.select("query_id", F.explode_outer("grams").alias("unit")).withColumn("n", F.lit(1)).join(measures, "query_id")
    by_grams = met(gram_asked, each, least, blocks, True, limits, send)
    return score_pairs(reduce(DataFrame.union, [by_words, by_grams, sure]).distinct(), parsed, articles, asked, held, asked_grams, vectors)


def score_pairs(pairs: DataFrame, parsed: DataFrame, articles: DataFrame, asked: DataFrame, held: DataFrame, asked_grams: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """The candidates' scores for these pairs (query_id, ord): words by a join on article and token, trigrams set by set."""
    pairs = materialize(pairs, "pairs")
    tokens = asked.select("query_id", "unit", F.col("n").alias("qn"), F.col("size").alias("qsize"))
    common = pairs.join(tokens, "query_id").join(held.select("ord", "unit", "n", "size"), ["ord", "unit"]).groupBy("query_id", "ord", "qsize", "size").agg(F.sum(F.least("n", "qn")).alias("common"))
    lexical = common.select("query_id", "ord", S.overlap(F.col("common"), F.col("qsize"), F.col("size")).alias("lexical"))
    sets = grams_of(articles.join(pairs.select("ord").distinct(), "ord", "left_semi"), "ord", "text")
    both = pairs.join(sets, "ord").join(asked_grams.withColumnRenamed("grams", "qgrams"), "query_id")
    shared = F.size(F.array_intersect("grams", "qgrams"))
    trigram = both.select("query_id", "ord", S.jaccard(shared, F.size("qgrams"), F.size("grams")).alias("trigram"))
    scores = pairs.join(lexical, ["query_id", "ord"], "left").join(trigram, ["query_id", "ord"], "left")
    if vectors is not None:
        scores = scores.join(vectors, ["query_id", "ord"], "left")
    return materialize(search.fused_pairs(scores, parsed, articles, vectors is not None), "scores")
