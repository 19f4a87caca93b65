"""Hybrid ranking: exact reference, token overlap, trigrams and vectors, fused and gated by tier.

The work is one batch of queries against all articles. Token overlap is an equi-join on tokens; query-side sets are made
once per query. Gates are aggregates per query.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import patterns as P
from lexquarry.functions import scoring as S
from lexquarry.functions import text as T
from lexquarry.functions.quality import rounded
from lexquarry.operators.together import block_of, counted


@dataclass(frozen=True)
class SearchLimits:
    top_k: int = 15
    final_k: int = 12
    min_score: float = 0.08
    min_docs: int = 2
    no_fallback: float = 0.2
    vector_candidates: int = 20
    #: Queries, and letters in them, that are sent to all tasks at once; beyond that they are joined by exchange.
    query_block: int = 1000
    query_letters: int = 4_000_000


def parse_queries(queries: DataFrame) -> DataFrame:
    """Adds reference, allow_low and expanded. queries: query_id, query, allow (asked for tier C), and, if there is one,
    retrieval, the query as it was rewritten: it is searched for, while the query itself is looked at for all else."""
    q = F.col("query")
    sought = F.coalesce("retrieval", "query") if "retrieval" in queries.columns else q
    return queries.select("query_id", "query", T.article_reference(q).alias("reference"), (F.coalesce(F.col("allow"), F.lit(False)) | T.asks_low_confidence(q)).alias("allow_low"), T.expand_query(sought).alias("expanded"))


def sender(parsed: DataFrame, limits: SearchLimits = SearchLimits()) -> Callable[[DataFrame], DataFrame]:
    """How to hand what comes of the queries to a join: to every task if they are few and short, else as Spark sees fit."""
    n, letters = parsed.agg(F.count("*"), F.sum(F.length("expanded"))).first()
    return F.broadcast if n <= limits.query_block and (letters or 0) <= limits.query_letters else lambda df: df


def lexical(parsed: DataFrame, articles: DataFrame, send: Callable | None = None, limits: SearchLimits = SearchLimits()) -> DataFrame:
    """query_id, ord, lexical for the pairs that share a token: by the queries' postings if they make a block; else by a join
    on tokens, and counts of what it lets through."""
    if (few := block_of(parsed, limits)) is not None:
        met = counted(parsed, articles, few, False)
        return met.select("query_id", "ord", S.overlap(F.col("common").cast("long"), F.col("qn"), F.col("n")).alias("lexical"))
    send = send or sender(parsed, limits)
    asked = parsed.select("query_id", T.tokens(F.col("expanded")).alias("words")).select("query_id", F.size("words").alias("qsize"), F.explode_outer("words").alias("token"))
    asked = asked.groupBy("query_id", "qsize", "token").agg(F.count("*").alias("qn"))
    held = articles.select("ord", T.tokens(F.col("text")).alias("words")).select("ord", F.size("words").alias("size"), F.explode_outer("words").alias("token"))
    met = held.join(send(asked), "token").groupBy("query_id", "ord", "qsize", "size", "token", "qn").agg(F.count("*").alias("n"))
    common = met.groupBy("query_id", "ord", "qsize", "size").agg(F.sum(F.least("n", "qn")).alias("common"))
    return common.select("query_id", "ord", S.overlap(F.col("common"), F.col("qsize"), F.col("size")).alias("lexical"))


def trigram_scores(parsed: DataFrame, articles: DataFrame, send: Callable | None = None, limits: SearchLimits = SearchLimits()) -> DataFrame:
    """query_id, ord, trigram for the pairs that share a trigram: as for tokens by postings, or by an equi-join of windows. A
    row's number of trigrams comes along, so nothing is counted twice."""
    if (few := block_of(parsed, limits)) is not None:
        met = counted(parsed, articles, few, True)
        return met.select("query_id", "ord", S.jaccard(F.col("common").cast("long"), F.col("qn"), F.col("n")).alias("trigram"))
    send = send or sender(parsed, limits)

    def grams(rows: DataFrame, key: str, text: Column, size: str) -> DataFrame:
        # Each step is a column of its own: within a lambda it would be made anew for each window.
        clean = rows.select(key, T.normalize_text(text).alias("clean")).select(key, F.length("clean").alias("n"), T.letters(F.col("clean")).alias("chars"))
        # explode_outer: for explode, Spark would put a filter on the array's size below, and make the array there as well.
        each = clean.select(key, T.trigrams(F.col("chars"), F.col("n")).alias("grams"))
        return each.select(key, F.size("grams").alias(size), F.explode_outer("grams").alias("gram"))

    held, asked = grams(articles, "ord", F.col("text"), "n"), grams(parsed, "query_id", F.col("expanded"), "qn")
    common = held.join(send(asked), "gram").groupBy("query_id", "ord", "qn", "n").agg(F.count("*").alias("common"))
    return common.select("query_id", "ord", S.jaccard(F.col("common"), F.col("qn"), F.col("n")).alias("trigram"))


def candidates(parsed: DataFrame, articles: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Scores of the queries and articles that have anything in common, rounded to 5 places. articles: ord, id, article_number, tier, quality, text.
    vectors: query_id, ord, vector (absent pairs count 0)."""
    send = sender(parsed)
    trigram, lexical_ = trigram_scores(parsed, articles, send), lexical(parsed, articles, send)
    told = articles.select("ord", T.plain_number(F.col("article_number")).alias("number"))
    asked = send(parsed.select("query_id", "reference"))
    cited = told.join(asked, F.col("number") == F.col("reference")).select("query_id", "ord")
    # A pair without any evidence scores 0, which no limit lets through, so only pairs with some are made.
    pairs = trigram.join(lexical_, ["query_id", "ord"], "full_outer").join(cited, ["query_id", "ord"], "full_outer")
    if vectors is not None:
        pairs = pairs.join(vectors, ["query_id", "ord"], "full_outer")
    return fused_pairs(pairs, parsed, articles, vectors is not None, send)


def fused_pairs(pairs: DataFrame, parsed: DataFrame, articles: DataFrame, with_vectors: bool, send: Callable | None = None) -> DataFrame:
    """All scores of pairs that have lexical and trigram, and vector if told so; null where there is nothing."""
    send = send or sender(parsed)
    told = articles.select("ord", "id", "article_number", "tier", "quality", T.plain_number(F.col("article_number")).alias("number"))
    pairs = pairs.join(told, "ord").join(send(parsed.select("query_id", "reference")), "query_id")
    vector = S.clamp01(F.coalesce(F.col("vector"), F.lit(0.0))) if with_vectors else F.lit(0.0)
    exact, grams = F.when(F.col("number") == F.col("reference"), 1.0).otherwise(0.0), F.coalesce("trigram", F.lit(0.0))
    quality = F.coalesce(F.col("quality"), F.lit(0.0))
    lex = F.coalesce(F.col("lexical"), F.lit(0.0))
    total = S.fused(F.col("reference"), exact, lex, vector, grams, F.col("tier"), quality)
    return pairs.select("query_id", "ord", "id", "article_number", "tier", "reference", rounded(lex, 5).alias("lexical"), rounded(grams, 5).alias("trigram"), rounded(vector, 5).alias("vector"), exact.alias("exact"), total.alias("fused"))


def top_by_tier(scored: DataFrame, limits: SearchLimits = SearchLimits()) -> DataFrame:
    """Each tier's best; where a reference is hit exactly, only the hits, whatever their score."""
    # Exact hits come first, so the cut keeps them all before rows are exchanged, and the first row tells if there are any.
    kept = scored.where((F.col("fused") >= limits.min_score) | (F.col("exact") > 0))
    own = Window.partitionBy("query_id", "tier")
    rank = F.row_number().over(own.orderBy(F.desc(F.col("exact") > 0), F.desc("fused"), "ord"))
    best = kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limits.top_k)
    return best.withColumn("hit", F.max("exact").over(own) > 0).where(~F.col("hit") | (F.col("exact") > 0)).drop("hit")


def gates(parsed: DataFrame, top: DataFrame, limits: SearchLimits = SearchLimits()) -> DataFrame:
    """query_id, use_b, use_c. C is tried if allowed, no exact hit, and the first kept (A's best, or B's without A) is weak."""
    of = lambda t, x: F.when(F.col("tier") == t, x)
    told = top.groupBy("query_id").agg(
        F.coalesce(F.max(of("A", F.col("exact"))), F.lit(0.0)).alias("exact_a"),
        F.coalesce(F.max(of("B", F.col("exact"))), F.lit(0.0)).alias("exact_b"),
        F.count(of("A", F.lit(1))).alias("n_a"),
        F.max(of("A", F.col("fused"))).alias("top_a"),
        F.max(of("B", F.col("fused"))).alias("top_b"),
    )
    every = parsed.select("query_id", "allow_low").join(told, "query_id", "left").fillna(0.0, ["exact_a", "exact_b"]).fillna(0, ["n_a"])
    use_b = (F.col("exact_a") == 0) & ((F.col("n_a") < limits.min_docs) | (F.col("top_a") < limits.no_fallback))
    first = F.coalesce("top_a", F.when(use_b, F.col("top_b")))
    exact = F.greatest(F.col("exact_a"), F.when(use_b, F.col("exact_b")).otherwise(0.0))
    return every.select("query_id", use_b.alias("use_b"), (F.col("allow_low") & (exact == 0) & (first.isNull() | (first < limits.no_fallback))).alias("use_c"))


def merged(top: DataFrame, gate: DataFrame, limits: SearchLimits = SearchLimits()) -> DataFrame:
    """The gated tiers as one list: the best row of an id, in order of score; ties keep the place where an id first came."""
    used = top.join(gate, "query_id").where((F.col("tier") == "A") | ((F.col("tier") == "B") & F.col("use_b")) | ((F.col("tier") == "C") & F.col("use_c")))
    place = F.struct("tier", "rank")
    same = Window.partitionBy("query_id", "id")
    best = used.withColumn("first", F.min(place).over(same)).withColumn("nth", F.row_number().over(same.orderBy(F.desc("fused"), "tier", "rank"))).where("nth = 1")
    final = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "first"))
    out = best.withColumn("final_rank", final.cast("long")).where(F.col("final_rank") <= limits.final_k)
    return out.select("query_id", "final_rank", "ord", "id", "article_number", "tier", "fused")


def outcome(parsed: DataFrame, selected: DataFrame, notes: DataFrame | None = None, startup: tuple[str, ...] = ()) -> DataFrame:
    """query_id, tier_path, needs_clarification, confidence, warnings (an array: what was said at startup, then notes on
    the query, query_id and note, then those on tiers)."""
    told = selected.groupBy("query_id").agg(F.sort_array(F.collect_set("tier")).alias("path"))
    every = parsed.select("query_id").join(told, "query_id", "left")
    every = every.withColumn("note", F.lit(None).cast("string")) if notes is None else every.join(notes.select("query_id", "note"), "query_id", "left")
    path = F.coalesce("path", F.array().cast("array<string>"))
    has = lambda t: F.array_contains(path, t)
    none = F.size(path) == 0
    confidence = F.when(none | has("C"), "LOW").when(has("B"), "MEDIUM").otherwise("HIGH")
    warnings = F.array_compact(F.array(*map(F.lit, startup), F.col("note"), F.when(has("B"), P.WARN_B), F.when(has("C"), P.WARN_C), F.when(none, P.WARN_NONE)))
    return every.select("query_id", F.array_join(path, ">").alias("tier_path"), none.alias("needs_clarification"), confidence.alias("confidence"), warnings.alias("warnings"))
