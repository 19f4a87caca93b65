"""A block's pairs: only those that a task can't rule out become rows, whichever way vectors are keyed."""

import random

from lexquarry.functions import words as W
from lexquarry.operators import search, topk
from lexquarry.operators.together import Block

LIMITS = search.SearchLimits(top_k=3)


def test_pairs_with_vectors_and_hits_are_ruled_out_too(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoin", k=rng.randint(1, 6))) for _ in range(80)]
    text = lambda k: " ".join(rng.choices(words, k=k))
    rows = [(i, f"a{i % 6}", str(i % 4), rng.choice("ABC"), rng.choice([None, 0.4, 1.0]), text(rng.choice([0, 2, 20]))) for i in range(600)]
    a = spark.createDataFrame(rows, "ord long, id string, article_number string, tier string, quality double, text string").repartition(2)
    queries = [(i, text(6) + (f" art. {i % 5}" if i % 2 else ""), False) for i in range(8)]
    parsed = search.parse_queries(spark.createDataFrame(queries, "query_id long, query string, allow boolean"))
    by_id = spark.createDataFrame([(q, t, f"a{i}", rng.random()) for q in range(5) for t in "AB" for i in range(5)], "query_id long, tier string, id string, vector double")
    by_ord = a.select("ord", "tier", "id").join(by_id, ["tier", "id"]).select("query_id", "ord", "vector")
    best = lambda df: sorted(search.top_by_tier(df, LIMITS).select("query_id", "tier", "rank", "ord", "lexical", "trigram", "vector", "exact", "fused").collect())
    want = best(search.candidates(parsed, a, by_ord))
    for vectors in (by_ord, by_id):
        got = topk.best_candidates(parsed, a, vectors, LIMITS)
        assert best(got) == want
        assert got.count() < 8 * 3 * (3 + 3) * max(2, a.rdd.getNumPartitions())  # before: every pair with a vector or a cited number
    assert best(topk.best_candidates(parsed, a, by_id, search.SearchLimits(top_k=3, query_block=0))) == want


def test_matrix_and_postings_count_the_same():
    block, texts = Block(["ab abc ab", "", "x", "zz top abc"]), [W.words(t) for t in ("abc ab ab ab zz", "", "x", "ab")]
    n, shared = block.trigrams(texts)
    assert block.by_gram.matrix is not None and n.tolist() == [len(W.trigrams(t)) for t in texts]
    block.by_gram.matrix = None
    assert (block.trigrams(texts)[1] == shared).all() and block.words(texts)[1].tolist() == [[3, 0, 0, 2], [0] * 4, [0, 0, 1, 0], [1, 0, 0, 0]]
