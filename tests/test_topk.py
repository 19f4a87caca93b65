"""The bounded search against all pairs: the same best rows, from a small part of the pairs."""

import random

from pyspark.sql import functions as F

from lexquarry.operators import search, topk

LIMITS = search.SearchLimits(top_k=5)


def test_best_rows_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 8))) for _ in range(250)]
    topics = [rng.sample(words, 25) for _ in range(10)]
    text = lambda n: " ".join(rng.choices(rng.choice(topics) + words[:8], k=n))
    articles = [(i, f"a{i % 90}", str(i % 40), rng.choice("ABC"), rng.choice([None, 0.0, 0.5, 1.0]), text(rng.choice([0, 1, 6, 12, 40, 300]))) for i in range(400)]
    queries = [(i, text(rng.choice([1, 5, 15, 60])) + (f" art. {i}" if i % 3 == 0 else ""), i % 2 == 0) for i in range(30)] + [(90, "", False), (91, "zq", True)]
    queries += [(100 + i, articles[i][5], False) for i in range(0, 60, 7)]  # whole articles, whose score is high by words and trigrams alone
    a = spark.createDataFrame(articles, "ord long, id string, article_number string, tier string, quality double, text string")
    parsed = search.parse_queries(spark.createDataFrame(queries, "query_id long, query string, allow boolean"))
    v = spark.createDataFrame([(q, o, rng.random()) for q in range(10) for o in rng.sample(range(400), 40)], "query_id long, ord long, vector double")
    columns = ["query_id", "tier", "rank", "ord", "lexical", "trigram", "vector", "exact", "fused"]
    for vectors in (v, None):
        every = search.candidates(parsed, a, vectors)
        some = topk.best_candidates(parsed, a, vectors, LIMITS)
        rows = lambda df: sorted(search.top_by_tier(df, LIMITS).select(*columns).collect())
        want = rows(every)
        assert rows(some) == want and len(want) > 100
        assert some.count() < 0.8 * every.count()
    assert topk.best_candidates(parsed, a.where("false"), None).count() == topk.best_candidates(parsed.where("false"), a, None).count() == 0


def test_trigrams_are_counted_as_they_are_made(spark):
    texts = ["", "a", "ab", "abc", "aaaa", "abcabc", "un deux trois un deux"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    made = topk.grams_of(df.withColumn("k", F.col("t")), "k", "t").select("k", F.size("grams").alias("n"))
    assert {r["k"]: r["n"] for r in made.collect()} == {r["t"]: r["n"] for r in df.select("t", topk.gram_count(F.col("t")).alias("n")).collect()}
