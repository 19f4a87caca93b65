"""A block of queries by postings against the joins for many queries, and words made in Python against the Column forms."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from lexquarry.functions import text as T
from lexquarry.functions import words as W
from lexquarry.operators import search, topk

MANY = search.SearchLimits(top_k=5, query_block=0)


def test_words_of_every_character(spark):
    texts = [" ".join(f"a{chr(c)}B{chr(c)}" for c in range(at, at + 64) if not 0xD800 <= c < 0xE000) for at in range(0, 0x11000, 64)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", "a", "ab", "İK ΑΣ"]], "t string")
    rows = df.select(T.tokens(F.col("t")).alias("want"), W.tokens(F.col("t")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows)


def test_trigram_numbers():
    rng = random.Random(3)
    for n in [0, 1, 2, 3, 4, 50, 400]:
        tokens = [w.encode() for w in "".join(rng.choices("ab9z 0", k=n)).split()]
        clean = b" ".join(tokens).decode()
        want = {clean[i : i + 3] for i in range(max(1, len(clean) - 2))} if clean else set()
        assert len(W.trigrams(tokens)) == len(want) and W.trigrams(tokens).max(initial=0) < W.TRIGRAMS
    assert len(np.unique([W.trigrams([x])[0] for x in (b"a", b"0", b"0a", b"a0", b"00a", b"aa", b"aaa")])) == 7


def made(spark, n):
    rng = random.Random(8)
    words = ["".join(rng.choices("etaoin", k=rng.randint(1, 6))) for _ in range(120)]
    text = lambda k: " ".join(rng.choices(words, k=k))
    articles = [(i, f"a{i % 50}", str(i % 40), rng.choice("ABC"), rng.choice([None, 0.0, 0.5, 1.0]), text(rng.choice([0, 1, 9, 60]))) for i in range(n)]
    articles += [(n + i, *articles[7][1:]) for i in range(20)]  # copies that tie
    queries = [(f"q{i}", text(rng.choice([1, 5, 30])) + (f" art. {i}" if i % 3 == 0 else ""), False) for i in range(20)] + [("none", "", False), ("copy", articles[7][5], True)]
    a = spark.createDataFrame(articles, "ord long, id string, article_number string, tier string, quality double, text string")
    return search.parse_queries(spark.createDataFrame(queries, "query_id string, query string, allow boolean")), a


def test_block_equals_joins(spark, monkeypatch):
    from lexquarry.operators import together

    monkeypatch.setattr(together, "ROWS", 7)
    parsed, a = made(spark, 200)
    rows = lambda df: sorted(map(repr, df.collect()))
    for f in (search.lexical, search.trigram_scores):
        want = rows(f(parsed, a, limits=MANY))
        assert rows(f(parsed, a)) == want and len(want) > 100
    few = search.SearchLimits(top_k=5)
    columns = ["query_id", "tier", "rank", "ord", "lexical", "trigram", "exact", "fused"]
    best = lambda limits: search.top_by_tier(topk.best_candidates(parsed, a, None, limits), limits).select(*columns)
    assert rows(best(few)) == rows(best(MANY))


def test_a_block_exchanges_no_words(spark):
    parsed, a = made(spark, 60)
    for f in (search.lexical, search.trigram_scores):
        plan = f(parsed, a)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "MapInArrow" in plan


def test_a_long_corpus_is_scored_in_little_time(spark):
    parsed, a = made(spark, 200)
    big = a.withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 300)).repartition(4)
    began = time.time()
    topk.best_candidates(parsed, big, None).count()
    assert time.time() - began < 60
