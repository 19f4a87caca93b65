import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lexquarry.llm import lexical as L


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    total, words, df, out = len(counts), sum(n for *_, n in counts), Counter(t for _, c, _ in counts for t in c), Counter()
    for item, text in items:
        scores = []
        for i, c, n in counts:
            m = 50 + 50 * n * total // words
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scores.append((-score, i is None, i))
        out.update((item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1))
    return out


def tables(rng):
    words = ["".join(rng.choices("etaoinshrdluéЖ", k=rng.randint(1, 7))) for _ in range(900)]
    topics = [rng.sample(words, 60) for _ in range(12)]
    texts = [rng.choice([" ", "-", "\n", "_"]).join(rng.choices(rng.choice(topics) + words[:15], k=rng.choice([1, 30, 90, 300]))) for _ in range(700)]
    texts += [texts[0]] * 130 + [None, "", "?!", "Word9 word9 WORD9 9", "x" * 1000]
    docs = list(enumerate(texts, 5))
    docs += [(None, texts[3]), docs[9], docs[9]]
    items = [(100 + i, " ".join(rng.choices(rng.choice(topics) + words, k=rng.randint(1, 30)))) for i in range(40)]
    return docs, items + [(900, None), (901, ""), (902, "nowhere"), (903, "WORD9, x"), (904, texts[0]), (None, "word9"), (904, texts[0])]


def test_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 16)
    docs, items = tables(random.Random(8))
    d = spark.createDataFrame([(*r, "a", 1) for r in docs], "doc_id long, text string, item string, score int").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    for k, letters in ((7, 10**6), (50, 700)):
        got = L.top_documents(d, i, k, letters).collect()
        assert Counter(tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in got) == brute(docs, items, k)
    assert L.top_documents(d.where("false"), i).count() == L.top_documents(d, i.where("false")).count() == 0


def test_query_and_sql(spark, tmp_path):
    docs, items = tables(random.Random(9))
    docs, items = list({i: (i, t) for i, t in docs if i is not None}.values()), list({i: (i, t) for i, t in items if i is not None}.values())
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute(docs, items, 50)
    assert Counter(tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in L.op12(spark, str(tmp_path)).collect()) == want
    base = duckdb.connect()
    for name in ("documents", "benchmark"):
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert Counter(base.execute(L.SQL).fetchall()) == want


@pytest.mark.parametrize("block", [4, 256])
def test_bounds_and_skipping(monkeypatch, block):
    """No document scores above a block that holds it, and a threshold leaves blocks out."""
    monkeypatch.setattr(L, "BLOCK", block)
    docs, items = tables(random.Random(10))
    batch = L.Batch.of(items)
    rows = [(i, t, Counter(batch.vocabulary[w.encode()] for w in terms(text) if w.encode() in batch.vocabulary)) for i, text in docs if (t := len(terms(text)))]
    rows = [(i, n, np.array(sorted(c), "u4"), np.array([c[t] for t in sorted(c)], "u4")) for i, n, c in rows if c]
    df = np.bincount(np.concatenate([r[2] for r in rows]), minlength=len(batch.vocabulary))
    corpus = L.Corpus(len(rows), sum(r[1] for r in rows), np.floor(1000 * np.log((2 * len(rows) + 2) / (2 * df + 1))).astype(np.int64))
    shard = L.Shard.unpack(L.Shard.build(*map(list, zip(*rows, strict=True)), corpus).pack())
    scored = []
    for own in batch.terms[:30]:
        weights = np.zeros(len(batch.vocabulary), np.int64)
        weights[own] = corpus.weights[own]
        every = shard.scores(np.arange(len(rows)), weights)
        bounds = shard.bounds(0, len(shard.block_ptr) - 1, weights)
        for b, bound in enumerate(bounds.tolist()):
            assert every[shard.block_docs[shard.block_ptr[b] : shard.block_ptr[b + 1]]].max() <= bound
        least = int(np.sort(every)[-10])
        found, scores = shard.search(own, weights, max(1, least))
        assert sorted(found.tolist()) == np.flatnonzero(every >= max(1, least)).tolist() and (scores == every[found]).all()
        held = np.concatenate([np.arange(shard.list_ptr[t], shard.list_ptr[t + 1]) for t in own])
        scored.append((bounds[held] >= max(1, least)).mean())
    assert block > 4 or np.mean(scored) < 0.5


def test_one_text_over_a_megabyte(spark):
    docs = [(1, "alpha " * 300_000), (2, "b" * 1_500_000), (3, "alpha beta"), (4, None)]
    items = [(1, "alpha"), (2, "b" * 1_500_000), (3, "beta " * 250_000)]
    got = L.top_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter(tuple(r) for r in got) == brute(docs, items, 50)
