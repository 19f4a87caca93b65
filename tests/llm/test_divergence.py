import random
import re
from collections import Counter

import duckdb
import numpy as np

from lexquarry.llm import divergence as D


def brute(rows):
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = set()
    for lang in {w[0] for w in words}:
        df = Counter(t for x, _, w in words if x == lang for t in set(w))
        kept = sorted(t for t, n in df.items() if n >= 10)
        count = {s: Counter(t for x, y, w in words if (x, y) == (lang, s) for t in w) for s in {w[1] for w in words if w[0] == lang}}
        whole = Counter(t for x, _, w in words if x == lang for t in w)

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return [1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept]

        p, q = {s: shares(c) for s, c in count.items()}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pair = [(-sum(map(f, p[s], p[o])), o.encode()) for o in p if o != s]
            term = [(-f(a, b), t.encode()) for t, a, b in zip(kept, p[s], q, strict=True) if count[s][t] and a > b]
            out |= {(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(sorted(pair), 1)}
            out |= {(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(sorted(term)[:10], 1)}
    return out


def table(rng):
    words = ["".join(rng.choices("abcdeABé", k=rng.randint(1, 3))) for _ in range(80)] + ["ж", "Ж"]
    rows = [(rng.choice(["en", "en", "de", None]), f"s{rng.choice([0, 0, 0, *range(9)])}" if rng.random() < 0.9 else None, rng.choice(["_", " ", "9", "\n"]).join(rng.choices(words, k=rng.randint(0, 60)))) for _ in range(300)]
    return rows + [("en", "none", None), ("en", "digits", "1 2 3"), ("xx", "a", "rare"), ("xx", "b", ""), ("yy", "alone", "words"), *[("zz", "a", "same same")] * 12, ("zz", "b", "same"), ("zz", "c", "same")]


def test_against_brute_force(spark, tmp_path):
    rows = table(random.Random(6))
    want = brute(rows)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string").repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for sizes in ({}, {"groups": 2, "terms": 7}, {"groups": 1, "terms": 1000}):
        got = D.audit(docs.withColumn("n", docs["doc_id"]), **sizes).collect()
        assert {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got} == want and len(got) == len(want)
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert set(base.execute(D.SQL).fetchall()) == want
    assert D.audit(docs.where("false")).count() == 0


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(2000):
        whole = rng.randrange(2, 10 ** rng.randint(1, 15) + 2)
        n = rng.randrange(0, max(1, whole - 2))
        assert D.share(np.array([n]), whole)[0] == 1 + 10**9 * (n + 2) // whole


def test_one_text_over_a_megabyte(spark):
    rows = [("en", "a", "word " * 400_000), ("en", "b", "x" * 1_500_000), *[("en", "b", "word other")] * 10]
    got = D.audit(spark.createDataFrame(rows, "lang string, source string, text string")).collect()
    assert {tuple(r) for r in got} == brute(rows)
