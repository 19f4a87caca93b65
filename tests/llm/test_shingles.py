import random

import numpy as np
from pyspark.sql import functions as F

from lexquarry.llm import shingles as S
from lexquarry.llm.simhash import components as components_of
from lexquarry.llm.simhash import voted


def brute(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(texts):
    own, parent = [brute(t or "") for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(own):
        for j, b in enumerate(own[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_sets():
    for text in ["", " \n", "One", "one TWO three", "a b c d e", "a b c d e a b c d e a", "x " * 40]:
        assert len(S.shingles(text)) == len(brute(text)), text
    assert (S.shingles("One\ttwo THREE") == S.shingles("one two three")).all()


def test_keep_one_catches_what_fingerprints_miss(spark, monkeypatch):
    monkeypatch.setattr(S, "PIVOTS", 2)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage, texts = rng.choices(vocabulary, k=120), []
    for i in range(30):
        words = rng.choices(vocabulary, k=rng.randint(40, 300))
        words = passage + words if i % 3 == 0 else words
        for _ in range(rng.randint(1, 6)):  # a chain of edits: each near the one before, not always the first
            texts.append(" ".join(words))
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    texts += [texts[3], "", None, "few words here", "Few words  here"]
    rng.shuffle(texts)
    rows = [(1000 - i, t, "s") for i, t in enumerate(texts)]
    rows += [(None, texts[0], "s"), rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    groups = {}
    for row, root in zip(rows, components([t for _, t, _ in rows]), strict=True):
        groups.setdefault(root, []).append(row[0] if row[0] is not None else 10**9)
    out = S.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(map(min, groups.values()))
    assert len(groups) < len(set(texts)) - 20
    assert S.keep_one(docs.where("false")).count() == 0
    assert S.keep_one(spark.createDataFrame([(1, "alone", "s"), (2, "apart", "s")], docs.schema)).count() == 2


def edited(rng, n):
    """Texts, each a word or two from another one, among others that are not."""
    vocabulary = [f"w{i}" for i in range(2000)]
    out = []
    for _ in range(n):
        words = rng.choices(vocabulary, k=rng.randint(150, 400))
        for _ in range(rng.randint(1, 4)):
            out.append(" ".join(words))
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
    return out


def test_the_index_gives_candidates(spark):
    """Sets whose fingerprints are within the radius have a key in common, and near ones are linked without any band."""
    texts = edited(random.Random(3), 25)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), S.sketches(F.col("text")).alias("s")).select("doc_id", "text_hash", "s.*").cache()
    rows = {r["doc_id"]: r for r in own.collect()}
    close = {(i, j) for i in rows for j in rows if i < j and ((rows[i]["fp"] ^ rows[j]["fp"]) % 2**64).bit_count() <= 2}
    keys = {}
    for r in S.index_keys(own).collect():
        keys.setdefault(r["d"], set()).add(r["key"])
    assert close and all(keys[rows[i]["d"]] & keys[rows[j]["d"]] for i, j in close)
    bare = own.withColumn("keys", F.array("d"))
    found = {(r["a"], r["b"]) for r in S.links(bare, docs).collect()}
    root = {r["node"]: r["root"] for r in components_of(spark.createDataFrame(sorted(found), "a long, b long")).collect()}
    sets = [brute(t) for t in texts]
    near = {(i, j) for i, j in close if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    at = lambda i: root.get(rows[i]["d"], rows[i]["d"])
    assert near and all(at(i) == at(j) for i, j in near)


def test_fingerprints_are_by_majority():
    words = np.array([0b0011, 0b0001, 0b1001], np.uint64)
    assert voted(iter([words[:2], words[2:]])) == 0b0001
    assert S.fingerprint(S.hashes("b a c a")[0]) == S.fingerprint(S.hashes("c  A b b")[0])
    assert int(S.fingerprint(words)) == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in S.mixed(words + S.SEED)) > 3)
