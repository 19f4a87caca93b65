import random

import numpy as np
import pytest
import xxhash

from lexquarry.llm import simhash as S


def brute_components(codes, radius):
    parent = list(range(len(codes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(codes))]


def classes(labels):
    out = {}
    for i, x in enumerate(labels):
        out.setdefault(x, []).append(i)
    return sorted(out.values())


def near_codes(rng, n):
    base = [rng.getrandbits(64) for _ in range(5)]
    out = set()
    while len(out) < n:
        c = rng.choice(base)
        for _ in range(rng.randint(0, 8)):
            c ^= 1 << rng.randrange(64)
        out.add(c)
    return rng.sample(sorted(out), n)


def united(n, edges, codes):
    at = {c: i for i, c in enumerate(codes)}
    labels = list(range(n))
    for a, b in edges:
        x, y = labels[at[a]], labels[at[b]]
        labels = [min(x, y) if z in (x, y) else z for z in labels]
    return classes(labels)


@pytest.mark.parametrize("seed", range(12))
def test_shards_have_the_links_of_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(S, "FRONTIER", rng.choice([100, 10_000, 1_000_000]))
    codes = near_codes(rng, rng.choice([2, 3, 16, 17, 300]))
    shard = S.Shard(np.array(codes, np.uint64))
    own = list(zip(*(x.tolist() for x in shard.forest()), strict=True))
    assert united(len(codes), own, codes) == classes(brute_components(codes, 2)) and len(own) < len(codes)
    new = [c for c in near_codes(rng, 40) + [c ^ 5 for c in codes[:9]] if c not in codes]
    new = list(dict.fromkeys(new))
    met = list(zip(*(x.tolist() for x in shard.visit(np.array(new, np.uint64))), strict=True))
    for c in new:
        near = [x for x in codes if (x ^ c).bit_count() <= 2]
        label = dict(zip(shard.codes.tolist(), shard.labels.tolist(), strict=True))
        assert sorted(label[b] for a, b in met if a == c) == sorted({label[x] for x in near})


def test_upper_nodes_let_nothing_through_that_is_far_and_nothing_near_out():
    rng = random.Random(2)
    codes = np.array(sorted(near_codes(rng, 2000), key=lambda c: S.gray_rank(np.array([c], np.uint64))[0]), np.uint64)
    parts = np.split(codes, 100)
    whole, some = (np.array([f.reduce(p) for p in parts]) for f in (np.bitwise_and, np.bitwise_or))
    upper = S.GrayIndex(whole, ~(whole ^ some))
    q, node, _ = upper.search(codes, 2)
    got = set(zip(q.tolist(), upper.order[node].tolist(), strict=True))
    assert got == {(i, j) for i, c in enumerate(codes) for j in range(100) if int((c ^ whole[j]) & ~(whole[j] ^ some[j])).bit_count() <= 2}
    assert all((i, j) in got for i, c in enumerate(codes) for j in range(100) if any(int(c ^ x).bit_count() <= 2 for x in parts[j]))
    assert len(got) < len(codes) * 50


@pytest.mark.parametrize("shard", [1, 40, 100_000])
def test_links_over_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(S, "SHARD", shard)
    codes = near_codes(random.Random(shard), 120 if shard == 1 else 400)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    got = S.links(spark.createDataFrame([(c,) for c in signed], "fp long")).collect()
    assert united(len(codes), [(r["a"] % 2**64, r["b"] % 2**64) for r in got], codes) == classes(brute_components(codes, 2))


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint(monkeypatch):
    monkeypatch.setattr(S, "SHINGLE_CHUNK", 7)
    for text in ["", " \n", "One", "One two", "One Two THREE", "É a\tb a b a b\nÉ", "a b " * 40, "x y z w " * 9]:
        assert S.fingerprint(text) == brute_fingerprint(text)


def test_near_duplicates(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choices("alpha beta gamma delta eps zeta eta theta".split(), k=300)) for _ in range(6)]
    rows = []
    for i in range(150):
        words = rng.choice(base).split()
        if rng.random() < 0.7:
            words[rng.randrange(len(words))] = "edit"
        rows.append((1000 - i, " ".join(words), "s", 1))
    rows += [(3, None, "s", 1), (2, "", None, 1), (None, "alone in here", "s", 1), (None, "", "s", 1), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, _lead int")
    codes = [brute_fingerprint(t or "") for _, t, _, _ in rows]
    comp = brute_components(codes, 2)
    least = {c: min((r[0] for r, x in zip(rows, comp) if x == c and r[0] is not None), default=None) for c in comp}
    got = sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in S.near_duplicates(docs).collect()), key=repr)
    assert got == sorted(((r[0], f, least[c]) for r, f, c in zip(rows, codes, comp)), key=repr)
    kept = S.keep_one(docs, words=3)
    assert kept.columns == docs.columns and kept.count() == len(set(comp))
    assert S.near_duplicates(docs.where("false")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("(id * 7) % 301 as a", "((id + 1) * 7) % 301 as b")
    assert {r["root"] for r in S.components(edges).collect()} == {0}
