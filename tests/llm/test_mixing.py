import math
import random

import pytest

from lexquarry.llm import mixing as M


def docs_of(spark, rng, sizes):
    rows = [(i, f"s{k}", rng.randint(1, 9)) for k, n in enumerate(sizes) for i in range(k * 100_000, k * 100_000 + n)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, tokens long").selectExpr("doc_id", "'' as copy", "source", "tokens")


def entropy(p):
    return -sum(x * math.log(x) for x in p if x)


@pytest.mark.parametrize("mix", [M.Mix(), M.Mix(entropy_lift=1.0, max_epochs=3), M.Mix(entropy_lift=0.0), M.Mix(budget=0.3, block_tokens=100), M.Mix(budget=2.5, max_epochs=2)])
def test_mix(spark, monkeypatch, mix):
    monkeypatch.setattr(M, "GROUP_DOCS", 16)
    rows, sized = docs_of(spark, random.Random(1), [300, 90, 20, 4])
    tokens = {}
    for _, s, n in rows:
        tokens[s] = tokens.get(s, 0) + n
    total = sum(tokens.values())
    plan = {r["source"]: r for r in M.plan(sized, mix).collect()}
    w = {s: r["weight"] for s, r in plan.items()}
    assert sum(w.values()) == pytest.approx(1)
    natural = entropy([t / total for t in tokens.values()])
    target = natural + mix.entropy_lift * (math.log(4) - natural)
    epochs = max(w[s] * mix.budget * total / tokens[s] for s in w)
    if mix.budget > mix.max_epochs:
        assert w == pytest.approx({s: t / total for s, t in tokens.items()})
    elif epochs < mix.max_epochs - 1e-6:
        assert entropy(w.values()) == pytest.approx(target, abs=1e-6)
    else:
        assert epochs == pytest.approx(mix.max_epochs, rel=1e-6) and entropy(w.values()) <= target
    out = M.mix_rows(sized, mix).collect()
    assert len({(r["doc_id"], r["epoch"]) for r in out}) == len(out)
    size = {i: n for i, _, n in rows}
    for s, r in plan.items():
        own = sorted((x["start"], x["doc_id"], x["block"]) for x in out if x["source"] == s)
        end = 0
        for start, doc, block in own:
            assert start == end and block == start * r["blocks"] // r["quota"]
            end += size[doc]
        assert end >= r["quota"] > own[-1][0]


def test_remix(spark):
    rows = [(i, "a b c " * (i % 5), "big" if i % 4 else "small", "e", i) for i in range(80)]
    rows += [(None, None, None, None, None), (5, rows[5][1], "big", "e", 5), (6, "another text", None, "e", 6), rows[4], rows[4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, times string, copy int")
    out = M.remix(docs, M.Mix(entropy_lift=0.9))
    assert out.columns == docs.columns
    want = M.mix_rows(M.sized(docs), M.Mix(entropy_lift=0.9)).groupBy("doc_id").count().collect()
    got = out.selectExpr("coalesce(doc_id, 0) as doc_id").groupBy("doc_id").count().collect()
    assert sorted(got) == sorted(want)
    assert M.remix(docs.where("false")).count() == 0


def test_remix_lays_out_blocks(spark):
    """Blocks come out whole, each in the order of its permutation."""
    rows = [(i, "w " * (i % 7 + 1), "big" if i % 4 else "small") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = M.Mix(entropy_lift=0.9, block_tokens=60)
    blocks = {}
    for r in sorted(M.mix_rows(M.sized(docs), mix).collect(), key=lambda r: (r["block"], r["place"])):
        blocks.setdefault(r["block"], []).append(r["doc_id"])
    assert len(blocks) > 10
    got = [r["doc_id"] for r in M.remix(docs, mix).collect()]
    assert len(got) == sum(map(len, blocks.values()))
    left, at = list(blocks.values()), 0
    while left:
        own = next(b for b in left if got[at : at + len(b)] == b)
        left.remove(own)
        at += len(own)
