import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from lexquarry.llm import packing as P


def brute_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(20))
def test_runs_give_the_bins_of_best_fit_piece_by_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 100])
    lengths = [rng.randint(1, rng.choice([capacity, max(1, capacity // 3)])) for _ in range(rng.randint(0, 300))]
    histogram = {n: lengths.count(n) for n in lengths}
    bins, seen = {}, {n: [] for n in histogram}
    for length, lo, hi, first, per, at in P.plan_bins(histogram, capacity):
        seen[length] += range(lo, hi)
        for i in range(hi - lo):
            bins.setdefault(first + i // per, []).append((at + i % per * length, length))
    assert all(sorted(r) == list(range(histogram[n])) for n, r in seen.items())
    for own in bins.values():
        end = 0
        for at, length in sorted(own):
            assert at == end
            end += length
        assert end <= capacity
    assert sorted(capacity - sum(n for _, n in own) for own in bins.values()) == brute_best_fit(lengths, capacity)


def test_ids_are_those_of_the_json_file():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(P.byte_bpe().json), P.Encoder(P.byte_bpe())
    rng = random.Random(3)
    alphabet = list("ab'sé1 \n\t\r!?.  ") + ["\xa0", "\x85", "\u3000", "\x1c", "日", "🎉", "l'll", "<|endoftext|>", "  \n", "'re", "\u0300", "½", "_", "\u200d"]
    texts = ["", " ", "a  b", " x", "x ", "\n\n a", "x" * 5000] + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(3000)]
    texts += [r["text"] or "" for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).to_pylist()]
    texts += [f"a{chr(i)}b {chr(i)} {chr(i)}{chr(i + 1)}1" for i in range(0x110000 - 1) if not 0xD7FF <= i <= 0xDFFF and (i < 0x3400 or i % 29 == 0)]
    texts += ["".join(rng.choices(own, k=60_000)) for own in ("a", "etaoin", "= ", "日本語", "\n")]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_cut():
    assert P.cut(b"\0" * 4, 4) == [(0, 1)]
    assert P.cut(b"\0" * 16, 4) == [(0, 4)]
    assert P.cut(b"\0" * 20, 4) == [(0, 1), (1, 4)]
    assert P.cut(b"\0" * 32, 4) == [(0, 4), (4, 4)]


def test_pack_documents(spark):
    rows = [(i, "word " * (i % 40), "x") for i in range(200)] + [(7, None, "y"), (7, None, "y"), (None, "", None), (900, "long text " * 3000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    out = P.pack_documents(docs, P.byte_bpe(), capacity=64).collect()
    assert {r["doc_id"] for r in out} == {r[0] for r in rows}
    places = {}
    for r in out:
        assert len(r["ids"]) == 4 * r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= 64
    long = sorted((r["piece"], r["start"], r["length"]) for r in out if r["doc_id"] == 900)
    assert all(n == 64 for _, _, n in long[1:]) and [s for _, s, _ in long][1:] == np.cumsum([n for _, _, n in long])[:-1].tolist()
    assert sum(r["doc_id"] == 7 for r in out) == 3
    assert P.pack_documents(docs.where("false"), P.byte_bpe()).count() == 0


def test_salted_ranks(spark, monkeypatch):
    monkeypatch.setattr(P, "RANK_GROUP", 10)
    out = P.pack(spark.range(500).selectExpr("id as doc_id", "0 as piece", "cast(10 as long) as length"), 40).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == 500
    assert len({r["sequence_id"] for r in out}) == 125
