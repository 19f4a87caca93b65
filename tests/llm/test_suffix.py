import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.llm import suffix as S


@pytest.mark.parametrize("seed", range(30))
def test_suffix_array(seed):
    rng = random.Random(seed)
    n, sigma = rng.choice([0, 1, 2, 10, 300, 2000]), rng.choice([1, 2, 3, 200])
    body = [rng.randint(1, sigma) for _ in range(n)]
    if rng.random() < 0.5:
        body = (body[: max(1, n // 7)] * 8)[:n]
    s = np.array([*body, 0], np.int16)
    sa = S.suffix_array(s)
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    plcp = S.common_prefixes(s, sa, 20)
    for a, b in zip(sa[:-1], sa[1:]):
        n = 0
        while n < 20 and max(a, b) + n < len(s) and s[a + n] == s[b + n]:
            n += 1
        assert plcp[b] == n


def test_anchors_cover_every_window(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 100, n).astype(np.uint8) for n in (0, 49, 50, 51, 400, 0, 3000, 17)]
    data, ends = np.concatenate(texts), np.cumsum([len(t) for t in texts])
    windows = {(int(e) - len(t) + i) for t, e in zip(texts, ends, strict=True) for i in range(len(t) - 49)}
    by_string = {}
    for piece in (S.PIECE, 100):
        monkeypatch.setattr(S, "PIECE", piece)
        seen = set()
        parts = [(f.start, f.size, f.place, f.hash, f.owner) for f in S.anchors(data, ends)]
        for start, size, place, h, owner in zip(*(np.concatenate(x).tolist() for x in zip(*parts, strict=True)), strict=True):
            for w in range(start, start + size - 49):
                assert w not in seen and ends[owner] - len(texts[owner]) <= w <= ends[owner] - 50
                assert w <= place <= w + 50 - S.SEED
                seen.add(w)
                assert by_string.setdefault(data[w : w + 50].tobytes(), (place - w, h)) == (place - w, h)
        assert seen == windows


def brute(rows, length):
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        if i is not None:
            for p in range(len(data) - length + 1):
                w = data[p : p + length]
                first[w] = min(i, first.get(w, i))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if i is not None and first[data[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(rng):
    words = "the of and to in is été 🎉 a-b, long-ish word. another \n".split(" ")
    make = lambda n: " ".join(rng.choices(words, k=n))
    passages = [make(30) for _ in range(4)] + ["x" * 90, "ab" * 60]
    rows = []
    for i in range(60):
        text = make(rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            text += p[a : a + rng.randint(30, 200)] + make(rng.randint(0, 20))
        rows.append((rng.randrange(1000) * 100 + i, text))
    rows += [(i + 7, t) for i, t in rng.sample(rows, 8)]
    return rows + [(1, None), (2, ""), (None, passages[0]), (None, None), rows[0], (3, passages[1][:49]), (4, "z" * 20000), (5, "z" * 49 + "\0" + "z" * 60)]


@pytest.mark.parametrize("salt_texts", [20_000, 2])
def test_against_brute_force(spark, monkeypatch, salt_texts):
    monkeypatch.setattr(S, "SALT_TEXTS", salt_texts)
    monkeypatch.setattr(S, "GROUP_BYTES", 3000)
    monkeypatch.setattr(S, "BUCKET_TEXT", 5000)
    monkeypatch.setattr(S, "SHARD_BYTES", 20_000)
    rows = corpus(random.Random(11))
    rows += [(50, rows[5][1]), (50, rows[9][1] + rows[5][1]), (50, "nothing in common with the others, whatever they are " * 2)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, id int")
    told = S.shared_anchors(docs.where("text is not null").selectExpr("text", "xxhash64(text) AS t1"), 3)
    assert (told.where("salts > 0").count() > 20) == (salt_texts == 2)
    out = S.remove_repeats(docs)
    got = sorted(((r["doc_id"], r["cut"]["n_bytes"], r["cut"]["n_removed"], r["cut"]["n_spans"], hashlib.sha256(r["cut"]["kept"]).hexdigest()) for r in out.collect()), key=repr)
    want = brute(rows, 50)
    assert got == want
    assert sum(w[2] for w in want) > 1000


def test_equal_first_hashes(spark, monkeypatch):
    second = S.text_key
    monkeypatch.setattr(S, "text_key", lambda text: [F.pmod(F.xxhash64(text), F.lit(3)).alias("t1"), second(text)[1]])
    rows = list({i: (i, t) for i, t in corpus(random.Random(4)) if i is not None}.values())
    out = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r["doc_id"], r["cut"]["n_bytes"], r["cut"]["n_removed"], r["cut"]["n_spans"], hashlib.sha256(r["cut"]["kept"]).hexdigest()) for r in out.collect()), key=repr)
    assert got == brute(rows, 50)


@pytest.mark.parametrize("salt_texts", [20_000, 1])
def test_texts_that_repeat_themselves(spark, monkeypatch, salt_texts):
    monkeypatch.setattr(S, "SALT_TEXTS", salt_texts)
    monkeypatch.setattr(S, "PIECE", 300)
    rng, rows = random.Random(8), []
    for period in (1, 2, 3, 17, 40, 49, 50, 51, 60, 120):
        unit = "".join(rng.choices("abcdefgh", k=period))
        for n in (900, 400, 55):
            at = rng.randrange(period)
            rows.append((len(rows), "".join(rng.choices("XY", k=rng.randint(0, 60))) + (unit * n)[at : at + n] + rng.choice(["", "end", "".join(rng.choices("XYZ", k=80))])))
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    out = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r["doc_id"], r["cut"]["n_bytes"], r["cut"]["n_removed"], r["cut"]["n_spans"], hashlib.sha256(r["cut"]["kept"]).hexdigest()) for r in out.collect()), key=repr)
    assert got == brute(rows, 50)


def test_a_long_run_has_few_contexts():
    data = np.full(1_000_000, 120, np.uint8)
    for f in S.anchors(data, np.array([len(data)])):
        one, reach = S.repeated(data, f, 50)
        assert len(one) <= 2 and len(S.once(f)) <= 2 and int(reach.sum()) + len(one) == len(f.start)


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
