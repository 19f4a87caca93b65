import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexquarry.llm import quality as Q


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    cover = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(cover)


def test_base_counts():
    rng = random.Random(4)
    bits = ["a", "b", "é", "🎉", "\n", "\n", "\t", "x|y", " ", "\x1c", "#", "b a b", "\r", "\x0b"]
    for text in ["", " ", "\n\n", "a b", "a a a a", *(" ".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(400)), *("".join(rng.choices(bits, k=30)) for _ in range(200))]:
        assert Q.base_counts(text) == brute_base(text), repr(text)


def brute_discounts(counts):
    n = [sum(c == i for c in counts) for i in range(1, 5)]
    if not all(n):
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.01), i) for i in (1, 2, 3))


def units(text):
    data = text.encode("utf-16-le")
    return [0xFFFF] * 3 + [int.from_bytes(data[i : i + 2], "little") for i in range(0, len(data), 2)]


def brute_kneser_ney(texts):
    """Probabilities by the textbook, of tuples of code units."""
    levels = {4: Counter(tuple(s[i : i + 4]) for s in map(units, texts) for i in range(len(s) - 3))}
    for o in range(3, 0, -1):
        levels[o] = Counter(g[1:] for g in levels[o + 1])
    params = {o: brute_discounts(list(c.values())) for o, c in levels.items()}
    by_context = {o: defaultdict(list) for o in levels}
    for o, c in levels.items():
        for g, n in c.items():
            by_context[o][g[:-1]].append(n)

    def prob(g):
        if not g:
            return 1 / len(levels[1])
        o, off = len(g), lambda n: params[len(g)][min(n, 3) - 1]
        own = by_context[o].get(g[:-1])
        if not own:
            return prob(g[1:])
        n = levels[o].get(g, 0)
        return ((n - off(n)) if n else 0) / sum(own) + sum(map(off, own)) / sum(own) * prob(g[1:])

    return prob, [g[0] for g in levels[1]]


def test_model(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("ab cdé.9#日🎉" if i % 2 else "αβγ δεAB", weights=None if i % 3 else range(1, 12 - 3 * (1 - i % 2)), k=rng.randint(0, 200))), "x" if i % 2 else "y") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["surprise"] for r in Q.judge(docs).collect()}
    for lang in "xy":
        texts = {i: t for i, t, own in rows if own == lang}
        prob, known = brute_kneser_ney(texts.values())
        for i, text in texts.items():
            s = units(text)
            logs = [math.log(prob(tuple(s[j : j + 4]))) for j in range(len(s) - 3)]
            assert got[i] is None if not text else got[i] == pytest.approx(-sum(logs) / len(logs), rel=1e-9)
        seen = tuple(units(max(texts.values(), key=len))[-3:])
        assert sum(prob((*seen, w)) for w in known) == pytest.approx(1)


def test_segments(monkeypatch):
    texts = ["", "a", "日本🎉", "x" * 500, "", "abc" * 40]
    want = [[int("".join(f"{u:04x}" for u in s[i : i + 4]), 16) for i in range(len(s) - 3)] for s in map(units, texts)]
    for chunk in (Q.CHUNK, 50, 7):
        monkeypatch.setattr(Q, "CHUNK", chunk)
        got = [[] for _ in texts]
        for owners, starts, keys in Q.segments(texts):
            for n, a, b in zip(owners, starts, [*starts[1:], len(keys)], strict=True):
                got[n] += keys[a:b].view(np.uint64).tolist()
        assert got == want


def test_judge(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=120)), "en" if i % 2 else None) for i in range(100)]
    rows += [(201, None, "en"), (202, "", None), (None, rows[0][1], "en"), rows[3], (203, "same words here " * 60, "en")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, kept int")
    out = Q.judge(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["kept"] == (r["doc_id"] not in (201, 202, 203)), r
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 102
    assert Q.judge(docs.where("false")).count() == 0


def test_band_rejects_junk(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=200)), "en") for i in range(300)]
    rows += [(1000 + n, " ".join(rng.choices(words, k=200 - n) + ["".join(rng.choices("zqxjkv", k=5)) for _ in range(n)]), "en") for n in range(10, 120, 4)]
    out = Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert not any(r["base_failed"] for r in out) and all(r["kept"] for r in out if r["doc_id"] < 1000)
    far = {}
    for measure in ("surprise", "word_surprise"):
        middle = np.median([r[measure] for r in out])
        deviation = 1.4826 * np.median([abs(r[measure] - middle) for r in out])
        for r in out:
            far[r["doc_id"]] = max(far.get(r["doc_id"], 0), (abs(r[measure] - middle) - Q.BAND_SLACK) / deviation)
    rejected = {r["doc_id"] for r in out if not r["kept"]}
    assert {i for i, x in far.items() if x > 5.3} <= rejected <= {i for i, x in far.items() if x > 4.7}
    assert any(5.3 < far[i] < 7.5 for i in rejected)


def test_bands_by_language(spark):
    """Random letters of a script that the others don't share go; each language keeps its own words."""
    rng = random.Random(9)
    scripts = {"el": "αβγδεζηθικλμνξοπρστυφχψω", "ru": "абвгдежзийклмнопрстуфхцчшщ", "en": "etaoinshrdlucmfwypvbgk"}
    rows = []
    for n, (lang, letters) in enumerate(scripts.items()):
        words = ["".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(200)]
        rows += [(1000 * n + i, " ".join(rng.choices(words, k=120)), lang) for i in range(150)]
        rows += [(1000 * n + 900 + i, " ".join("".join(rng.choices(letters, k=6)) for _ in range(120)), lang) for i in range(3)]
    out = {r["doc_id"]: r["kept"] for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {i for i, kept in out.items() if not kept} == {i for i in out if i % 1000 >= 900}
