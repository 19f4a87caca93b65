"""The queries themselves, columns and digests as their contracts have them, against plain Python on a small table."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from lexquarry.llm import packing, quality, secrets, simhash, suffix


def documents():
    rng = random.Random(12)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(250)] + ["É#", "a|b", "🎉"]
    passage = " ".join(rng.choices(words, k=40))
    texts = [" ".join(rng.choices(words, k=rng.choice([5, 60, 120, 400]))) for _ in range(40)]
    texts += [texts[1], passage + " " + texts[2], texts[3] + "\n" + passage, "same words here " * 60, "", None, " ", "x" * 120]
    texts += [f"api_key = 'A1b2C3d4E5f6' and AKIA{'Q7' * 9} {'0f' * 13}", texts[1] + "\n" + texts[1]]
    return [(1000 - 3 * i, t, rng.choice(["en", "de", None]), f"s{i % 3}") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path, rows = str(tmp_path_factory.mktemp("tables")), documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return path, {i: t or "" for i, t, *_ in rows}


def test_op2(spark, stored):
    path, texts = stored
    plain, want = Tokenizer.from_file(packing.byte_bpe().json), {}
    for i, t in texts.items():
        ids = [*plain.encode(t, add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        for n, (a, b) in enumerate(zip([0, *range(first, len(ids), 1024)], [first, *range(first + 1024, len(ids) + 1, 1024)], strict=True)):
            want[i, n] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    out = packing.op2(spark, path).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out} == want and len(out) == len(want)
    ends = Counter()
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 1024


def test_op7(spark, stored):
    path, texts = stored
    for r in quality.op7(spark, path).collect():
        text = texts[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        cover = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        base = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(cover))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_op8(spark, stored):
    path, texts = stored
    kinds = {"assign": (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), "access": (r"(AKIA[A-Z0-9]+)", 20), "hex": (r"([0-9a-f]+)", 24)}
    for r in secrets.op8(spark, path).collect():
        found = sorted((m.start(), n, k, m.end()) for n, (k, (p, least)) in enumerate(kinds.items()) for m in re.finditer(p, texts[r["doc_id"]]) if len(m[1]) >= least)
        told = ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(f[2] == k for f in found) for k in kinds)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("owned")] == [s for s in told.split(",") if s]


def test_op9(spark, stored):
    path, texts = stored
    prints = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        grams = [" ".join(words[j : j + 3]) for j in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    group, left = {}, set(prints)
    while left:
        own, new = set(), {min(left)}
        while new:
            own |= new
            new = {j for j in left - own if any((prints[i] ^ prints[j]).bit_count() <= 2 for i in new)}
        group |= {i: min(own) for i in own}
        left -= own
    assert {tuple(r) for r in simhash.op9(spark, path).select("doc_id", "fingerprint", "component_id").collect()} == {(i, f"{p:016x}", group[i]) for i, p in prints.items()}


def test_op10(spark, stored):
    path, texts = stored
    data = {i: t.encode() for i, t in texts.items()}
    first = {}
    for i in sorted(data):
        for p in range(len(data[i]) - 49):
            first.setdefault(data[i][p : p + 50], i)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.op10(spark, path).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    for i, d in data.items():
        gone = bytearray(len(d))
        for p in range(len(d) - 49):
            if first[d[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        runs = sum(bool(g) and not (j and gone[j - 1]) for j, g in enumerate(gone))
        assert got.pop(i) == (len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    assert not got
