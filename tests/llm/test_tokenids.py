import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexquarry.llm import tokenids as T

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("n", [1, 63, 1024, 1025, 5000, 300_000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49_408, n), np.full(n, 7), rng.integers(0, 2**32, n), np.where(rng.random(n) < 0.02, 2**32 - 1, rng.integers(900, 1000, n)), np.minimum(rng.zipf(1.3, n), 2**31)):
        ids = ids.astype("<u4")
        blocks = T.pack_blocks(ids)
        data, starts = b"".join(blocks), np.cumsum([0, *map(len, blocks)])[:-1]
        assert (T.unpack_blocks(data, starts)[:n] == ids).all()
    few = np.where(np.arange(2048) % 100 == 0, 40_000, 5).astype("<u4")
    assert sum(map(len, T.pack_blocks(few))) < 200  # outliers are exceptions, not a wider block


def test_ids_are_those_of_whole_texts(spark):
    plain, words = Tokenizer.from_file(PATH), T.WordEncoder(PATH)
    rng = random.Random(3)
    alphabet = [*"abzABZ019 .,;:!?'\"<|>#-_\n\t\x0b\x1c\x85\xa0 ", "é", "É", "é", "İ", "İ", "ſ", "Σ", "ß", "中", "👍🏽", "̸", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "J\u030c", "H\u0331", "½", "ﬁ", "‍", "한", "ᄒ", "ᅡ"]
    odd = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(20_000)]
    odd += [c + mark + " " + mark + c for c in map(chr, [*range(1, 0x600), *range(0x1E00, 0x2100)]) for mark in "a.'5"]
    odd += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.coalesce("text", F.lit("")).alias("text")).collect()]
    got = words.encode([t.encode() for t in odd])
    for text, ids in zip(odd, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain_ids(plain, text)[:-1], text


@pytest.mark.parametrize("unit", [" ", "\n", "　", "a b ", "x", ".", "a.", "9"])
def test_long_runs(unit):
    text = unit * (1_000_000 // len(unit.encode()))
    got = np.frombuffer(T.WordEncoder(PATH).encode([text.encode()])[0], "<u4")
    short = unit * 3000
    assert np.frombuffer(T.WordEncoder(PATH).encode([short.encode()])[0], "<u4").tolist() == plain_ids(Tokenizer.from_file(PATH), short)[:-1]
    assert unit in " \n　" or len(got)


def test_files_and_query(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 3, 50, 700]))) for _ in range(150)] + [None, "", "Long. " * 30_000]
    rows = [(i * 7 - 100, t) for i, t in enumerate(texts)] + [(None, "none"), (33, "same"), (33, "same"), (33, "other")]
    rng.shuffle(rows)
    plain = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, first string, tie int").repartition(5)
    manifest = T.write_ids(docs, PATH, folder=f"file://{tmp_path}/ids", file_ids=5000)
    assert manifest.count() > 5
    got = sorted(T.read_ids(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(i), np.array(plain_ids(plain, t), "<u4").tobytes()) for i, t in rows)
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]) // 4)
        at += r["n_tokens"]
    whole = np.frombuffer(b"".join(r["ids"] for r in got), "<u4")
    for m in manifest.collect():  # any span of a file by its block index
        for _ in range(5):
            start, n = rng.randrange(m["n_ids"]), rng.randrange(3000)
            assert (T.FileReader(m["file"]).ids(start, n) == whole[m["first"] + start :][: min(n, m["n_ids"] - start)]).all()
    assert T.read_ids(T.write_ids(docs.where("false"), PATH)).count() == 0
    stored = f"{tmp_path}/tables"
    spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string").write.parquet(f"{stored}/documents.parquet")
    out = sorted(T.op11(spark, stored).collect(), key=lambda r: r["start"])
    want = {(i, len(ids := plain_ids(plain, t)), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in rows if i is not None}
    assert {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out} == want and [r["doc_id"] for r in out] == sorted(r["doc_id"] for r in out)


def test_a_broken_file_is_told(tmp_path):
    path = str(tmp_path / "a.ids")
    writer = T.FileWriter(open(path, "wb"))
    writer.add(5, np.arange(3000, dtype="<u4").tobytes())
    writer.close()
    data = bytearray((tmp_path / "a.ids").read_bytes())
    assert T.FileReader(path).ids(1000, 100).tolist() == list(range(1000, 1100))
    data[-30] ^= 1
    (tmp_path / "a.ids").write_bytes(data)
    with pytest.raises(ValueError):
        T.FileReader(path)


def test_words_in_use_are_asked_for_once(monkeypatch):
    monkeypatch.setattr(T, "CACHED", 50)
    words, plain, asked = T.WordEncoder(PATH), Tokenizer.from_file(PATH), []
    learn = words.learn
    monkeypatch.setattr(words, "learn", lambda new: (asked.extend(new), learn(new)))
    for i in range(40):
        text = "the law, of " + " ".join(f"x{chr(97 + i % 26)}{chr(97 + j)}{'z' * (i // 26)}" for j in range(20))
        assert np.frombuffer(words.encode([text.encode()])[0], "<u4").tolist() == plain_ids(plain, text)[:-1]
    assert len(words.known) + len(words.before) <= 2 * 50
    assert asked.count(b"the") == asked.count(b"law") == asked.count(b",") == 1


def test_marks_after_letters_are_words_of_their_own():
    words, plain = T.WordEncoder(PATH), Tokenizer.from_file(PATH)
    assert words.split("Anvition&&& doqueó, 7.%%% (É) a×, b÷* «x».".encode()) == "anvition &&& doqueó , 7 .%%% (É ) a×, b÷* «x».".encode().split()
    rng = random.Random(9)
    for _ in range(20_000):
        text = "".join(rng.choices([*"aZé7ÉßÿªºÞ×÷«»½²' \n", *".,;:!?#$%&*)", "...", "'s", "µ", "Ā", "中"], k=rng.randint(0, 30)))
        assert np.frombuffer(words.encode([text.encode()])[0], "<u4").tolist() == plain_ids(plain, text)[:-1], text
