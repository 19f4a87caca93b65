import random

import pytest
from tokenizers import Tokenizer, models

from lexquarry.llm import tokencount as T


def brute(word, starting, inside):
    at, n = 0, 0
    while at < len(word):
        own = starting if at == 0 else inside
        end = next((e for e in range(len(word), at, -1) if word[at:e] in own), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


@pytest.mark.parametrize("seed", range(20))
def test_automaton(seed):
    rng = random.Random(seed)
    make = lambda: "".join(rng.choices("abc", k=rng.randint(1, 5)))
    starting, inside = {make() for _ in range(rng.randint(0, 20))}, {make() for _ in range(rng.randint(0, 20))}
    if seed % 2:
        starting |= set("abc")
        inside |= set("abc")
    a = T.Automaton.build(starting, inside)
    for _ in range(300):
        word = "".join(rng.choices("abcd" if rng.random() < 0.1 else "abc", k=rng.randint(1, 25)))
        assert a.count(word) == brute(word, starting, inside), (word, starting, inside)


def test_real_vocabulary_against_a_public_library():
    import public_tokenizers

    pieces = T.piece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    starting, inside = T.from_pieces(pieces)
    vocabulary = {"[UNK]": 0}
    for p in [*sorted(starting), *("##" + x for x in sorted(inside))]:
        vocabulary.setdefault(p, len(vocabulary))
    other = Tokenizer(models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=10_000))
    a, rng = T.Automaton.build(starting, inside), random.Random(9)
    some = sorted(starting)
    for _ in range(1500):
        word = "".join(rng.choices(some, k=rng.randint(1, 6))) + rng.choice(["", "é", "日本", ",", "🎉", "\x01"])
        if "##" not in word:
            assert (a.count(word) or 1) == len(other.model.tokenize(word)), word
    assert a.count("a" * 9_000) == len(other.model.tokenize("a" * 9_000))


def test_count_tokens(spark):
    rows = [(1, "ab abc  x\n", 1), (2, None, 1), (3, "", 1), (None, "ab", 1), (1, "ab abc  x\n", 1), (4, "abc" * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = sorted((tuple(r) for r in T.count_tokens(docs, ["▁ab", "c", "ab"]).collect()), key=repr)
    assert out == sorted([(1, 3, 4, 1), (2, 0, 0, 0), (3, 0, 0, 0), (None, 1, 1, 0), (1, 3, 4, 1), (4, 1, 100_000, 0)], key=repr)
    assert T.count_tokens(docs.where("false"), ["▁a"]).count() == 0
