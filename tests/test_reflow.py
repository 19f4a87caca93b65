"""Blocks, measures and normal forms on long and odd texts, against plain folds and the plain patterns."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lexquarry.functions import patterns as P
from lexquarry.functions import quality as Q
from lexquarry.functions import text as T
from lexquarry.operators import corpus as C

HEADING = re.compile(rf"(?iu)^\s*(?:{P.HEADINGS})\b")


def heading(text):
    letters = re.findall(f"[{P.LATIN}]", text)
    return bool(HEADING.search(text)) or len(text.split()) <= 8 and len(letters) >= 8 and 5 * len([c for c in letters if re.match("[A-ZÀ-ÖØ-Þ]", c)]) >= 4 * len(letters)


def fold(lines):
    """The blocks of an island, line by line."""
    out, now = [], ""
    for line in lines:
        if now and heading(now):
            out.append(now)
            now = line
        elif not now:
            now = line
        elif now.endswith("-") and line[0].islower():
            now = now[:-1] + line
        else:
            now += line if now.endswith("'") else " " + line
    return [*out, now]


def built(spark, islands):
    """Blocks of documents, each of one island."""
    rows = [(i, n, line, None) for i, lines in enumerate(islands) for n, line in enumerate(lines, 1)]
    out = C.blocks(spark.createDataFrame(rows, "doc_id long, line_no long, line string, reason string").repartition(7)).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["block_idx"])):
        got.setdefault(r["doc_id"], []).append(r["block"])
    return [got[i] for i in range(len(islands))]


def test_blocks_equal_the_fold(spark):
    rng = random.Random(2)
    parts = ["LE", "CODE", "GRANDE PHRASE ENTIERE", "un", "deux mots", "des mots en nombre assez grand pour finir la", "PREMIERE", "PARTIE", "coupé-", "suite", "l'", "d'", "Été", "éte-", "LIV", "MOT-", "A", "b-", "ABCDEFGH", "TITRE"]
    islands = [[rng.choice(parts) for _ in range(rng.choice([1, 2, 5, 12, 40]))] for _ in range(600)]
    # A line that opens a block begins an island: here it only may stand first.
    islands = [[lines[0], *(x for x in lines[1:] if not HEADING.search(x))] for lines in islands]
    assert built(spark, islands) == [fold(x) for x in islands]


@pytest.mark.parametrize("line", ["des mots qui se suivent", "UN TITRE EN CAPITALES", "coupé-", "a"])
def test_a_million_lines_without_a_blank(spark, line):
    n, began = 1_000_000, time.time()
    rows = spark.range(1, n + 1, numPartitions=4).select(F.lit(1).alias("doc_id"), F.col("id").alias("line_no"), F.lit(line).alias("line"), F.lit(None).cast("string").alias("reason"))
    got = C.blocks(rows).agg(F.count("*").alias("n"), F.sum(F.length("block")).alias("size")).first()
    assert time.time() - began < 120
    want = fold([line] * 40)
    assert got["n"] == (n if len(want) > 1 else 1)
    assert got["size"] == (n * len(line) if len(want) > 1 else len(want[0]) + (n - 40) * (len(fold([line] * 41)[0]) - len(want[0])))


@pytest.mark.parametrize("unit", [" ", "　", "a b ", "x", "\t", "- ", "a' ", "( "])
def test_long_runs_take_linear_time(spark, unit):
    text = unit * (1_000_000 // len(unit))
    df = spark.createDataFrame([(text,)], "t string")
    began = time.time()
    row = df.select(T.normalize_typography(F.col("t")).alias("line"), T.canonical(F.col("t")).alias("same"), Q.ocr_quality(F.col("t")).alias("q"), T.starts_block(F.col("t")).alias("s")).first()
    assert time.time() - began < 40
    if unit == "a b ":
        assert row["q"]["reasons"] == ["high_single_char_token_ratio"]  # one cluster, however long
    if not unit.strip():
        assert row["line"] == row["same"] == ""


def test_patterns_equal_their_plain_forms(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices([*"aébVx'-_. ,;:!?()[]{}\t　\xa0 7«’…–", "  ", "bcdfg", "a b c d e"], k=rng.randint(0, 60))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t, token = F.col("t"), lambda p: F.size(F.filter(F.regexp_extract_all(t, F.lit(P.TOKEN), F.lit(0)), lambda x: F.rlike(x, F.lit(p))))
    count = lambda p: F.regexp_count(t, F.lit(p))
    spaces = F.regexp_replace(F.translate(t, "\xa0", " "), "[ \t]+", " ")
    for pattern, to in ((f"{P.WS}+([,.;:!?])", "$1"), (rf"([(\[{{]){P.WS}+", "$1"), (rf"{P.WS}+([)\]}}])", "$1"), (f"^{P.WS}+|{P.WS}+$", "")):
        spaces = F.regexp_replace(spaces, pattern, to)
    pairs = {
        "cluster": (count(P.CLUSTER), count(rf"(?:\b[{P.LATIN}]{P.WS}+){{3,}}[{P.LATIN}]\b")),
        "single": (count(P.SINGLE), token(f"^[{P.LATIN}']$") - token(f"^{P.ROMAN}$")),
        "vowelless": (count(P.VOWELLESS), token(f"^{P.CONSONANTS}$")),
        "spaces": (T.normalize_spaces(t), spaces),
    }
    for name, (ours, plain) in pairs.items():
        assert df.where(~ours.eqNullSafe(plain)).count() == 0, name
