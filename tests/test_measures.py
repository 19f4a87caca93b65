"""Measures of texts that skip what can't matter, against the plain patterns."""

import random

from pyspark.sql import functions as F

from lexquarry.functions import patterns as P
from lexquarry.functions import quality as Q
from lexquarry.functions import spacing
from lexquarry.functions import text as T


def odd_texts(n):
    rng = random.Random(6)
    return ["".join(rng.choices([*"aébVx'-_. ,;Ÿšß÷×I\t\n\r　\xa0\x85 7«…日😀", "  ", "bcdfg", "XVI ", " q ", "a b c d e"], k=rng.randint(0, 50))) for _ in range(n)]


def test_tokens_are_counted_as_by_patterns(spark, monkeypatch):
    monkeypatch.setattr(Q, "TOGETHER", 300)
    df = spark.createDataFrame([(t,) for t in [*odd_texts(3000), "", "'", "x", "bcdfgh"]], "t string")
    t = F.col("t")
    count = lambda p: F.regexp_count(t, F.lit(p))
    rows = df.select(Q.token_counts(t).alias("c"), count(P.TOKEN).alias("n"), count(P.SINGLE).alias("single"), count(P.VOWELLESS).alias("vowelless"))
    assert rows.where("c.n <> n or c.single <> single or c.vowelless <> vowelless").count() == 0
    assert rows.where("c.vowelless > 0 and c.single > 0").count() > 100


def test_letters_of_long_lines_are_not_looked_at(spark):
    words, letters, upper = T.heading_counts(F.col("t"))
    texts = ["un DEUX trois", "A B C D E F G H", "a b c d e f g h i", "UN " * 5000, ""]
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(words, letters, upper).collect()]
    assert got == [(3, 11, 4), (8, 8, 8), (9, 0, 0), (9, 0, 0), (0, 0, 0)]


def test_normal_forms_equal_their_plain_ones(spark):
    df = spark.createDataFrame([(t,) for t in odd_texts(4000)], "t string")
    t = F.col("t")
    strip = lambda x: F.regexp_replace(x, f"^{P.WS}+|{P.WS}+$", "")
    assert df.where(~T.canonical(t).eqNullSafe(F.lower(strip(F.regexp_replace(t, f"{P.WS}+", " "))))).count() == 0
    plain = F.regexp_replace(F.replace(F.translate(t, "‘’“”–—−", "''\"\"---"), F.lit("…"), F.lit("...")), f"{P.WS}+-{P.WS}+", " - ")
    plain = F.regexp_replace(F.translate(plain, "\xa0", " "), "[ \t]+", " ")
    for pattern, to in ((f"{P.WS}+([,.;:!?])", "$1"), (rf"([(\[{{]){P.WS}+", "$1"), (rf"{P.WS}+([)\]}}])", "$1")):
        plain = F.regexp_replace(plain, pattern, to)
    assert df.where(~T.normalize_typography(t).eqNullSafe(strip(plain))).count() == 0


def test_spaced_letters_and_odd_characters_are_counted_as_by_patterns(spark):
    texts = [*odd_texts(3000), "l'a b c d", "a b c d'e", "x (a b c) d", "a b c", "a  b\t\xa0c d e", "«a b c d» ~ é à ù ô", "日 a b c d", "1a b c d", "a b c d5", "I V X L"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    count = lambda p: F.regexp_count("t", F.lit(p))
    rows = df.select("t", Q.token_counts(F.col("t")).alias("c"), count(P.CLUSTER).alias("clusters"), count(P.BAD).alias("bad"))
    assert rows.where("c.clusters <> clusters or c.bad <> bad").collect() == []
    assert rows.where("clusters > 0 and bad > 0").count() > 30


def test_blocks_are_cut_at_articles_as_by_patterns(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices(["art. 5", "Art7", "ART .3", "art", "artı. 1", ".", ";", "» ", "\" ", " x ", " ", " ", "é", "٣", "\n"], k=rng.randint(0, 12))) for _ in range(4000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, t string")
    marked, t = F.regexp_replace("t", P.INLINE, "$1\x1e$2"), F.col("t")
    starts = F.length(marked) - F.length(t) + F.rlike(t, F.lit(P.INLINE_START)).cast("int")
    plain = F.when(starts >= 2, F.filter(F.transform(F.split(marked, "\x1e", -1), T.strip), lambda p: p != "")).otherwise(F.array(t))
    rows = df.select("t", spacing.split_articles(t).alias("got"), plain.alias("plain"))
    assert rows.where(~F.col("got").eqNullSafe(F.col("plain"))).collect() == []
    assert rows.where("size(got) > 2").count() > 50
