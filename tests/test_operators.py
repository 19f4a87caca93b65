import pytest
from pyspark.sql import functions as F

from lexquarry.functions import quality as Q
from lexquarry.functions import text as T
from lexquarry.operators import answer as A
from lexquarry.operators import corpus as C
from lexquarry.operators import search as S
from lexquarry.operators import vectors as V


def apply(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in rows.select("i", f(F.col("x"))).orderBy("i").collect()]


def test_normalisation(spark):
    assert apply(spark, T.normalize_typography, ["l’\xa0«  a » ,  ( b )", "a–b  —  c…", " \x1c x  "]) == ["l' «  a »,(b)".replace("«  a", "« a").replace(",(", ", ("), "a-b - c...", "x"]
    assert apply(spark, T.split_lines, ["", "a", "a\n", "\n", "a\r\nb\x0bc\x85d"]) == [[], ["a"], ["a"], [""], ["a", "b", "c", "d"]]
    assert apply(spark, T.canonical, ["  A\xa0 b\nÉ "]) == ["a b é"]
    assert apply(spark, T.normalize_text, ["pénal, Art!"]) == ["p nal art"]
    assert apply(spark, T.tokens, ["pénal", "", "é"]) == [["p", "nal"], [], []]


def test_trigrams(spark):
    f = lambda x: T.trigrams(T.letters(x), F.length(x))
    assert apply(spark, f, ["", "a", "ab", "abc", "abcab", "aaaa"]) == [[], ["a"], ["ab"], ["abc"], ["abc", "bca", "cab"], ["aaa"]]


def test_references(spark):
    given = ["What does Art. 1 say?", "l'article 1er", "articles 368 et 369", "Art. 15bis", "art 18 bis 3", "Art. 15 bise", "part 7"]
    assert apply(spark, T.article_reference, given) == ["1", None, None, "15bis", "18 bis", "15", None]
    assert apply(spark, T.article_number, ["Art. 3 territoire", "Article 5 2004", "Art.12-BIS", "art"]) == ["3 ter", "5 2004", "12 bis", None]
    assert apply(spark, T.citations, ["Art. 1, art. 2 bis and article 1"]) == [["1", "2 bis", "1"]]
    assert apply(spark, T.expand_query, ["theft law", "rien"]) == ["theft law vol loi", "rien"]


def blocks_of(spark, lines):
    rows = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(lines)], "doc_id long, line_no long, line string")
    return [r["block"] for r in C.blocks(C.clean(rows)).orderBy("block_idx").collect()]


def test_blocks(spark):
    assert blocks_of(spark, ["une interdic-", "tion de l'", "amende", "", "suite", "## Page 3", "encore"]) == ["une interdiction de l'amende", "suite encore"]
    assert blocks_of(spark, ["DISPOSITIONS GENERALES", "texte", "1) point", "TITRE II", "fin"]) == ["DISPOSITIONS GENERALES", "texte", "1) point", "TITRE II", "fin"]
    assert blocks_of(spark, ["DISPOSITIONS", "GENERALES", "x"]) == ["DISPOSITIONS", "GENERALES", "x"]


def test_split(spark):
    rows = spark.createDataFrame([(1, 0, "fin. Art. 3 - a; Art. 4 - b"), (1, 1, "voir. Art. 3 seul"), (1, 2, "Art. 1 x. art 2 y"), (1, 3, "selon l'art. 3 et l'art. 4")], "doc_id long, block_idx long, block string")
    got = [r["block"] for r in C.split_articles(rows).orderBy("block_idx").collect()]
    assert got == ["fin.", "Art. 3 - a;", "Art. 4 - b", "voir. Art. 3 seul", "Art. 1 x.", "art 2 y", "selon l'art. 3 et l'art. 4"]


def test_ocr_quality(spark):
    got = apply(spark, Q.ocr_quality, ["", "12 34", "TITRE I", "deux mots", "un texte tout ordinaire de plusieurs mots", "é l é m e n t s épars dans un texte", "x \\ ~ " * 10])
    assert [g["score"] for g in got[:5]] == [1.0, 1.0, 1.0, 0.95, 1.0]
    assert "spaced_letter_clusters_detected" in got[5]["reasons"] and got[5]["score"] < 0.78
    assert got[6]["reasons"][-1] == "unexpected_characters"


@pytest.mark.parametrize("score, critical, low, blocks, want", [(0.88, 0, 0, 1, "A"), (0.9, 0, 1, 5, "B"), (0.9, 0, 2, 5, "C"), (0.7, 0, 0, 1, "B"), (0.6999, 0, 0, 1, "C"), (0.95, 1, 0, 1, "B"), (0.95, 2, 0, 1, "C")])
def test_tier(spark, score, critical, low, blocks, want):
    assert spark.range(1).select(Q.tier(F.lit(score), F.lit(critical), F.lit(low), F.lit(blocks))).first()[0] == want


def test_dedup_is_stable_and_idempotent(spark):
    rows = spark.createDataFrame([(1, 0, "A b"), (1, 1, "x"), (1, 2, "a  B"), (2, 0, "a b")], "doc_id long, block_idx long, block string")
    once = C.unique_blocks(C.mark_duplicates(rows))
    assert sorted(tuple(r) for r in once.collect()) == [(1, 0, "A b"), (1, 1, "x"), (2, 0, "a b")]
    assert sorted(C.unique_blocks(C.mark_duplicates(once)).collect()) == sorted(once.collect())
    assert [tuple(r)[:3] for r in C.duplicate_log(C.mark_duplicates(rows)).collect()] == [(1, 2, 0)]


def test_head_fraction(spark):
    rows = spark.range(17).selectExpr("'t' as tier", "id as ord")
    assert C.head_fraction(rows, "tier", "ord").count() == 13


def ranked(spark, rows, asked=((1, None, False),)):
    parsed = spark.createDataFrame([(q, "q", ref, low, "q") for q, ref, low in asked], "query_id long, query string, reference string, allow_low boolean, expanded string")
    scored = spark.createDataFrame(rows, "query_id long, ord long, id string, article_number string, tier string, exact double, fused double")
    top = S.top_by_tier(scored)
    gate = S.gates(parsed, top)
    return parsed, top, gate, S.merged(top, gate)


def test_ranking_ties_and_merge(spark):
    _, top, gate, merged = ranked(spark, [(1, 0, "x", "1", "A", 0.0, 0.15), (1, 1, "y", "2", "A", 0.0, 0.15), (1, 2, "x", "1", "B", 0.0, 0.15), (1, 3, "z", "3", "B", 0.0, 0.07), (1, 4, "c", "4", "C", 0.0, 0.9)])
    assert [(r["ord"], r["rank"]) for r in top.where("tier = 'A'").orderBy("rank").collect()] == [(0, 1), (1, 2)]
    assert tuple(gate.first())[1:] == (True, False)
    assert [(r["ord"], r["tier"]) for r in merged.orderBy("final_rank").collect()] == [(0, "A"), (1, "A")]


def test_exact_hits_alone_and_gates(spark):
    _, top, gate, _ = ranked(spark, [(1, 0, "x", "1", "A", 1.0, 0.01), (1, 1, "y", "2", "A", 0.0, 0.9), (2, 2, "b", "5", "B", 0.0, 0.1)], [(1, "1", True), (2, None, True), (3, None, False), (4, None, True)])
    assert [r["ord"] for r in top.where("query_id = 1").collect()] == [0]
    assert {r["query_id"]: (r["use_b"], r["use_c"]) for r in gate.collect()} == {1: (False, False), 2: (True, True), 3: (True, False), 4: (True, True)}


def test_outcome(spark):
    parsed, _, _, merged = ranked(spark, [(1, 0, "x", "1", "A", 0.0, 0.9), (1, 1, "y", "2", "A", 0.0, 0.5)], [(1, None, False), (2, None, False)])
    got = {r["query_id"]: tuple(r)[1:4] for r in S.outcome(parsed, merged).collect()}
    assert got == {1: ("A", False, "HIGH"), 2: ("", True, "LOW")}


def test_citations_of_a_draft(spark):
    selected = spark.createDataFrame([(1, 1, 0, "a", "5", "A", 0.5), (1, 2, 1, "b", "6 bis", "B", 0.4), (1, 3, 2, "c", "5", "B", 0.3)], "query_id long, final_rank long, ord long, id string, article_number string, tier string, fused double")
    drafts = spark.createDataFrame([(1, "art. 6 bis, Art. 9, art. 5, art. 5")], "query_id long, draft string")
    got = A.verify_citations(drafts, selected)
    assert tuple(got.first())[1:3] == ("6 bis, 5", False)
    assert sorted(r["final_rank"] for r in A.source_lines(selected, got).collect()) == [2, 3]
    assert tuple(A.verify_citations(drafts.withColumn("draft", F.lit("none")), selected).first())[1:3] == ("5, 6 bis", True)


def test_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [2.0, 0.0])], "ord long, embedding array<float>")
    asked = rows.where("ord = 0").withColumnRenamed("ord", "query_id")
    assert [(r["ord"], r["raw"]) for r in V.nearest(asked, rows, 5).orderBy("rank").collect()] == [(0, 1.0), (2, 1.0), (1, 0.0)]
    assert [(r["ord"], r["raw"]) for r in V.nearest(asked, rows, 2, "l2").orderBy("rank").collect()] == [(0, 0.0), (1, 1.0)]


def test_history(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 else "system", "t" if i != 9 else "") for i in range(15)], "conv_id long, turn long, role string, text string")
    assert sorted(r["turn"] for r in A.history(turns, 6).collect()) == [11, 13]
