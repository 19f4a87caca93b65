"""Short ways past texts that stay as they are, held equal to the plain forms; and texts of one row group are dealt to many tasks."""

import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lexquarry.functions import patterns as P
from lexquarry.functions import spacing as S
from lexquarry.functions import text as T
from lexquarry.operators import corpus as C
from lexquarry.plans import queries as Q

SPACES = [chr(c) for c in range(0x110000) if chr(c).isspace()]
#: What any of the plain forms looks for, and characters that share bytes with it.
PARTS = [*SPACES, *",.;:!?)]}([{-–—−…‘’“”'\"", *"aArRtT1é«»ñ日́😀᠎​́", "art", "ART ", "fin. Art. 1"]


def odd_texts(n, rng=random.Random(3)):
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 9))) for _ in range(n)] + [None, "", " "] + [f"x{c}y; art{c}2" for c in map(chr, range(0x3100))]


def test_texts_left_alone_are_those_that_stay():
    single = lambda x: " ".join(x.split())
    forms = [(S.typography, S.changed(S.typography, S._TYPED)), (S.spaces, S.changed(S.spaces, S._SPACED)), (single, S.changed(single, S._JOINED)), (S.articles, S.cut)]
    texts = odd_texts(30_000)
    for plain, quick in forms:
        want = [None if t is None else plain(t) for t in texts]
        for kind in (pa.string(), pa.large_string()):
            column = pa.array(texts, kind)
            assert quick(column).to_pylist() == want
            assert quick(column.slice(5, 1000)).to_pylist() == want[5:1005]  # a slice keeps its whole array's bytes
        assert quick(pa.array([], pa.string())).to_pylist() == [] and quick(pa.array([None], pa.string())).to_pylist() == [None]
    calls = []
    S.changed(lambda x: calls.append(x) or x, S._SPACED)(pa.array(["plain text, and more (of it)", "two  blanks"]))
    assert calls == ["two  blanks"]


def test_fronts_leave_out_nothing_that_fits(spark):
    rng = random.Random(4)
    heads = ["art", "Art.", "ARTICLE", "ar", "livre", "Titre", "ſection", "SECTION", "premiere partie", "## page", "#", "7", "٧", "12 bis", "-", "a)", "é)", "1)", "3°", " ", " ", "\n", "😀"]
    tails = [" 12 bis", " ", " 5 ", "", " II", " 3", " page 4", " x y z", ")", "ticle 5 ter 2", " MOT" * 9, " mot" * 7, " " * 200 + "mot"]
    texts = [a + b + c for a in heads for b in tails for c in ("", rng.choice(tails))] + ["A" * 300 + " B" * n for n in (6, 7, 8, 9)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    pairs = {"PAGE": P.PAGE_FRONT, "ORPHAN": P.ORPHAN_FRONT, "ARTICLE": P.ARTICLE_FRONT, "HEADING": P.HEADING_FRONT, "BULLET": P.BULLET_FRONT}
    got = rows.agg(*(F.count_if(T.opens_as(t, getattr(P, n), f) != F.rlike(t, F.lit(getattr(P, n)))).alias(n) for n, f in pairs.items()), *(F.count_if(F.rlike(t, F.lit(getattr(P, n)))).alias(f"{n}_fit") for n in pairs), F.count_if(T.few_words(t) != F.rlike(t, F.lit(P.FEW_WORDS))).alias("few")).first()
    assert all(got[n] == 0 for n in pairs) and got["few"] == 0
    assert all(got[f"{n}_fit"] > 1 for n in pairs)


def test_one_row_group_is_cleaned_by_many_tasks(spark, tmp_path):
    texts = pa.table({"doc_id": pa.array(range(400), pa.int64()), "text": [f"ligne {i}\nart. {i} - texte" * 20 for i in range(400)]})
    pq.write_table(texts, tmp_path / "documents.parquet")
    assert pq.ParquetFile(tmp_path / "documents.parquet").num_row_groups == 1
    for rows in (Q._blocks(spark, str(tmp_path)), Q._split(spark, str(tmp_path)).select("block")):
        steps = re.findall(r"ArrowEvalPython|RepartitionByExpression|Exchange", rows._jdf.queryExecution().executedPlan().toString())
        assert steps[-1] != "ArrowEvalPython", "texts are taken apart before they are dealt"
    assert steps.count("ArrowEvalPython") == 5  # lines, typography, cuts, spaces, then articles: none is made twice


def test_a_block_is_asked_once_if_it_is_a_heading(spark):
    blocks = spark.createDataFrame([(1, 0, "TITRE I"), (1, 1, "le b c d e mot"), (1, 2, "\\ ~ texte tout ordinaire de mots")], "doc_id long, block_idx long, block string")
    scored = C.scored(blocks)
    assert scored._jdf.queryExecution().optimizedPlan().toString().count(P.HEADING) == 1
    assert [r["score"] < 1 for r in scored.orderBy("block_idx").collect()] == [False, True, True]
