import duckdb
import pytest

import __spark_entry__ as entry
from lexquarry.plans import queries as Q

SF = "/root/testdata/sf0.001"
QUICK = ["normalize_lines", "block_split_articles", "article_rollup", "query_expand", "history_window", "tier_fingerprint", "head_fraction", "embed_batches", "manifest_check", "lexical_overlap", "merge_candidates", "source_lines"]


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(map(repr, pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())


def test_search_queries_go_down_every_way(spark):
    parsed, top = Q._parsed(spark, "/root/testdata/sf0.01"), Q.materialize(Q._top(spark, "/root/testdata/sf0.01"), "top")
    gate = {r["query_id"]: r for r in Q.S.gates(parsed, top).collect()}
    selected = Q.S.merged(top, Q.S.gates(parsed, top))
    out = Q.S.outcome(parsed, selected).collect()
    assert len(out) >= 40
    assert {r["use_b"] for r in gate.values()} == {r["use_c"] for r in gate.values()} == {True, False}
    assert {r["confidence"] for r in out} == {"HIGH", "MEDIUM", "LOW"}
    assert {r["needs_clarification"] for r in out} == {True, False}
    assert {w for r in out for w in r["warnings"]} == {Q.P.WARN_B, Q.P.WARN_C, Q.P.WARN_NONE}
    assert any(len(r["tier_path"]) > 1 for r in out)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
