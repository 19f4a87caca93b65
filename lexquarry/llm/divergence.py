"""Source divergence audit: how far the sources of a language are apart in the words they use, and by which words.

Terms of every text are counted by language and source. Pairs of sources are compared in a cube: a task owns a cell (block
of sources, block of sources, block of terms), gets the two slices of counts, which are copied once for each block that
they meet, and gives what the cell's terms add to the divergence of each of its pairs. A sum along the term axis ends it.
A cell holds at most about 2 * GROUPS * TERMS numbers however large the corpus, its vocabulary or a single source.

Numbers are exact: shares are integers of 10**-9, made by long division.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.common import materialize, table, text_or_empty, word_bytes

MIN_DOCS = 10
TOP_TERMS = 10
SHARE = 1_000_000_000
#: Sources and terms of a block, about.
GROUPS, TERMS = 32, 8192
#: Counts that a task holds before it hands them on.
HELD = 500_000
COUNTS = "lang string, source string, term string, n long, docs long"


def term_counts(docs: DataFrame) -> DataFrame:
    """COUNTS: occurrences and documents of each term by (lang, source), and a row with a null term for each of these groups.
    Tasks sum before anything is exchanged, and a group's counts are summed term by term, so no group is one task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, held, size = word_bytes(digits=False), {}, 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                words = text.as_buffer().to_pybytes().translate(wanted).split()
                if (lang, source) not in held:
                    held[lang, source] = Counter(), Counter()
                n, d = held[lang, source]
                size -= len(n)
                n.update(words)
                d.update(set(words))
                size += len(n)
                if size > HELD:
                    yield from frames(held)
                    held, size = {}, 0
        yield from frames(held)

    def frames(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            terms = [None, *(t.decode() for t in n)]
            columns = [[lang] * len(terms), [source] * len(terms), terms, [0, *n.values()], [0, *(d[t] for t in n)]]
            kinds = [pa.string()] * 3 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "source", "term", "n", "docs"])

    own = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")), text_or_empty().cast("binary").alias("text"))
    return own.mapInArrow(count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(10**9 * (n + 2) / whole), exact below 9 * 10**15: three digits at a time."""
    rest, out = n.astype(np.int64) + 2, np.zeros(len(n), np.int64)
    out, rest = rest // whole * SHARE, rest % whole
    for place in (1_000_000, 1000, 1):
        rest = rest * 1000
        out += rest // whole * place
        rest %= whole
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)) by term; shares are at most 10**9 + 1, so squares fit."""
    return (p - q) ** 2 // (p + q)


def cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """One cell's part of each pair's divergence. Rows: a source each, in the block lo or hi, with its counts here."""
    n_terms = int(pdf["n_terms"].iloc[0])
    pdf = pdf.sort_values("source")
    shares = np.empty((len(pdf), n_terms), np.int64)
    for row, places, counts, whole in zip(shares, pdf["places"], pdf["counts"], pdf["whole"], strict=True):
        if n_terms:
            row[:] = share(np.zeros(1), whole)[0]
            if places is not None:
                row[np.asarray(places, np.int64)] = share(np.asarray(counts, np.int64), whole)
    source, block = pdf["source"].to_numpy(object), pdf["block"].to_numpy()
    lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
    first, second, sums = [], [], []
    for i in np.flatnonzero(block == lo).tolist():
        others = np.flatnonzero(block == hi)
        others = others[others > i] if lo == hi else others
        first += [source[i]] * len(others)
        second += source[others].tolist()
        sums += divergence(shares[others], shares[i]).sum(axis=1).tolist()
    return pd.DataFrame({"lang": pd.Series([pdf["lang"].iloc[0]] * len(sums), dtype=object), "a": pd.Series(first, dtype=object), "b": pd.Series(second, dtype=object), "value": pd.Series(sums, dtype="int64")})


def _share(n: Column, whole: Column) -> Column:
    return F.call_function("div", F.lit(SHARE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)"), whole.cast("decimal(20,0)")) + 1


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, groups: int = GROUPS, terms: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: for each (lang, source) its divergence from each other source of the language
    (part `pair`), and the terms that it has more of than its language, by their share in the divergence (part `term`).

    Null lang, source and text are empty strings. A source without words, and a language without a kept term, are
    compared like any other. Repeated rows are rows; other columns are not used. An empty table gives no rows.
    """
    counts = materialize(term_counts(docs.select("lang", "source", "text")), "term-counts")
    vocabulary = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("df")).where(F.col("df") >= min_docs)
    vocabulary = materialize(vocabulary.select("lang", "term", "lang_n"), "vocabulary")
    members = counts.where("term is null").select("lang", "source")
    kept = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    sizes = members.groupBy("lang").agg(F.count("*").alias("g")).join(kept, "lang", "left")
    langs = sizes.select(
        "lang",
        F.coalesce("v", F.lit(0)).alias("v"),
        (F.coalesce("lang_total", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("lang_whole"),
        F.ceil(F.col("g") / groups).cast("int").alias("blocks"),
        F.greatest(F.ceil(F.coalesce("v", F.lit(0)) / terms), F.lit(1)).cast("int").alias("slabs"),
    )
    langs = materialize(langs, "languages")
    numbered = vocabulary.join(langs, "lang").select("lang", "term", "lang_n", "lang_whole", F.pmod(F.xxhash64("term"), F.col("slabs")).cast("int").alias("slab"))
    numbered = materialize(numbered.withColumn("place", F.row_number().over(Window.partitionBy("lang", "slab").orderBy("term")) - 1), "terms")
    held = materialize(counts.join(numbered, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "lang_whole", "slab", "place"), "held")

    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = (F.coalesce("total", F.lit(0)) + 2 * F.col("v")).alias("whole")
    sources = members.join(totals, ["lang", "source"], "left").join(langs, "lang")
    sources = materialize(sources.select("lang", "source", whole, "blocks", "slabs", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")), "sources")

    slices = held.groupBy("lang", "source", "slab").agg(F.collect_list(F.struct("place", "n")).alias("s"))
    depth = numbered.groupBy("lang", "slab").agg(F.count("*").alias("n_terms"))
    grid = sources.select("*", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)).alias("slab"))
    grid = grid.join(slices, ["lang", "source", "slab"], "left").join(depth, ["lang", "slab"], "left")
    grid = grid.select("lang", "source", "whole", "block", "blocks", "slab", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.col("s.place").alias("places"), F.col("s.n").alias("counts"))
    copied = grid.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    copied = copied.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "blocks")
    parts = copied.groupBy("lang", "lo", "hi", "slab").applyInPandas(cell, "lang string, a string, b string, value long")
    pairs = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    own = held.join(sources.select("lang", "source", "whole"), ["lang", "source"])
    own = own.select("lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("whole")).alias("p"), _share(F.col("lang_n"), F.col("lang_whole")).alias("q")).where("p > q")
    own = own.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    return pairs.select("*", rank).unionByName(own.select("*", rank).where(F.col("rank") <= top_terms))


def op13(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+')) AS term FROM d),
kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
sources AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT s.lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS total FROM (SELECT DISTINCT lang FROM sources) s LEFT JOIN kept k USING (lang) GROUP BY s.lang),
counts AS (SELECT words.lang, source, words.term, CAST(count(*) AS HUGEINT) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT s.lang, s.source, coalesce(sum(n), 0) AS total FROM sources s LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (t.total + 2 * v.v) AS p,
         1 + 1000000000 * (k.n + 2) // (v.total + 2 * v.v) AS q
  FROM totals t JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 10
"""
