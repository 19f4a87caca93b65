"""Dropping lines that many documents share, while the last document that holds one keeps it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.common import BLANKS, fresh, materialize, table, text_or_empty, unclashed

MIN_CHARS = 20
MIN_DOCS = 3
_STRIP = BLANKS.encode()


def line_keys(text: str, min_chars: int) -> list[bytes | None]:
    """A 128-bit digest for each line's key, None for keys that are too short to count."""
    out = []
    for line in text.encode().split(b"\n"):
        key = line.strip(_STRIP).lower()  # on bytes, only A-Z change
        long = len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)
        out.append(xxhash.xxh128_digest(key) if long else None)
    return out


def line_digests(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(hi, lo, doc_id): each document's different line keys as two halves of a 128-bit digest."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, doc_id) for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True) for key in {*line_keys(text, min_chars)} - {None}]
            yield pd.DataFrame(
                {"hi": [int.from_bytes(k[:8], "big", signed=True) for k, _ in rows], "lo": [int.from_bytes(k[8:], "big", signed=True) for k, _ in rows], "doc_id": [d for _, d in rows]},
                dtype="int64",
            )

    own = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return own.mapInPandas(explode, "hi long, lo long, doc_id long")


def dropped_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id and `keys`, the digests of the lines that it loses. Bounded by the document's own lines."""
    digests = materialize(line_digests(docs, min_chars), "lines")
    # Two steps: lines of a key that many documents hold are counted in many tasks before they meet.
    common = digests.groupBy("hi", "lo").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    lost = digests.join(common.select("hi", "lo", "keeper"), ["hi", "lo"]).where("doc_id <> keeper")
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("keys"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, text_col: str = "text") -> DataFrame:
    """docs with its text rebuilt from the lines that stay, and n_lines, n_dropped (names are renamed if taken).

    Null or empty text: one empty line, kept. Rows that repeat a doc_id count as one document and lose the same lines.
    Rows without doc_id neither count nor lose lines. A text that loses nothing stays as it is (a null becomes empty).
    """
    keys, result = fresh(docs, "keys"), fresh(docs, "kept")
    lost = dropped_keys(docs.select("doc_id", F.col(text_col).alias("text")), min_chars, min_docs).select(F.col("doc_id").alias(fresh(docs, "id")), F.col("keys").alias(keys))

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def rebuild(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, drops in batches:
            rows = []
            for text, drop in zip(texts, drops, strict=True):
                lines = text.split("\n")
                if drop is None or not len(drop):
                    rows.append((text, len(lines), 0))
                    continue
                gone = {d["hi"].to_bytes(8, "big", signed=True) + d["lo"].to_bytes(8, "big", signed=True) for d in drop}
                kept = [line for line, key in zip(lines, line_keys(text, min_chars), strict=True) if key not in gone]
                rows.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
            yield pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

    joined = docs.join(lost, F.col("doc_id") == F.col(fresh(docs, "id")), "left")
    done = joined.withColumn(result, rebuild(text_or_empty(text_col), F.col(keys)))
    return done.select(*(F.col(result)["text"].alias(c) if c == text_col else F.col(c) for c in docs.columns), *(F.col(result)[n].alias(unclashed(docs, n)) for n in ("n_lines", "n_dropped")))


def op4(spark, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.doc_id, pos, line, keeper IS NOT NULL AND keyed.doc_id <> keeper AS gone
  FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
