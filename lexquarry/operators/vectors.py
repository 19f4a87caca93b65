"""Exact vector search, and the fingerprints that tell whether a stored index still fits its corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import scoring as S
from lexquarry.functions import text as T
from lexquarry.operators.numbering import numbered
from lexquarry.sources.shared import materialize

#: Bytes of a block of vectors (as doubles), bytes of products that are made exact at once, and bytes of best values that a
#: task keeps over its blocks.
BLOCK_BYTES = 4_000_000
EXACT_BYTES = 32_000_000
KEPT_BYTES = 64_000_000


def blocks(rows: DataFrame, key: str, part: str | None, unit: bool) -> DataFrame:
    """part, dims, ids, data: rows (key, embedding, part) as matrices of BLOCK_BYTES at most, each of one part and dimension.
    With unit, vectors are brought to length 1 (but for those of length 0). An embedding that is null or empty, or has an
    element that is null or not finite, is in no block."""
    of = F.col(part) if part else F.lit("")
    chosen = rows.select(F.col(key).alias("id"), of.alias("part"), F.col("embedding").cast("array<double>").alias("embedding"))
    kinds = dict(chosen.dtypes)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            sizes = np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            odd = np.zeros(len(sizes), bool)
            odd[np.repeat(np.arange(len(sizes)), sizes)[~np.isfinite(flat)]] = True
            parts = batch.column("part").dictionary_encode(null_encoding="encode")
            codes = parts.indices.to_numpy()
            use = np.flatnonzero((sizes > 0) & ~odd)
            for code, dims in np.unique(np.stack([codes[use], sizes[use]], 1), axis=0).tolist() if len(use) else ():
                own = use[(codes[use] == code) & (sizes[use] == dims)]
                step = max(1, BLOCK_BYTES // (8 * dims))
                for at in range(0, len(own), step):
                    some = own[at : at + step]
                    matrix = flat[starts[some][:, None] + np.arange(dims)]
                    if unit:
                        norm = np.sqrt(np.cumsum(matrix * matrix, axis=1)[:, -1:])
                        matrix = np.divide(matrix, norm, out=matrix.copy(), where=norm > 0)
                    ids = batch.column("id").take(pa.array(some))
                    listed = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), ids)
                    columns = [parts.dictionary.take(pa.array([code])), pa.array([dims], pa.int32()), listed, pa.array([matrix.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "dims", "ids", "data"])

    return chosen.mapInArrow(emit, f"part {kinds['part']}, dims int, ids array<{kinds['id']}>, data binary")


class Best:
    """The k best values so far of each query of a block, for as many blocks as there is room for."""

    def __init__(self, k: int):
        self.k, self.held, self.bytes = k, {}, 0

    def bar(self, key, n: int) -> np.ndarray:
        return self.held[key].min(axis=1) if key in self.held else np.full(n, -np.inf)

    def add(self, key, n: int, query: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
        if key not in self.held:
            if self.bytes + n * self.k * 8 > KEPT_BYTES:
                return
            self.bytes += n * self.k * 8
            self.held[key] = np.full((n, self.k), -np.inf)
        new = np.full((n, self.k), -np.inf)
        new[query, place] = value
        self.held[key] = np.partition(np.concatenate([self.held[key], new], axis=1), self.k, axis=1)[:, self.k :]


def block_best(held: np.ndarray, asked: np.ndarray, ords: np.ndarray, bar: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, ...]:
    """(query, place, row, value) of the k best rows of held for each row of asked, among those that may reach its bar;
    greater values are better, ties go by ords.

    A matrix product tells which rows may be among them, with room for rounding; their values are then summed in order, so
    that equal vectors have equal values wherever they stand.
    """
    product, dims = held @ asked.T, held.shape[1]
    h, q = (held * held).sum(axis=1), (asked * asked).sum(axis=1)
    if metric != "ip":
        product = 2 * product - h[:, None] - q[None, :]
    slack = 8 * (dims + 8) * np.finfo(float).eps * (np.sqrt(h.max()) + np.sqrt(q)) ** 2
    if len(held) > k:
        bar = np.maximum(bar, np.partition(product, len(held) - k, axis=0)[len(held) - k] - slack)
    row, query = np.nonzero(product >= (bar - slack)[None, :])
    value, step = np.empty(len(row)), max(1, EXACT_BYTES // (8 * dims))
    for at in range(0, len(row), step):
        a, b = held[row[at : at + step]], asked[query[at : at + step]]
        terms = a * b if metric == "ip" else -((a - b) ** 2)
        value[at : at + step] = np.cumsum(terms, axis=1)[:, -1]
    order = np.lexsort((ords[row], -value, query))
    query, row, value = query[order], row[order], value[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    top = place < k
    return query[top], place[top], row[top], value[top]


def nearest(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "ip", part: str | None = None) -> DataFrame:
    """query_id, ord, raw, rank (and part): the k vectors (ord, embedding) that are best for each query (query_id,
    embedding), exactly; with part, a column of vectors, the k best of each part. raw is the inner product of unit vectors
    (ip) or the squared distance (l2); ties keep the order of ord. Vectors of different dimensions don't meet.

    Blocks of queries meet blocks of vectors, and each pair of blocks sends on its k best. The blocks of queries are a
    written table of known size: Spark sends it to the tasks if it is small, and reads it beside each part of the vectors
    if not. Vectors are not exchanged.
    """
    asked = materialize(blocks(queries, "query_id", None, metric == "ip").withColumn("block", F.monotonically_increasing_id()), "query-blocks")
    held, name = blocks(vectors, "ord", part, metric == "ip"), part or "part"
    kinds, of = dict(held.dtypes), dict(queries.dtypes)["query_id"]
    pairs = held.crossJoin(asked.select("block", F.col("ids").alias("asked"), F.col("dims").alias("wide"), F.col("data").alias("matrix"))).where("dims = wide")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for i in range(len(batch)):
                dims, ords, ids = batch["dims"][i].as_py(), batch["ids"][i].values, batch["asked"][i].values
                a, b = (np.frombuffer(batch[c][i].as_buffer()).reshape(-1, dims) for c in ("data", "matrix"))
                key = (batch["block"][i].as_py(), batch["part"][i].as_py())
                query, place, row, value = block_best(a, b, ords.to_numpy(), best.bar(key, len(b)), k, metric)
                if not len(query):
                    continue
                best.add(key, len(b), query, place, value)
                raw = value if metric == "ip" else -value
                columns = [ids.take(pa.array(query)), batch["part"].take(pa.array(np.full(len(query), i))), ords.take(pa.array(row)), pa.array(raw)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "part", "ord", "raw"])

    found = pairs.select("block", "part", "dims", "ids", "data", "asked", "matrix").mapInArrow(emit, f"query_id {of}, part {kinds['part']}, ord long, raw double")
    best = F.desc("raw") if metric == "ip" else F.asc("raw")
    rank = F.row_number().over(Window.partitionBy("query_id", "part").orderBy(best, "ord"))
    ranked = found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
    return ranked.withColumnRenamed("part", name) if part else ranked.drop("part")


def scores_by_id(found: DataFrame, metric: str = "ip") -> DataFrame:
    """The best score of each id in a tier; rows that share an id share it."""
    return found.groupBy("query_id", "tier", "id").agg(F.max(S.vector_score(F.col("raw"), metric)).alias("vector"))


def index_meta(articles: DataFrame) -> DataFrame:
    return articles.select("tier", "ord", "id", "article_number", F.coalesce("quality", F.lit(0.0)).alias("ocr_quality_score"), T.digest(F.col("text")).alias("text_hash"))


#: Rows whose digests one task chains at once.
DIGEST_ROWS = 100_000


def fingerprints(articles: DataFrame) -> DataFrame:
    """tier, rows, fingerprint: a digest of id, number and text hash in row order. One tier is one ordered string, so this is
    for the corpora that an index of this kind holds; larger ones use chunked_fingerprints."""
    line = F.concat_ws("|", "id", "article_number", T.digest(F.col("text")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: F.concat(x["line"], F.lit("\n")))
    return articles.groupBy("tier").agg(F.count("*").alias("rows"), T.digest(F.array_join(ordered, "")).alias("fingerprint"))


def chunk_digests(articles: DataFrame) -> DataFrame:
    """tier, chunk, n, d: the same of chunks of DIGEST_ROWS ordinals. No task holds a whole tier's text hashes."""
    line = F.concat_ws("|", "id", "article_number", T.digest(F.col("text")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"])
    return articles.groupBy("tier", chunk_of(F.col("ord")).alias("chunk")).agg(F.count("*").alias("n"), T.digest(F.array_join(ordered, "\n")).alias("d"))


def chunk_of(ord_: Column) -> Column:
    return F.floor(ord_ / DIGEST_ROWS)


def chunked_fingerprints(articles: DataFrame) -> DataFrame:
    """tier, rows, fingerprint: a digest of the chunks' digests."""
    return over_chunks(chunk_digests(articles))


def over_chunks(chunks: DataFrame) -> DataFrame:
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("chunk", "d"))), lambda x: x["d"])
    return chunks.groupBy("tier").agg(F.sum("n").alias("rows"), T.digest(F.array_join(ordered, "\n")).alias("fingerprint"))


def changed_chunks(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """tier, chunk of the chunks (of chunk_digests) that are on one side only or differ."""
    both = stored.select("tier", "chunk", F.col("d").alias("was")).join(expected.select("tier", "chunk", F.col("d").alias("now")), ["tier", "chunk"], "full_outer")
    return both.where("not (was <=> now)").select("tier", "chunk")


def manifest_check(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """tier, stored, expected, valid over the tiers of either side (columns tier, fingerprint)."""
    both = stored.select("tier", F.col("fingerprint").alias("stored")).join(expected.select("tier", F.col("fingerprint").alias("expected")), "tier", "full_outer")
    return both.select("tier", "stored", "expected", F.col("stored").eqNullSafe(F.col("expected")).alias("valid"))


def batches(rows: DataFrame, by: str, order: str, size: int = 40) -> DataFrame:
    ranked = numbered(rows, by, order)
    return ranked.select(*rows.columns, F.floor((F.col("rank") - 1) / max(1, size)).cast("long").alias("batch"))
