"""Ranked lexical search by per-term geometric blocking.

A stored index of a batch of items' terms: tasks turn their documents into shards of bounded size. In a shard, the
documents of each term's posting list are clustered by their similarity, and a cluster is cut into blocks of at most
BLOCK documents. A block's summary has, for each term of the batch, the greatest impact that any of its documents has:
the exact coordinatewise maximum. So no document of a block can score above the block's bound, and a block is skipped
only if its bound is below a score that enough documents are known to reach.

A batch of items goes down twice. First each shard scores the most promising blocks of each item; the k-th best score so
found anywhere is a threshold that the true k best reach. Then each shard scores what the threshold leaves: posting
lists that alone can't lift a document over it are left out, and so are blocks by their bounds. Scores are whole numbers.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.common import materialize, open_stored, shared_dir, stored_at, table, text_or_empty, word_bytes

LIMIT = 50
#: Documents of a block, at most; clusters of a posting list, at most; numbers in a document's sketch.
BLOCK, CLUSTERS, SKETCH = 256, 32, 32
#: Postings of a shard, about; letters of the items of a batch, about.
SHARD_POSTINGS, BATCH_LETTERS = 1_000_000, 4_000_000
#: Blocks of an item that each shard scores to find a threshold.
PROBED = 4
#: The score's.
SCALE, K, UNIT, PART = 1_000_000_000, 20, 100, 50
VECTORS = "doc_id long, n long, docs long, terms binary, counts binary"
SHARDS = "file string, start long, size long"
FOUND = "item int, doc_id long, score long"


def terms_of(text: bytes, wanted: bytes = word_bytes(digits=True)) -> list[bytes]:
    return text.translate(wanted).split()


@dataclass(frozen=True)
class Batch:
    """Items with their ids and distinct terms, and the vocabulary of all of them."""

    ids: list[int | None]
    terms: list[list[int]]
    vocabulary: dict[bytes, int]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Batch:
        vocabulary: dict[bytes, int] = {}
        terms = [sorted({vocabulary.setdefault(w, len(vocabulary)) for w in terms_of((text or "").encode())}) for _, text in rows]
        return cls([i for i, _ in rows], terms, vocabulary)


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """VECTORS: of each document with a term of the vocabulary, its length and these terms' counts (32-bit integers). The row
    of each task with docs > 0 has sums over its documents: documents with a word, their words, and documents by term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, words, df = 0, 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = terms_of(text.as_buffer().to_pybytes())
                docs += bool(own)
                words += len(own)
                if known := [vocabulary[w] for w in own if w in vocabulary]:
                    found, counts = np.unique(known, return_counts=True)
                    df[found] += 1
                    rows.append((key, len(own), 0, found.astype("<u4").tobytes(), counts.astype("<u4").tobytes()))
            if rows:
                yield frame(rows)
        held = np.flatnonzero(df)
        if docs:
            yield frame([(None, words, docs, held.astype("<u4").tobytes(), df[held].astype("<i8").tobytes())])

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 3 + [pa.binary()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in VECTORS.split(", ")])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return materialize(own.mapInArrow(count, VECTORS), "vectors")


@dataclass(frozen=True)
class Corpus:
    """N documents with a word, their L words, and each term's weight."""

    n: int
    words: int
    weights: np.ndarray

    @classmethod
    def of(cls, found: DataFrame, size: int) -> Corpus:
        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for terms, counts in zip(batch.column(0), batch.column(1), strict=True):
                    arrays = np.frombuffer(terms.as_buffer(), "<u4").astype(np.int64), np.frombuffer(counts.as_buffer(), "<i8")
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), ["term", "df"])

        sums = found.where("docs > 0")
        total = sums.agg(F.sum("docs").alias("n"), F.sum("n").alias("words")).first()
        n, words = total["n"] or 0, total["words"] or 0
        df = np.zeros(size, np.int64)
        for r in sums.select("terms", "counts").mapInArrow(unpack, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a term of the batch
            df[r["term"]] = r["df"]
        return cls(n, words, np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64))

    def impacts(self, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """What a term adds to a document's score for each unit of its weight; below SCALE / 1000."""
        m = np.array([UNIT - PART + PART * n * self.n // self.words for n in lengths.tolist()], np.int64)
        return SCALE * counts // (1000 * counts + K * m)


def gathered(ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of these rows of a ragged table, and where each row's begin among them."""
    sizes = ptr[rows + 1] - ptr[rows]
    starts = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(ptr[rows] - starts, sizes), starts


@dataclass
class Shard:
    """Some documents: their vectors (ptr, terms, impacts), each term's blocks (lists of blocks, of documents), summaries."""

    keys: np.ndarray
    none: np.ndarray
    ptr: np.ndarray
    terms: np.ndarray
    impacts: np.ndarray
    list_ptr: np.ndarray
    block_ptr: np.ndarray
    block_docs: np.ndarray
    sum_ptr: np.ndarray
    sum_terms: np.ndarray
    sum_impacts: np.ndarray

    @classmethod
    def build(cls, keys: list[int | None], lengths: list[int], terms: list[np.ndarray], counts: list[np.ndarray], corpus: Corpus) -> Shard:
        size = len(corpus.weights)
        ptr = np.cumsum([0, *map(len, terms)])
        flat, flat_counts = np.concatenate(terms).astype(np.int64), np.concatenate(counts).astype(np.int64)
        impacts = corpus.impacts(flat_counts, np.repeat(np.array(lengths, np.int64), np.diff(ptr)))
        sketches = sketch(ptr, flat, impacts * corpus.weights[flat], size)
        order = np.argsort(flat, kind="stable")
        holders = np.repeat(np.arange(len(keys)), np.diff(ptr))[order]
        bounds = np.searchsorted(flat[order], np.arange(size + 1))
        blocks, list_ptr = [], np.zeros(size + 1, np.int64)
        for t in range(size):
            if bounds[t] < bounds[t + 1]:
                blocks += cluster(holders[bounds[t] : bounds[t + 1]], sketches)
            list_ptr[t + 1] = len(blocks)
        most, sums = np.zeros(size, np.uint32), []
        for block in blocks:
            at, _ = gathered(ptr, block)
            np.maximum.at(most, flat[at], impacts[at].astype(np.uint32))
            held = np.flatnonzero(most)
            sums.append((held, most[held]))
            most[held] = 0
        return cls(
            np.array([k or 0 for k in keys], np.int64),
            np.array([k is None for k in keys], np.uint8),
            ptr,
            flat.astype(np.uint32),
            impacts.astype(np.uint32),
            list_ptr,
            np.cumsum([0, *map(len, blocks)]),
            np.concatenate(blocks).astype(np.uint32),
            np.cumsum([0, *(len(h) for h, _ in sums)]),
            np.concatenate([h for h, _ in sums]).astype(np.uint32),
            np.concatenate([m for _, m in sums]),
        )

    def pack(self) -> bytes:
        arrays = {k: np.ascontiguousarray(v) for k, v in vars(self).items()}
        head = json.dumps({k: [v.dtype.str, len(v)] for k, v in arrays.items()}).encode()
        return zstandard.compress(struct.pack("<I", len(head)) + head + b"".join(v.tobytes() for v in arrays.values()), 1)

    @classmethod
    def unpack(cls, data: bytes) -> Shard:
        data = zstandard.decompress(data)
        at = 4 + struct.unpack_from("<I", data)[0]
        arrays = {}
        for name, (kind, n) in json.loads(data[4:at]).items():
            arrays[name] = np.frombuffer(data, kind, n, at)
            at += arrays[name].nbytes
        return cls(**arrays)

    def bounds(self, first: int, last: int, weights: np.ndarray) -> np.ndarray:
        """What no document of these blocks scores above."""
        a, b = self.sum_ptr[first], self.sum_ptr[last]
        return np.add.reduceat(weights[self.sum_terms[a:b]] * self.sum_impacts[a:b], self.sum_ptr[first:last] - a)

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        at, starts = gathered(self.ptr, docs)
        return np.add.reduceat(weights[self.terms[at]] * self.impacts[at], starts)

    def holders(self, blocks: np.ndarray) -> np.ndarray:
        return np.unique(self.block_docs[gathered(self.block_ptr, blocks)[0]]).astype(np.int64)

    def search(self, terms: list[int], weights: np.ndarray, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of one item. weights: 0 for all but its terms. least: the score that matters; if None, only the
        PROBED blocks of the highest bounds among the item's lists of greatest reach are scored."""
        lists = [t for t in terms if self.list_ptr[t] < self.list_ptr[t + 1] and weights[t]]
        reach = [int(weights[t]) * self.greatest(t) for t in lists]
        order = sorted(range(len(lists)), key=lambda i: reach[i])
        if least is None:
            lists = [lists[i] for i in order[-PROBED:]]
        else:  # a document that no list from here on holds can't reach it
            low, skipped = 0, 0
            while skipped < len(order) and low + reach[order[skipped]] < least:
                low += reach[order[skipped]]
                skipped += 1
            lists = [lists[i] for i in order[skipped:]]
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        blocks = np.concatenate([np.arange(self.list_ptr[t], self.list_ptr[t + 1]) for t in lists])
        most = np.concatenate([self.bounds(self.list_ptr[t], self.list_ptr[t + 1], weights) for t in lists])
        blocks = blocks[np.argsort(-most, kind="stable")[:PROBED]] if least is None else blocks[most >= least]
        if not len(blocks):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs = self.holders(blocks)
        scores = self.scores(docs, weights)
        good = scores >= max(1, least or 1)
        return docs[good], scores[good]

    def greatest(self, term: int) -> int:
        """A term's greatest impact in its own list."""
        if not hasattr(self, "_greatest"):
            known = np.zeros(len(self.list_ptr) - 1, np.int64)
            np.maximum.at(known, self.terms, self.impacts)
            self._greatest = known
        return int(self._greatest[term])


def sketch(ptr: np.ndarray, terms: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """A random projection of each document's vector, of length 1."""
    signs = np.random.default_rng(42).standard_normal((size, SKETCH), np.float32)
    out = np.zeros((len(ptr) - 1, SKETCH), np.float32)
    for at in range(0, len(out), 2048):
        a, b = ptr[at], ptr[min(at + 2048, len(out))]
        out[at : at + 2048] = np.add.reduceat(signs[terms[a:b]] * values[a:b, None].astype(np.float32), ptr[at : at + 2048][: len(out) - at] - a)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def cluster(docs: np.ndarray, sketches: np.ndarray) -> list[np.ndarray]:
    """A posting list's documents in blocks of like ones: each goes to the most similar of some of them, spread evenly over
    the list; the documents of one are cut, the most similar first, where they are more than BLOCK."""
    if len(docs) <= BLOCK:
        return [docs]
    centres = min(CLUSTERS, -(-len(docs) // BLOCK))
    alike = sketches[docs] @ sketches[docs[np.linspace(0, len(docs) - 1, centres).astype(int)]].T
    nearest = alike.argmax(axis=1)
    order = np.lexsort((docs, -alike[np.arange(len(docs)), nearest], nearest))
    edges = np.flatnonzero(np.diff(nearest[order], prepend=-1))
    return [docs[order[at : min(at + BLOCK, end)]] for start, end in zip(edges, [*edges[1:], len(docs)], strict=True) for at in range(start, end, BLOCK)]


def build_index(found: DataFrame, corpus: Corpus, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """SHARDS: where each shard of the documents of `vectors` stands in a file of the shared folder. A file counts once its
    shards are in this table, which Spark commits."""
    folder = f"{shared_dir(found.sparkSession).rstrip('/')}/lexquarry/postings-{uuid.uuid4().hex}"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, path, rows, at = None, "", [], 0
        for shard in shards(batches):
            if stream is None:
                files, place = stored_at(folder)
                files.create_dir(place, recursive=True)
                name = uuid.uuid4().hex
                stream, path = files.open_output_stream(f"{place}/{name}"), f"{folder}/{name}"
            data = shard.pack()
            stream.write(data)
            rows.append((path, at, len(data)))
            at += len(data)
        if stream:
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "start", "size"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
        held, n = [], 0
        for batch in batches:
            for key, length, terms, counts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "terms", "counts")), strict=True):
                held.append((key, length, np.frombuffer(terms, "<u4"), np.frombuffer(counts, "<u4")))
                n += len(terms) // 4
                if n >= shard_postings:
                    yield Shard.build(*map(list, zip(*held, strict=True)), corpus)
                    held, n = [], 0
        if held:
            yield Shard.build(*map(list, zip(*held, strict=True)), corpus)

    return materialize(found.where("docs = 0").select("doc_id", "n", "terms", "counts").mapInArrow(build, SHARDS), "shards")


def search(index: DataFrame, batch: Batch, corpus: Corpus, k: int, least: dict[int, int] | None) -> DataFrame:
    """FOUND: of each task, its best k of each item (by its number in the batch) among the documents that were scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}  # item -> rows of (score, no doc_id, doc_id)
        weights = np.zeros(len(batch.vocabulary), np.int64)
        for part in batches:
            for path, start, size in zip(*(part.column(c).to_pylist() for c in ("file", "start", "size")), strict=True):
                with open_stored(path) as file:
                    shard = Shard.unpack(file.read_at(size, start))
                for item, terms in enumerate(batch.terms):
                    weights[terms] = corpus.weights[terms]
                    floor = None
                    if least is not None:
                        floor = least.get(item, 1)
                        if len(best.get(item, ())) == k:
                            floor = max(floor, int(best[item][-1, 0]))
                    docs, scores = shard.search(terms, weights, floor)
                    weights[terms] = 0
                    if len(docs):
                        rows = np.column_stack([scores, shard.none[docs], shard.keys[docs]]).astype(np.int64)
                        rows = np.concatenate([best[item], rows]) if item in best else rows
                        best[item] = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[:k]]
        for item, rows in best.items():
            keys = pa.array(rows[:, 2], pa.int64(), mask=rows[:, 1].astype(bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), item, np.int32)), keys, pa.array(rows[:, 0])], ["item", "doc_id", "score"])

    shards, cores = index.count(), index.sparkSession.sparkContext.defaultParallelism
    return index.repartition(max(1, min(shards, 2 * cores), shards // 16)).mapInArrow(run, FOUND)


def rank(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_documents(docs: DataFrame, items: DataFrame, k: int = LIMIT, batch_letters: int = BATCH_LETTERS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents with a score above 0, equal scores by ascending
    doc_id, no doc_id last.

    docs: doc_id, text; items: item_id, text. Null or empty text has no terms: such a document is never found and doesn't
    count, such an item finds nothing. Repeated documents and repeated items are rows of their own; other columns are not
    used. Empty tables give no rows. Items are taken in batches of about batch_letters letters, dealt by their hash; the
    terms and weights of a batch alone are sent to all tasks.
    """
    spark = docs.sparkSession
    letters = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts, out = -(-letters // batch_letters), None
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).select(F.col("item_id").cast("long"), "text")
        batch = Batch.of([tuple(r) for r in own.collect()])
        found = vectors(docs, batch.vocabulary)
        corpus = Corpus.of(found, len(batch.vocabulary))
        index = build_index(found, corpus)
        probed = rank(search(index, batch, corpus, k, None), k).where(F.col("rank") == k)
        least = {r["item"]: r["score"] for r in probed.select("item", "score").collect()}  # a row an item of the batch
        ids = spark.createDataFrame(list(enumerate(batch.ids)), "item int, item_id long")
        best = materialize(rank(search(index, batch, corpus, k, least), k), "found").join(F.broadcast(ids), "item")
        best = best.select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op12(spark, sf_dir: str) -> DataFrame:
    return top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM lengths),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, nn),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), whole GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
