"""Best-fit packing of token pieces into fixed-length training sequences.

Tokenising is per document. Packing is best-fit decreasing over the *histogram* of piece lengths: there are at most
``capacity`` different lengths, so the plan has a size that doesn't depend on the number of documents, and all pieces
of one length that go to like bins are placed in one step. The bins so made are those that the rule gives piece by
piece. Ranks within a length are counted in salted groups, so a length that most pieces share is no single task.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.common import fresh, materialize, table, text_or_empty, unclashed

CAPACITY = 1024
END_ID = 2
#: Rows that share a length are ranked in groups of about this many.
RANK_GROUP = 50_000
#: Bytes of text whose pieces are handed on at once.
BATCH_BYTES = 4_000_000
PIECES = "piece int, start long, length long, ids binary"


@dataclass(frozen=True)
class Vocabulary:
    """The files of one byte-level vocabulary: as JSON, and the same as ranks, with the pattern that splits text."""

    json: str
    ranks: str
    pattern: str


class Encoder:
    """Ids of whole texts as packed little-endian 32-bit integers.

    They are the ids that `tokenizers` gives for the JSON file: the same vocabulary as ranks, with the JSON file's added
    tokens, encoded by `tiktoken` in a third of the time. The tests hold both equal. A text that its pattern gives up on (a
    run of a million blanks) goes to `tokenizers` itself.
    """

    def __init__(self, vocabulary: Vocabulary):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary.ranks).read_bytes().splitlines())}
        added = {t["content"]: t["id"] for t in json.loads(Path(vocabulary.json).read_text("utf-8"))["added_tokens"]}
        self.json = vocabulary.json
        self.encoding = tiktoken.Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens=added)

    def encode(self, text: str) -> bytes:
        try:
            ids = self.encoding.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            ids = np.asarray(self.plain.encode(text, add_special_tokens=False).ids, "<u4")
        return ids.astype("<u4", copy=False).tobytes()

    @cached_property
    def plain(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json)


def cut(ids: bytes, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole where it fits, else the rest first and then full pieces."""
    n = len(ids) // 4
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def tokenize(docs: DataFrame, vocabulary: Vocabulary, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id and PIECES of each document; a null text is an empty one, whose only id is end_id."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = Encoder(vocabulary), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            rows, size = [], 0
            for key, none, text in zip(batch["doc_id"], batch["none"], batch["text"], strict=True):
                key, ids = None if none else key, encoder.encode(text) + end
                rows += [(key, i, s, n, ids[4 * s : 4 * (s + n)]) for i, (s, n) in enumerate(cut(ids, capacity))]
                size += len(text)
                if size >= BATCH_BYTES:
                    yield frame(rows)
                    rows, size = [], 0
            yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])
        out["doc_id"] = pd.array(out["doc_id"], dtype="Int64")
        return out

    doc_id = F.col("doc_id").cast("long")
    own = docs.select(F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("none"), text_or_empty().alias("text"))
    return own.mapInPandas(pieces, f"doc_id long, {PIECES}")


class FreeBins:
    """Open bins by free room: a segment tree over the rooms 0..capacity that finds the tightest fit by bisection."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.bins: dict[int, list[list[int]]] = {}  # room -> [first bin, number of bins]

    def add(self, room: int, first: int, count: int) -> None:
        self.bins.setdefault(room, []).append([first, count])
        self._set(room, 1)

    def _set(self, room: int, value: int) -> None:
        i = room + self.size
        self.tree[i] = value
        while i > 1:
            i //= 2
            self.tree[i] = self.tree[2 * i] | self.tree[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest room of an open bin that is at least need."""
        i = need + self.size
        if self.tree[i]:
            return need
        while i > 1 and not (i % 2 == 0 and self.tree[i + 1]):
            i //= 2
        if i <= 1:
            return None
        i += 1
        while i < self.size:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.size

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Up to most bins of one run with this room: (first bin, number)."""
        run = self.bins[room][0]
        first, count = run[0], min(most, run[1])
        run[0] += count
        run[1] -= count
        if not run[1]:
            self.bins[room].pop(0)
            if not self.bins[room]:
                self._set(room, 0)
        return first, count


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over {length: number of pieces}.

    Gives runs (length, lo, hi, first_bin, per_bin, offset): the pieces of this length ranked lo..hi-1 go, per_bin to a
    bin, to the bins from first_bin on, the first one in each at offset.
    """
    free, runs, bins = FreeBins(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = free.tightest(length)
            if room is None:
                room, per = capacity, capacity // length
                first, count = bins, -(-left // per) if left < per else left // per
                bins += count
            else:
                per = room // length
                first, count = free.take(room, max(1, left // per))
            placed = min(left, count * per)
            each = placed // count
            runs.append((length, rank, rank + placed, first, each, capacity - room))
            if rest := room - each * length:
                free.add(rest, first, count)
            rank, left = rank + placed, left - placed
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY, key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset (renamed if taken) to rows with a length of 1..capacity.

    Rows of equal key and length are interchangeable. Extra columns are kept. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    sized = pieces.groupBy("length").agg(F.count("*").alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in sized.collect()}  # at most `capacity` rows
    if bad := [n for n in histogram if not 1 <= n <= capacity]:
        raise ValueError(f"piece lengths must be 1 to {capacity}, not {bad[:3]}")
    runs = plan_bins(histogram, capacity)
    salt, rank = fresh(pieces, "salt"), fresh(pieces, "rank")
    salts = max(1, -(-max(histogram.values(), default=1) // RANK_GROUP))
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64(*key), F.lit(salts)))
    counts = salted.groupBy(F.col("length").alias("of_length"), F.col(salt).alias("of_salt")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("of_length").orderBy("of_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("of_length", "of_salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", salt).orderBy(*key)
    numbered = salted.withColumn(rank, F.row_number().over(within) - 1)
    ranked = numbered.join(offsets, (numbered["length"] == offsets["of_length"]) & (numbered[salt] == offsets["of_salt"]))
    ranked = ranked.select(*(numbered[c] for c in pieces.columns), (numbered[rank] + offsets["before"]).alias(rank))
    # The plan is bounded by the capacity, not by the rows, so sending it to each task is safe.
    plan = F.broadcast(spark.createDataFrame(runs, "run_length long, lo long, hi long, bin long, per long, at long"))
    fits = (ranked["length"] == plan["run_length"]) & (ranked[rank] >= plan["lo"]) & (ranked[rank] < plan["hi"])
    nth = ranked[rank] - plan["lo"]
    return ranked.join(plan, fits).select(
        *(ranked[c] for c in pieces.columns),
        (plan["bin"] + F.floor(nth / plan["per"])).cast("long").alias(unclashed(pieces, "sequence_id")),
        (plan["at"] + nth % plan["per"] * ranked["length"]).cast("long").alias(unclashed(pieces, "offset")),
    )


def pack_documents(docs: DataFrame, vocabulary: Vocabulary, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every document's pieces with their ids, and each piece's place: doc_id, PIECES, sequence_id, offset.

    Null or empty text: one piece that holds end_id alone. Repeated rows are packed each for itself. A null doc_id is
    carried as it is. Columns other than doc_id and text are not used.
    """
    return pack(materialize(tokenize(docs, vocabulary, capacity, end_id), "pieces"), capacity)


def digests(docs: DataFrame, vocabulary: Vocabulary, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """As pack_documents, with a checksum in place of the ids, which then needn't be moved."""
    pieces = tokenize(docs, vocabulary, capacity, end_id).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(materialize(pieces, "pieces"), capacity)


def byte_bpe() -> Vocabulary:
    import public_tokenizers as public

    return Vocabulary(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def op2(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), byte_bpe())
