"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are made per document. Equal fingerprints are one row from then on. They are sorted by Gray rank and cut
into shards of neighbours; what the members of a shard have in common, a masked bit pattern, is a node of the index's
upper part, which is a row a shard. A fingerprint goes to a shard only if its differences from the nodes above it,
added up on the way down, are within RADIUS; there it goes on down the shard's own nodes. Links give a spanning forest
of each shard and an edge for each component of a shard that a visitor meets, never all pairs. Components are then
contracted by alternating large and small stars over DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lexquarry.llm.common import fresh, materialize, table, text_or_empty

RADIUS = 2
#: Children of a node, and fingerprints of a shard, about. The upper part has a row of 16 bytes for each shard.
WIDTH = 16
SHARD = 65_536
SEED = 42
#: Query and node pairs that a search holds at once.
FRONTIER = 1_000_000
SHINGLE_CHUNK = 65_536


def voted(chunks: Iterator[np.ndarray]) -> int:
    """The bits that over half of these 64-bit hashes have."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in chunks:
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: str, words: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash of a text's word shingles; zero without words."""
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    span = min(words, len(tokens))
    begin, stop = starts[: len(tokens) - span + 1].tolist(), ends[span - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    parts = (range(at, min(at + SHINGLE_CHUNK, len(begin))) for at in range(0, len(begin), SHINGLE_CHUNK))
    return voted(np.fromiter((digest(joined[begin[i] : stop[i]], seed) for i in part), np.uint64, len(part)) for part in parts)


def fingerprints(text: Column, words: int = 3) -> Column:
    @F.pandas_udf(LongType())
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t, words) for t in batch], np.uint64).view(np.int64))

    return of(text)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The position of each code in the Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """Codes in Gray order; each node above them holds the bits on which its WIDTH children agree.

    agree: of each code the bits that count (it may be a node itself); all of them if not given.
    """

    def __init__(self, codes: np.ndarray, agree: np.ndarray | None = None):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        pattern = codes[self.order]
        agree = np.full(len(codes), ~np.uint64(0)) if agree is None else agree[self.order]
        self.levels = [(pattern, agree)]
        while len(pattern) > WIDTH:
            first = np.arange(0, len(pattern), WIDTH)
            lead = pattern[first]
            same = agree & ~(pattern ^ np.repeat(lead, WIDTH)[: len(pattern)])
            pattern, agree = lead, np.bitwise_and.reduceat(same, first)
            self.levels.append((pattern, agree))
        # What a child adds to its parent's bits: only these are still to be compared below it.
        self.own = [a if i + 1 == len(self.levels) else a & ~np.repeat(self.levels[i + 1][1], WIDTH)[: len(a)] for i, (_, a) in enumerate(self.levels)]

    def uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """Of each node the label that all its leaves have, or -1."""
        out = [labels]
        while len(out) < len(self.levels):
            below = out[-1]
            first = np.arange(0, len(below), WIDTH)
            low, high = np.minimum.reduceat(below, first), np.maximum.reduceat(below, first)
            out.append(np.where((low == high) & (low >= 0), low, -1))
        return out

    def search(self, codes: np.ndarray, radius: int, labels: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of code, leaf) for codes within radius, and the largest frontier; leaves as Gray positions. With labels,
        leaves that have the code's own label are left out."""
        marks = None if labels is None else self.uniform(labels)
        n = len(self.levels[-1][0])
        q, node, acc = np.repeat(np.arange(len(codes)), n), np.tile(np.arange(n), len(codes)), np.zeros(n * len(codes), np.int64)
        peak = 0
        for level in range(len(self.levels) - 1, -1, -1):
            acc = acc + np.bitwise_count((codes[q] ^ self.levels[level][0][node]) & self.own[level][node])
            stay = acc <= radius
            if marks is not None:
                stay &= marks[level][node] != own[q]
            q, node, acc = q[stay], node[stay], acc[stay]
            if level:
                wide = np.minimum(WIDTH, len(self.levels[level - 1][0]) - node * WIDTH)
                start = np.repeat(node * WIDTH - np.cumsum(wide) + wide, wide)
                node = start + np.arange(len(start))
                q, acc = np.repeat(q, wide), np.repeat(acc, wide)
            peak = max(peak, len(q))
        return q, node, peak

    def chunks(self, n: int) -> Iterator[tuple[int, int]]:
        """Ranges of n codes whose searches stay near FRONTIER; send() takes the frontier of the last one."""
        at, size = 0, max(1, FRONTIER // (8 * WIDTH * WIDTH))
        while at < n:
            peak = yield at, min(n, at + size)
            at += size
            size = min(2 * size, 65_536) if (peak or 0) < FRONTIER // 2 else max(1, size // 2)


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels after the classes of a[i] and b[i] have become one; a class is named after its least member."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    for x, y in np.unique(np.stack([labels[a], labels[b]], axis=1), axis=0).tolist():
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    if not parent:
        return labels
    table = np.arange(len(labels))
    for x in parent:
        table[x] = find(x)
    return table[labels]


class Shard:
    """Different codes, their index, and of each (in Gray order) the one that stands for its component among them."""

    def __init__(self, codes: np.ndarray, radius: int = RADIUS):
        self.index, self.radius = GrayIndex(codes), radius
        self.codes, self.labels = self.index.levels[0][0], np.arange(len(codes))
        ranges = self.index.chunks(len(codes))
        span = next(ranges, None)
        while span:
            q = np.arange(*span)
            a, b, peak = self.index.search(self.codes[q], radius, self.labels, self.labels[q])
            self.labels = joined(self.labels, q[a], b)
            span = _advance(ranges, peak)

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges that connect what links within the shard connect."""
        linked = np.flatnonzero(self.labels != np.arange(len(self.labels)))
        return self.codes[linked], self.codes[self.labels[linked]]

    def visit(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An edge for each of these codes and each component that it links with."""
        ends: list[tuple[np.ndarray, np.ndarray]] = [(codes[:0], codes[:0])]
        ranges = self.index.chunks(len(codes))
        span = next(ranges, None)
        while span:
            part = codes[slice(*span)]
            q, leaf, peak = self.index.search(part, self.radius)
            met = np.unique(np.stack([q, self.labels[leaf]], axis=1), axis=0)
            ends.append((part[met[:, 0]], self.codes[met[:, 1]]))
            span = _advance(ranges, peak)
        return tuple(np.concatenate(x) for x in zip(*ends, strict=True))


def _advance(ranges, peak: int):
    try:
        return ranges.send(peak)
    except StopIteration:
        return None


def gray_order(fp: Column) -> Column:
    """The Gray rank as a long that orders as the unsigned number would."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def links(codes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between different fingerprints (column fp) that connect whatever links within radius connect."""
    count = -(-codes.count() // SHARD) or 1
    ranged = codes.repartitionByRange(count, gray_order(F.col("fp"))).select("fp", F.spark_partition_id().alias("shard"))
    ranged = materialize(ranged, "gray-order")
    nodes = ranged.groupBy("shard").agg(F.bit_and("fp").alias("all"), F.bit_or("fp").alias("any")).orderBy("shard").toPandas()  # a row a shard
    names = nodes["shard"].to_numpy(np.int64)
    whole, some = (nodes[c].to_numpy(np.int64).view(np.uint64) for c in ("all", "any"))
    upper = GrayIndex(whole, ~(whole ^ some))
    names = names[upper.order]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To each later shard that a fingerprint may have links in, and, as a member, to its own."""
        for batch in batches:
            fp, home = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield _batch(("shard", home), ("visits", np.zeros(len(fp), bool)), ("fp", fp))
            ranges = upper.chunks(len(fp))
            span = next(ranges, None)
            while span:
                part, own = fp[slice(*span)], home[slice(*span)]
                q, node, peak = upper.search(part.view(np.uint64), radius)
                later = names[node] > own[q]
                yield _batch(("shard", names[node[later]]), ("visits", np.ones(int(later.sum()), bool)), ("fp", part[q[later]]))
                span = _advance(ranges, peak)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shard after shard: members come first, and visitors stream by."""
        now, members, shard = None, [], None

        def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return _batch(("a", a.view(np.int64)), ("b", b.view(np.int64)))

        for batch in batches:
            names, visits, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x == y:
                    continue
                if names[x] != now:
                    if now is not None and shard is None:
                        yield edges(*Shard(np.concatenate(members), radius).forest())
                    now, members, shard = names[x], [], None
                codes, come = fp[x:y].view(np.uint64), visits[x:y]
                members.append(codes[~come])
                if come.any():
                    if shard is None:
                        shard = Shard(np.concatenate(members), radius)
                        yield edges(*shard.forest())
                    yield edges(*shard.visit(codes[come]))
        if now is not None and shard is None:
            yield edges(*Shard(np.concatenate(members), radius).forest())

    routed = ranged.select("fp", F.col("shard").cast("long").alias("shard")).mapInArrow(route, "shard long, visits boolean, fp long")
    return routed.repartition("shard").sortWithinPartitions("shard", "visits").mapInArrow(meet, "a long, b long")


def _batch(*columns: tuple[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for _, x in columns], [name for name, _ in columns])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of these edges; root is the least node that it reaches.

    Large and small stars in turn; each round is written to the shared folder. A hub's rows meet only in sums (least
    neighbour) and in joins, whose large partitions Spark splits.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large")
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(rest.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = 3) -> DataFrame:
    """doc_id, text_hash, fp (long) and component_id, the least doc_id that links reach; one row for each of docs.

    Null or empty text: fingerprint zero, linked like any other. A null doc_id gets its component's least doc_id, or
    null if there is none. Repeated rows come out as often as they went in.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), fingerprints(text_or_empty(), words).alias("fp"))
    own = materialize(own, "fingerprints")
    leads = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("lead")), "leads")
    of = components(links(leads.select("fp"), radius))
    rooted = leads.join(of, leads["fp"] == of["node"], "left").select("fp", "lead", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("lead").alias("component_id"))
    return own.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "text_hash", "fp", "component_id")


def only_leads(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is their component's (found: doc_id, text_hash, component_id), once each."""
    lead, text_hash = fresh(docs, "lead"), fresh(docs, "hash")
    leads = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(lead), F.col("text_hash").alias(text_hash)).distinct()
    stays = docs.join(leads, docs["doc_id"].eqNullSafe(F.col(lead)) & (F.xxhash64(docs["text"]) == F.col(text_hash)), "left_semi")
    return stays.dropDuplicates(["doc_id", "text"])


def keep_one(docs: DataFrame, radius: int = RADIUS, words: int = 5) -> DataFrame:
    """docs without those that are near-duplicates of a document with a smaller doc_id; repeated rows stay once.

    Two different texts under one doc_id both stay if that doc_id is their component's least.
    """
    return only_leads(docs, near_duplicates(docs, radius, words))


def op9(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
