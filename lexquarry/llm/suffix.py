"""Removal of repeated passages by suffix arrays built by induced sorting.

Every LENGTH-byte string holds an anchor: the leftmost of its SEED-byte substrings of least hash. Which anchors two
different texts share is found first, from packed hashes alone; only the bytes around those go on. They are sharded by
anchor, each shard's suffixes are sorted by induced sorting, and permuted common prefixes of LENGTH bytes join equal
strings, each of which then knows the least document that holds it. An anchor that very many texts hold is spread over
several shards, whose least holders are compared in one more sum. A text that repeats itself (a run of one byte, a short
period) has equal contexts close to each other, which go as one. Texts are told apart by hashes of 128 bits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.llm import sharing
from lexquarry.llm.common import fresh, materialize, shrunk, table, text_or_empty
from lexquarry.llm.sharing import batch_of, numbers, runs, to_bytes

LENGTH = 50
SEED = 16
#: Bytes of text whose anchors meet in one bucket, about, and bytes of context in one shard.
BUCKET_TEXT = 32_000_000
SHARD_BYTES = 2_000_000
#: The contexts of an anchor are dealt over one more shard for each so many texts that hold it.
SALT_TEXTS = 20_000
#: Bytes of text that a task works on at once (or one longer text), and that one pass of hashing takes.
GROUP_BYTES = 8_000_000
PIECE = 1 << 17
#: Low bits of a seed's rank that hold its place in the piece, so that of equal hashes the leftmost is least.
PLACE_BITS = np.uint64(20)
#: Symbols that are compared at once.
WORD = 7
#: Contexts that are cut out, packed or compared at once.
STEP = 20_000

#: Odd multipliers of the hashes (any will do).
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def seed_hashes(data: np.ndarray, size: int = SEED) -> np.ndarray:
    """A 64-bit hash of every size-byte substring, from words of eight bytes that overlap; size is eight at least."""
    n, out = len(data) - size + 1, None
    for at in (*range(0, size - 8, 8), size - 8):
        word = np.ndarray((n,), "<u8", data, offset=at, strides=(1,)) * _MIX[0]
        if out is not None:
            out ^= out >> np.uint64(29)
            out *= _MIX[1]
            word += out
        out = word
    out ^= out >> np.uint64(32)
    out *= _MIX[2]
    out ^= out >> np.uint64(29)
    return out


@dataclass
class Anchored:
    """Runs of windows with a common anchor: first window, bytes that the windows reach over, anchor's place, hash, text."""

    start: np.ndarray
    size: np.ndarray
    place: np.ndarray
    hash: np.ndarray
    owner: np.ndarray


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, seed: int = SEED) -> Iterator[Anchored]:
    """Runs of all windows of length bytes in the texts that stand in data one after the other and stop at ends, for PIECE
    windows at a time."""
    data, width = np.ascontiguousarray(data), length - seed + 1
    whole = np.ones(len(data), bool)  # windows that don't reach into the next text
    across = (ends[:, None] - np.arange(1, length)).ravel()
    whole[across[across >= np.repeat(np.concatenate([[0], ends[:-1]]), length - 1)]] = False
    for at in range(0, len(data) - length + 1, PIECE):
        part = data[at : at + PIECE + length - 1]
        h = seed_hashes(part, seed)
        low, reach = h >> PLACE_BITS << PLACE_BITS | np.arange(len(h), dtype=np.uint64), 1
        while 2 * reach <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < width:
            low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
        own = whole[at : at + len(low)]
        first = own.copy()
        first[1:] &= (low[1:] != low[:-1]) | ~own[:-1]
        last = own.copy()
        last[:-1] &= (low[1:] != low[:-1]) | ~own[1:]
        begin = np.flatnonzero(first)
        place = (low[begin] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
        if len(begin):
            yield Anchored(begin + at, np.flatnonzero(last) - begin + length, place + at, h[place], np.searchsorted(ends, begin + at, "right"))


def repeated(data: np.ndarray, found: Anchored, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, reach): which contexts to keep, and how far behind each its last equal one starts. Those between are equal to
    it too, with the same anchor of the same text, and none is more than length bytes behind the one before: whatever string
    of length bytes goes in one goes in all, and what goes has no gaps."""
    order = np.lexsort((found.start, found.hash, found.owner))
    start, size, lead = found.start[order], found.size[order], (found.place - found.start)[order]
    same = np.zeros(len(order), bool)
    same[1:] = (found.owner[order[1:]] == found.owner[order[:-1]]) & (found.hash[order[1:]] == found.hash[order[:-1]])
    same[1:] &= (size[1:] == size[:-1]) & (lead[1:] == lead[:-1]) & (start[1:] - start[:-1] <= length)
    like = np.flatnonzero(same)
    for at in range(0, len(like), STEP):
        i = like[at : at + STEP]
        upto = np.cumsum(size[i])
        inside = np.arange(upto[-1]) - np.repeat(upto - size[i], size[i])
        equal = data[np.repeat(start[i], size[i]) + inside] == data[np.repeat(start[i - 1], size[i]) + inside]
        same[i] = np.logical_and.reduceat(equal, upto - size[i])
    first = np.flatnonzero(~same)
    last = np.append(first[1:], len(order)) - 1
    return order[first], start[last] - start[first]


def _runs(where: np.ndarray, chars: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(char, positions) with the order of positions kept."""
    order = np.argsort(chars.astype(np.uint16), kind="stable")
    where, chars = where[order], chars[order]
    cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    for c, part in zip(chars[np.concatenate([[0], cuts])].tolist(), np.split(where, cuts), strict=True):
        yield c, part


def _induce(s: np.ndarray, is_s: np.ndarray, seeds: list[list[np.ndarray]], sigma: int) -> np.ndarray:
    """All suffixes in the order that the given ones (by first symbol, each list in order) induce.

    A bucket is worked through a run at a time: larger (L) suffixes from the left, then smaller (S) ones from the right.
    """
    larger: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    for c in range(sigma):
        done = 0
        if len(larger[c]) > 1:
            larger[c] = [np.concatenate(larger[c])]
        while done < len(larger[c]):
            part = larger[c][done]
            done += 1
            before = part[part > 0] - 1
            before = before[~is_s[before]]
            if len(before):
                for d, run in _runs(before, s[before]):
                    larger[d].append(run)
        for part in seeds[c]:
            before = part[part > 0] - 1
            before = before[~is_s[before]]
            if len(before):
                for d, run in _runs(before, s[before]):
                    larger[d].append(run)
    smaller: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    end = len(s) - 1
    smaller[s[end]].append(np.array([end]))
    for c in range(sigma - 1, -1, -1):
        done = 0
        if len(smaller[c]) > 1:
            smaller[c] = [np.concatenate(smaller[c])]
        while done < len(smaller[c]):
            part = smaller[c][done]
            done += 1
            before = part[part > 0] - 1
            before = before[is_s[before]]
            if len(before):
                for d, run in _runs(before, s[before]):
                    smaller[d].append(run)
        for part in reversed(larger[c]):
            before = part[::-1]
            before = before[before > 0] - 1
            before = before[is_s[before]]
            if len(before):
                for d, run in _runs(before, s[before]):
                    smaller[d].append(run)
    out = []
    for c in range(sigma):
        out += larger[c]
        out += [p[::-1] for p in reversed(smaller[c])]
    return np.concatenate(out)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of s in order. s is of small non-negative integers, and ends in the only 0.

    Leftmost-smaller substrings are sorted by inducing and named. Where names repeat, the reduced string is sorted in
    turn: its alphabet is too large for buckets, so by doubling ranks. One more inducing pass gives the whole order.
    """
    n, sigma = len(s), int(s.max()) + 1
    step = np.sign(np.diff(s.astype(np.int64)))
    # Equal neighbours have the type of the next difference.
    nearest = np.where(step != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1] if n > 1 else nearest
    is_s = np.ones(n, bool)
    if n > 1:
        is_s[:-1] = np.where(nearest < n, step[np.minimum(nearest, n - 2)] > 0, False)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms) < 2:
        seeds: list[list[np.ndarray]] = [[] for _ in range(sigma)]
        for p in lms:
            seeds[s[p]].append(np.array([p]))
        return _induce(s, is_s, seeds, sigma)

    def seeded(order: np.ndarray) -> list[list[np.ndarray]]:
        out: list[list[np.ndarray]] = [[] for _ in range(sigma)]
        for c, run in _runs(order, s[order]):
            out[c].append(run)
        return out

    rough = _induce(s, is_s, seeded(lms), sigma)
    marked = np.zeros(n, bool)
    marked[lms] = True
    rough = rough[marked[rough]]
    size = np.zeros(n, np.int64)
    size[lms] = np.diff(np.append(lms, n - 1))
    a, b = rough[:-1], rough[1:]
    same = size[a] == size[b]
    left, j = np.flatnonzero(same), 0
    while len(left):
        differ = s[np.minimum(a[left] + j, n - 1)] != s[np.minimum(b[left] + j, n - 1)]
        same[left[differ]] = False
        left = left[~differ & (size[a[left]] > j)]
        j += 1
    names = np.zeros(n, np.int64)
    names[rough] = np.concatenate([[0], np.cumsum(~same)])
    reduced = names[lms]
    rank, reach = reduced, 1
    while rank.max() + 1 < len(rank):
        behind = np.concatenate([rank[reach:] + 1, np.zeros(min(reach, len(rank)), np.int64)])[: len(rank)]
        _, rank = np.unique(rank * (len(rank) + 1) + behind, return_inverse=True)
        reach *= 2
    order = np.empty(len(lms), np.int64)
    order[rank] = lms
    return _induce(s, is_s, seeded(order), sigma)


def common_prefixes(s: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """Permuted common prefixes: for each position the length, up to cap, that its suffix shares with the one before it in sa."""
    n, phi, out = len(s), np.full(len(s), -1), np.zeros(len(s), np.int64)
    phi[sa[1:]] = sa[:-1]
    # WORD symbols (of 9 bits) at a time, and then one at a time; the only 0 ends every match.
    long = np.concatenate([s, np.zeros(cap + WORD, s.dtype)]).astype(np.uint64)
    words = np.zeros(n + cap, np.uint64)
    for k in range(WORD):
        words = words << np.uint64(9) | long[k : k + n + cap]
    left = np.flatnonzero(phi >= 0)
    rest, reach = [], 0
    while reach + WORD <= cap and len(left):
        same = words[left + reach] == words[phi[left] + reach]
        rest.append(left[~same])
        left, reach = left[same], reach + WORD
        out[left] = reach
    left = np.concatenate([*rest, left])
    while len(left):
        left = left[out[left] < cap]
        left = left[long[left + out[left]] == long[phi[left] + out[left]]]
        out[left] += 1
    return out


def least_holders(contexts: list[bytes], docs: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context and each string of length bytes in it, the least of docs over the contexts that hold the string."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    s = np.zeros(int(sizes.sum()) + len(contexts) + 1, np.int16)
    owner = np.zeros(len(s), np.int64)
    body = np.frombuffer(b"\0".join(contexts), np.uint8).astype(np.int16) + 2
    s[: len(body)] = body
    s[starts + sizes] = 1
    owner[: len(s) - 1] = np.repeat(np.arange(len(contexts)), sizes + 1)
    sa = suffix_array(s)
    shared = common_prefixes(s, sa, length)[sa] >= length
    group = np.flatnonzero(~shared)
    least = np.minimum.reduceat(docs[owner[sa]], group)
    by_place = np.empty(len(s), np.int64)
    by_place[sa] = np.repeat(least, np.diff(np.append(group, len(sa))))
    return [by_place[a : a + max(0, n - length + 1)] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def text_groups(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of that many bytes at most, or of one row."""
    at = 0
    while at < len(sizes):
        upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, "right")))
        yield at, upto
        at = upto


def once(found: Anchored) -> np.ndarray:
    """Where each anchor of a text is met first, in the order given."""
    order = np.lexsort((found.hash, found.owner))
    new = np.ones(len(order), bool)
    new[1:] = (found.hash[order[1:]] != found.hash[order[:-1]]) | (found.owner[order[1:]] != found.owner[order[:-1]])
    return np.sort(order[new])


TOLD = "text long, anchor long, salts int"


def asked_anchors(docs: DataFrame, buckets: int, length: int, seed: int) -> DataFrame:
    """The anchors of docs (text, t1), packed by bucket."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            _, offsets, values = column.buffers()
            bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            data, ids = np.frombuffer(values or b"", np.uint8), batch.column(1).to_numpy()
            for a, b in text_groups(np.diff(bounds), GROUP_BYTES):
                # A text's anchor once a piece: many of a text that repeats itself.
                parts = [(f.hash[one], f.owner[one]) for f in anchors(data[bounds[a] : bounds[b]], bounds[a + 1 : b + 1] - bounds[a], length, seed) for one in (once(f),)]
                if not parts:
                    continue
                hashes, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
                rows = list(sharing.pack(hashes.view(np.int64), ids[a:b][owner], buckets))
                if rows:
                    yield batch_of(sharing.ASKED, zip(*rows, strict=True))

    return docs.select("text", "t1").mapInArrow(emit, sharing.ASKED)


def shared_anchors(docs: DataFrame, buckets: int, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """TOLD: a row for each anchor of a text (by its hash t1) that a different text holds too. Rows with salts above 0
    are of anchors, not texts: over so many shards their contexts are dealt."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        text, anchor, shared, n = sharing.settle(pdf)
        hot = n > SALT_TEXTS
        salts = np.concatenate([np.zeros(len(text), np.int64), -(-n[hot] // SALT_TEXTS)])
        return pd.DataFrame({"text": np.concatenate([text, np.zeros(int(hot.sum()), np.int64)]), "anchor": np.concatenate([anchor, shared[hot]]), "salts": salts.astype(np.int32)})

    return asked_anchors(docs, buckets, length, seed).groupBy("bucket").applyInPandas(settle, TOLD)


#: A group's contexts for one shard: document, text hash, start in the text, how far behind it an equal one starts, size,
#: anchor's place, salts, and the bytes.
CONTEXTS = "shard int, n int, packed binary"
_FIELDS = (("doc_id", "<i8"), ("t1", "<i8"), ("start", "<i4"), ("reach", "<i4"), ("size", "u1"), ("lead", "u1"), ("split", "u1"))


def contexts(texts: DataFrame, shards: int, length: int, seed: int) -> DataFrame:
    """CONTEXTS of texts: doc_id, t1, packed (the text), and found, the anchors of the text that others share."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            doc_ids, ids, packed, lists = (batch.column(c) for c in ("doc_id", "t1", "packed", "found"))
            doc_ids, ids, bounds = doc_ids.to_numpy(), ids.to_numpy(), lists.offsets.to_numpy()
            inner = lists.values
            anchor, salts = inner.field(0).to_numpy(), inner.field(1).to_numpy()
            sizes = np.array([zstandard.frame_content_size(packed[i].as_py()) for i in range(len(packed))], np.int64)
            for a, b in text_groups(sizes, GROUP_BYTES):
                data = np.frombuffer(b"".join(unpack.decompress(packed[i].as_py()) for i in range(a, b)), np.uint8)
                ends = np.cumsum(sizes[a:b])
                asked = keyed(anchor[bounds[a] : bounds[b]], np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1])))
                order = np.argsort(asked)
                asked, many = asked[order], salts[bounds[a] : bounds[b]][order].astype(np.int64)
                hits = []
                for at in anchors(data, ends, length, seed):
                    own = keyed(at.hash.view(np.int64), at.owner)
                    where = np.minimum(np.searchsorted(asked, own), len(asked) - 1)
                    hit = np.flatnonzero(asked[where] == own)
                    if len(hit):
                        at, n = Anchored(at.start[hit], at.size[hit], at.place[hit], at.hash[hit], at.owner[hit]), many[where[hit]]
                        one, reach = repeated(data, at, length)
                        hits.append((at.start[one], at.size[one], at.place[one], at.hash[one], at.owner[one], n[one], reach))
                if not hits:
                    continue
                start, size, place, hashes, owner, n, reach = (np.concatenate(x) for x in zip(*hits, strict=True))
                text = ids[a:b][owner]
                salt = np.where(n > 1, (text.view(np.uint64) % n.astype(np.uint64)).astype(np.int64), 0)
                shard = (mixed(hashes + salt.astype(np.uint64)) % np.uint64(shards)).astype(np.int32)
                fields = (doc_ids[a:b][owner], text, start - (ends - sizes[a:b])[owner], reach, size, place - start, n > 1)
                yield from rows(shard, fields, data, start, size)

    def rows(shard, fields, data, start, size) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((start, shard))
        shard, start, size = shard[order], start[order], size[order]
        fields = [f[order] for f in fields]
        pack, out = zstandard.ZstdCompressor(1), ([], [], [])
        for x, y in ((at, min(at + STEP, y)) for x, y in runs(shard) for at in range(x, y, STEP)):
            upto = np.cumsum(size[x:y])
            body = data[np.repeat(start[x:y] - upto + size[x:y], size[x:y]) + np.arange(upto[-1])]
            blob = b"".join([*(to_bytes(f[x:y], k) for f, (_, k) in zip(fields, _FIELDS, strict=True)), body.tobytes()])
            for column, value in zip(out, (int(shard[x]), y - x, pack.compress(blob)), strict=True):
                column.append(value)
        yield batch_of(CONTEXTS, out)

    def keyed(anchor: np.ndarray, row: np.ndarray) -> np.ndarray:
        return anchor.view(np.uint64) ^ mixed(row.astype(np.uint64) + np.uint64(1))

    return texts.select("doc_id", "t1", "packed", "found").mapInArrow(emit, CONTEXTS)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def kin(context: list[bytes], lead: list[int], length: int, seed: int) -> np.ndarray:
    """Which contexts may share a string with another: half of a string's other bytes stand on one side of its anchor,
    so the anchor and the bytes next to it on that side must be shared."""
    half = -(-(length - seed) // 2)
    left = [c[a - half : a + seed] if a >= half else None for c, a in zip(context, lead, strict=True)]
    right = [c[a : a + seed + half] if len(c) >= a + seed + half else None for c, a in zip(context, lead, strict=True)]
    lefts, rights = Counter(left), Counter(right)
    return np.flatnonzero([(x is not None and lefts[x] > 1) or (y is not None and rights[y] > 1) for x, y in zip(left, right, strict=True)])


#: Bytes a to b of a document: sure to go, or, if not sure, only if a smaller document also tells of the string g1, g2.
FOUND = "g1 long, g2 long, sure boolean, doc_id long, t1 long, a int, b int"


def shard_spans(pdf: pd.DataFrame, length: int, seed: int) -> pd.DataFrame:
    """FOUND of one shard's CONTEXTS."""
    parts: dict[str, list[bytes]] = {name: [] for name, _ in _FIELDS}
    bodies = []
    for n, packed in zip(pdf["n"].tolist(), pdf["packed"], strict=True):
        blob, at = zstandard.decompress(packed), 0
        for name, kind in _FIELDS:
            wide = n * np.dtype(kind).itemsize
            parts[name].append(blob[at : at + wide])
            at += wide
        bodies.append(blob[at:])
    f = {name: numbers(parts[name], kind).astype(np.int64) for name, kind in _FIELDS}
    body, upto = b"".join(bodies), np.cumsum(f["size"])
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(body[e - s : e], len(number)) for s, e in zip(f["size"].tolist(), upto.tolist(), strict=True)], np.int64)
    distinct, first = list(number), np.unique(which, return_index=True)[1]
    holders = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(holders, which, f["doc_id"])
    several = kin(distinct, f["lead"][first].tolist(), length, seed)
    least = dict(zip(several.tolist(), least_holders([distinct[i] for i in several], holders[several], length) if len(several) else [], strict=True))
    own = f["doc_id"] == holders[which]
    rest = np.flatnonzero(~own)  # equal contexts in larger documents go as a whole
    out = [(f["doc_id"][rest], f["t1"][rest], f["start"][rest], f["start"][rest] + f["reach"][rest] + f["size"][rest], f["doc_id"][rest], f["t1"][rest], np.ones(len(rest), bool))]
    lasting: list[tuple] = []
    for e in np.flatnonzero(own).tolist():
        i, doc_id, t1, start = which[e], int(f["doc_id"][e]), int(f["t1"][e]), int(f["start"][e])
        end = start + int(f["reach"][e])
        gone = least[i] < doc_id if i in least else np.zeros(len(distinct[i]) - length + 1, bool)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
        lasting += [(doc_id, t1, start + a, end + b + length - 1, doc_id, t1, True) for a, b in edges.reshape(-1, 2).tolist()]
        if f["split"][e]:  # other shards have texts with this anchor
            for j in np.flatnonzero(~gone).tolist():
                d = xxhash.xxh128_digest(distinct[i][j : j + length])
                lasting.append((doc_id, t1, start + j, end + j + length, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), False))
    if lasting:
        out.append(tuple(np.array(x) for x in zip(*lasting, strict=True)))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)]
    return pd.DataFrame(dict(zip(("doc_id", "t1", "a", "b", "g1", "g2", "sure"), columns, strict=True)))[["g1", "g2", "sure", "doc_id", "t1", "a", "b"]]


def spans(found: DataFrame) -> DataFrame:
    """doc_id, t1 and spans, the bytes that go (they may overlap), from FOUND. A string's group has a row for each shard."""
    span = F.struct("a", "b").alias("span")
    grouped = found.groupBy("g1", "g2", "sure").agg(F.min("doc_id").alias("least"), F.collect_list(F.struct("doc_id", "t1", span)).alias("x"))
    whole = F.array(F.struct(F.col("x")[0]["doc_id"].alias("doc_id"), F.col("x")[0]["t1"].alias("t1"), F.col("x.span").alias("spans")))
    each = F.transform(F.filter("x", lambda r: r["doc_id"] > F.col("least")), lambda r: F.struct(r["doc_id"].alias("doc_id"), r["t1"].alias("t1"), F.array(r["span"]).alias("spans")))
    by_doc = grouped.select(F.inline(F.when(F.col("sure"), whole).otherwise(each)))
    return by_doc.groupBy("doc_id", "t1").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")]


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """docs and a struct `cut` (renamed if taken): kept (binary, the bytes that stay), n_bytes, n_removed, n_spans, spans
    (what went).

    A byte goes if it is in a string of length bytes that also starts in a document with a smaller doc_id. Strings are
    those of the input. Null or empty text: nothing to remove. A row that repeats another, doc_id and text, is treated
    like it. Different texts under one doc_id are judged each by itself, against smaller doc_ids only. Rows without
    doc_id are left alone and do not count.
    """
    own = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    ids = materialize(own.select("doc_id", *text_key(F.col("text")), F.octet_length("text").alias("size")).distinct(), "texts")
    leads = ids.groupBy("t1", "t2").agg(F.min("doc_id").alias("lead"))
    size = ids.agg(F.sum("size")).first()[0] or 0
    # Where t1 is the same for different texts, t2 tells them apart as owners of anchors.
    twice = materialize(leads.groupBy("t1").agg(F.count("*").alias("n")).where("n > 1").select(F.col("t1").alias("again")), "equal-hashes")
    leads = leads.join(twice, leads["t1"] == twice["again"], "left").select("t1", "t2", "lead", F.when(F.col("again").isNotNull(), F.col("t2")).otherwise(F.col("t1")).alias("owner"))
    owned = own.select("text", *text_key(F.col("text")))
    owned = owned.join(twice, owned["t1"] == twice["again"], "left").select("text", F.when(F.col("again").isNotNull(), F.col("t2")).otherwise(F.col("t1")).alias("t1"))
    told = materialize(shared_anchors(owned, -(-size // BUCKET_TEXT) or 1, length, seed), "shared-anchors")
    # Written by itself, so that Spark knows its size when it chooses the join.
    spread = materialize(told.where("salts > 0").select("anchor", F.col("salts").alias("many")).coalesce(1), "salts")
    dealt = told.where("salts = 0").join(spread, "anchor", "left").select("text", F.struct("anchor", F.coalesce("many", F.lit(1)).alias("salts")).alias("one"))
    found = dealt.groupBy("text").agg(F.collect_list("one").alias("found"))

    # Texts are dealt by document once, compressed, for both joins. Rows without doc_id get a hash that none of the others has.
    name = {c: fresh(docs, c) for c in ("key", "hash", "packed")}
    text, missing = text_or_empty(), F.col("doc_id").isNull()
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(name["key"])
    hashed = F.when(missing, F.xxhash64(F.lit("none"), text)).otherwise(text_key(text)[0]).alias(name["hash"])
    base = docs.select("*", key, hashed, shrunk(text).alias(name["packed"]))
    wanted = leads.join(found, leads["owner"] == found["text"]).select("lead", "t1", "found")
    texts = base.join(wanted, (F.col(name["key"]) == wanted["lead"]) & (F.col(name["hash"]) == wanted["t1"]))
    # The same columns of base as in the last join, where only doc_id is asked for, so that one exchange serves both.
    texts = texts.select(base["doc_id"].cast("long").alias("doc_id"), wanted["t1"], base[name["packed"]].alias("packed"), wanted["found"])
    shards = max(1, -(-told.count() * (3 * length // 2) // SHARD_BYTES))
    in_shards = contexts(texts, shards, length, seed).groupBy("shard").applyInPandas(lambda pdf: shard_spans(pdf, length, seed), FOUND)
    copies = ids.join(leads, ["t1", "t2"]).where("lead < doc_id").select("doc_id", "t1", F.lit(True).alias("whole"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))
    gone = spans(in_shards).select("doc_id", "t1", F.lit(False).alias("whole"), "spans").unionByName(copies)

    @F.pandas_udf("kept binary, n_bytes long, n_removed long, n_spans long, spans array<struct<a:long,b:long>>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, wholes, lists in batches:
            rows = []
            for packed, whole, spans in zip(texts, wholes, lists, strict=True):
                data, merged = zstandard.decompress(packed), []
                if whole and len(data) >= length:
                    merged = [(0, len(data))]
                elif spans is not None:
                    for a, b in sorted((s["a"], s["b"]) for s in spans):
                        if merged and a <= merged[-1][1]:
                            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                        else:
                            merged.append((a, b))
                edges = [0, *(x for span in merged for x in span), len(data)]
                kept = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                rows.append((kept, len(data), len(data) - len(kept), len(merged), [{"a": a, "b": b} for a, b in merged]))
            yield pd.DataFrame(rows, columns=["kept", "n_bytes", "n_removed", "n_spans", "spans"])

    joined = base.join(gone.select(*(F.col(c).alias(f"gone_{c}") for c in gone.columns)), (F.col(name["key"]) == F.col("gone_doc_id")) & (F.col(name["hash"]) == F.col("gone_t1")), "left")
    done = fresh(docs, "cut") if "cut" in {c.lower() for c in docs.columns} else "cut"
    return joined.select(*(base[c] for c in docs.columns), cut(base[name["packed"]], F.coalesce("gone_whole", F.lit(False)), F.col("gone_spans")).alias(done))


def op10(spark, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", *(F.col("cut")[c].alias(c) for c in ("n_bytes", "n_removed", "n_spans")), F.sha2(F.col("cut")["kept"], 256).alias("kept_sha256"))
