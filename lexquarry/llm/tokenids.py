"""Token ids as binary files: patched frame-of-reference blocks with an index of block starts.

Documents are dealt by ranges of doc_id; each task encodes its range in order and writes it to files of bounded size in
the shared folder. A file is BLOCK ids at a time: the block's least id, the offsets from it packed at the width that a
percentile of them needs, and the few wider ones as a list of exceptions. The footer has where each block starts and
each document's id and length, so any span of ids is read without the blocks before it. A file counts once the manifest
names it, and the manifest is a table that Spark commits: what a lost or repeated task has written is never read.

File, little-endian: MAGIC; blocks (least u32, width u8, zero u8, exceptions u16; BLOCK * width bits in 64-bit words;
places u16 and offsets u32 of the exceptions); footer (documents, ids, blocks u64; block starts u64; doc ids i64;
null flags u8; lengths u64); footer's start u64, its crc32 u32, MAGIC. The last block is filled up with its last id.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.common import materialize, open_stored, shared_dir, stored_at, table, text_or_empty

MAGIC = b"LQTOKPF1"
BLOCK = 1024
#: Offsets up to this percentile of a block are packed; the rest are exceptions.
PERCENTILE = 90
#: A file ends with the document that reaches one of these.
FILE_IDS, FILE_DOCS = 1 << 26, 1 << 20
#: Blocks packed or read at once.
SPAN = 256
#: Words after which a worker begins a new table of ids, beside the one before; words asked of the library as one text; and
#: bytes of text encoded at once.
CACHED, TOGETHER, BATCH_BYTES = 500_000, 250, 4_000_000
END_ID = 1
HEAD, COUNTS, TAIL = struct.Struct("<IBBH"), struct.Struct("<QQQ"), struct.Struct("<QI8s")
MANIFEST = "file string, part int, seq int, n_docs long, n_ids long, n_bytes long"


class WordEncoder:
    """Ids of whole texts as packed little-endian 32-bit integers, as `tokenizers` gives them for a vocabulary whose words
    end at white space.

    Its splits never cross ASCII white space, nor the place between a letter below U+0100 or an ASCII digit and the marks
    in TRAILING after it, and ASCII letters are lower-cased (unless a combining mark or a special token's name comes in between); so
    the library is asked once for each different word. A word of letters below U+0100 is one to it too: these are given
    as one text, and each ends where an id ends a word. The tests hold the ids equal to those of whole texts.
    """

    #: A search goes from mark to mark, as it begins with one.
    TRAILING = re.compile(rb"[.,;:!?#$%&*)](?:(?<=[0-9a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[.,;:!?#$%&*)]*+(?=[ \t\n\x0b\x0c\r]|\Z)")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.before = Tokenizer.from_file(path), {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True

    def split(self, text: bytes) -> list[bytes]:
        if b"<|" in text or b"\xcc" in text or b"\xcd" in text:
            return text.split()
        return self.TRAILING.sub(rb" \g<0>", text.lower()).split()

    def learn(self, new: set[bytes]) -> None:
        whole = [w for w in new if w.isalpha() or (t := w.decode()).isalpha() and max(t) < "Ā"]
        for at in range(0, len(whole), TOGETHER):
            own = whole[at : at + TOGETHER]
            ids = np.asarray(self.tokenizer.encode_batch_fast([b" ".join(own).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            data = ids.tobytes()
            self.known.update((w, data[a:b]) for w, a, b in zip(own, cuts[:-1], cuts[1:], strict=True))
        rest = list(new.difference(whole))
        found = self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
        self.known.update((w, struct.pack(f"<{len(e.ids)}I", *e.ids)) for w, e in zip(rest, found, strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        words = [self.split(t) for t in texts]
        own = set().union(*words)
        if len(new := own - self.known.keys()) + len(self.known) > CACHED:  # words still in use come over from the last table
            self.known, self.before, new = {}, self.known, own
        again = new & self.before.keys()
        self.known.update((w, self.before[w]) for w in again)
        self.learn(new - again)
        return [b"".join(map(self.known.__getitem__, w)) for w in words]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One a worker: the words it knows serve all its tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def squeeze(x: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK numbers below 2**width as rows of 64-bit words."""
    lanes = x.reshape(len(x), -1, 64)
    out = np.zeros((*lanes.shape[:2], width), np.uint64)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        out[..., word] |= lanes[..., i] << np.uint64(shift)
        if shift + width > 64:
            out[..., word + 1] |= lanes[..., i] >> np.uint64(64 - shift)
    return out.reshape(len(x), -1)


def spread(words: np.ndarray, width: int) -> np.ndarray:
    lanes = words.reshape(len(words), BLOCK // 64, width)
    out = np.zeros((*lanes.shape[:2], 64), np.uint64)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        out[..., i] = lanes[..., word] >> np.uint64(shift)
        if shift + width > 64:
            out[..., i] |= lanes[..., word + 1] << np.uint64(64 - shift)
    return out.reshape(len(words), BLOCK) & np.uint64((1 << width) - 1)


def pack_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> list[bytes]:
    """Blocks of ids (unsigned 32-bit); the last one is filled up."""
    rows = np.pad(ids, (0, -len(ids) % BLOCK), "edge").reshape(-1, BLOCK).astype(np.uint64)
    least = rows.min(axis=1)
    rows -= least[:, None]
    k = (BLOCK - 1) * percentile // 100
    widths = np.ceil(np.log2(np.partition(rows, k, axis=1)[:, k].astype(np.float64) + 1)).astype(int)  # exact below 2**32
    wide = rows >= (np.uint64(1) << widths.astype(np.uint64))[:, None]
    out: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        packed = squeeze(np.where(wide[own], np.uint64(0), rows[own]), width)
        for i, words in zip(own.tolist(), packed, strict=True):
            places = np.flatnonzero(wide[i])
            out[i] = HEAD.pack(int(least[i]), width, 0, len(places)) + words.astype("<u8").tobytes() + places.astype("<u2").tobytes() + rows[i][places].astype("<u4").tobytes()
    return out


def unpack_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at these places of data."""
    heads = [HEAD.unpack_from(data, s) for s in starts.tolist()]
    widths = np.array([h[1] for h in heads])
    out = np.empty((len(heads), BLOCK), np.uint64)
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        words = [np.frombuffer(data, "<u8", BLOCK * width // 64, int(starts[i]) + HEAD.size) for i in own]
        out[own] = spread(np.array(words, np.uint64).reshape(len(own), -1), width)
    for row, start, (least, width, _, n) in zip(out, starts.tolist(), heads, strict=True):
        at = start + HEAD.size + BLOCK * width // 8
        row[np.frombuffer(data, "<u2", n, at)] = np.frombuffer(data, "<u4", n, at + 2 * n)
        row += np.uint64(least)
    return out.ravel().astype("<u4")


@dataclass
class FileWriter:
    """One file; memory holds at most SPAN blocks, a document, and the index."""

    stream: object
    starts: list[int] = field(default_factory=list)
    keys: list[int | None] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    waiting: list[bytes] = field(default_factory=list)
    n_waiting: int = 0
    n_ids: int = 0
    at: int = 0

    def __post_init__(self) -> None:
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self.n_waiting >= SPAN * BLOCK:
            self._flush(self.n_waiting // BLOCK * BLOCK)

    def _flush(self, upto: int) -> None:
        data = b"".join(self.waiting)
        self.waiting, self.n_waiting = [data[4 * upto :]], max(0, self.n_waiting - upto)
        for at in range(0, min(4 * upto, len(data)), 4 * SPAN * BLOCK):
            for block in pack_blocks(np.frombuffer(data[at : min(at + 4 * SPAN * BLOCK, 4 * upto)], "<u4")):
                self.starts.append(self.at)
                self._put(block)

    def close(self) -> None:
        if self.n_waiting:
            self._flush(self.n_waiting)
        start = self.at
        keys = np.array([k or 0 for k in self.keys], "<i8").tobytes() + np.array([k is None for k in self.keys], "u1").tobytes()
        footer = COUNTS.pack(len(self.keys), self.n_ids, len(self.starts)) + np.array(self.starts, "<u8").tobytes() + keys + np.array(self.lengths, "<u8").tobytes()
        self._put(footer + TAIL.pack(start, zlib.crc32(footer), MAGIC))
        self.stream.close()


class FileReader:
    """One file by its index: documents, and any span of ids."""

    def __init__(self, path: str):
        self.file = open_stored(path)
        size = self.file.size()
        start, crc, magic = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        footer = self.file.read_at(size - TAIL.size - start, start)
        if magic != MAGIC or zlib.crc32(footer) != crc:
            raise ValueError(f"{path} is no whole file of token ids")
        docs, self.n_ids, blocks = COUNTS.unpack_from(footer)
        at = COUNTS.size
        self.starts = np.append(np.frombuffer(footer, "<u8", blocks, at).astype(np.int64), start)
        self.keys = np.frombuffer(footer, "<i8", docs, at := at + 8 * blocks)
        self.none = np.frombuffer(footer, "u1", docs, at := at + 8 * docs).astype(bool)
        self.lengths = np.frombuffer(footer, "<u8", docs, at + docs).astype(np.int64)

    def ids(self, start: int, n: int) -> np.ndarray:
        """ids[start : start + n], from the blocks that hold them alone."""
        n = min(n, self.n_ids - start)
        if n <= 0:
            return np.zeros(0, "<u4")
        a, b = start // BLOCK, -(-(start + n) // BLOCK)
        data = self.file.read_at(int(self.starts[b] - self.starts[a]), int(self.starts[a]))
        return unpack_blocks(data, self.starts[a:b] - self.starts[a])[start - a * BLOCK :][:n]

    def documents(self) -> Iterator[tuple[int | None, int, int, Iterator[bytes]]]:
        """(doc_id, start, length, its ids by and by) in order; each document's ids are to be read before the next one's."""
        ends = np.cumsum(self.lengths)
        base, held = 0, b""

        def parts(at: int, end: int) -> Iterator[bytes]:
            nonlocal base, held
            while at < end:
                if at >= base + len(held) // 4:
                    base = at // BLOCK * BLOCK
                    held = self.ids(base, SPAN * BLOCK).tobytes()
                part = held[4 * (at - base) : 4 * (end - base)]
                at += len(part) // 4
                yield part

        for key, none, length, end in zip(self.keys.tolist(), self.none.tolist(), self.lengths.tolist(), ends.tolist(), strict=True):
            yield None if none else key, end - length, length, parts(end - length, end)


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID, folder: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes every document's ids, each ended by end_id, in ascending doc_id order, and returns the manifest: MANIFEST and
    `first`, how many ids stand in the files before.

    Null or empty text: end_id alone. Null doc_ids come first. Rows that repeat a doc_id are all written, in the order of
    their texts' hashes. Other columns are not used. An empty table gives no file. folder: where executors can write;
    a new one in the shared folder if not given.
    """
    folder = folder or f"{shared_dir(docs.sparkSession).rstrip('/')}/lexquarry/token-ids-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words, end = TaskContext.get().partitionId(), encoder(tokenizer), np.asarray([end_id], "<u4").tobytes()
        files, place = stored_at(folder)
        writer, rows, name = None, [], ""

        def closed() -> tuple:
            writer.close()
            return f"{folder}/{name}", part, len(rows), len(writer.keys), writer.n_ids, writer.at

        for batch in batches:
            keys, sizes = batch.column("doc_id").to_pylist(), np.cumsum(batch.column("size").to_numpy())
            at = 0
            while at < len(keys):
                upto = at + max(1, int(np.searchsorted(sizes[at:] - (sizes[at - 1] if at else 0), BATCH_BYTES, "right")))
                texts = [t.as_buffer().to_pybytes() for t in batch.column("text")[at:upto]]
                for key, ids in zip(keys[at:upto], words.encode(texts), strict=True):
                    if writer is None:
                        files.create_dir(place, recursive=True)
                        name = f"{uuid.uuid4().hex}.ids"
                        writer = FileWriter(files.open_output_stream(f"{place}/{name}"))
                    writer.add(key, ids + end)
                    if writer.n_ids >= file_ids or len(writer.keys) >= FILE_DOCS:
                        rows.append(closed())
                        writer = None
                at = upto
        if writer:
            rows.append(closed())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 3], strict=True)], [c.split()[0] for c in MANIFEST.split(", ")])

    text = text_or_empty()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.octet_length(text).cast("long").alias("size"), F.xxhash64(text).alias("tie"))
    ranged = own.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    files = materialize(ranged.select("doc_id", "text", "size").mapInArrow(write, MANIFEST), "manifest")
    return _placed(files)


def _placed(files: DataFrame, group: int = 1000) -> DataFrame:
    """Adds `first`, by sums over groups of parts: no task sees all files."""
    grouped = files.withColumn("_group", F.floor(F.col("part") / group))
    sums = grouped.groupBy("_group").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)  # one row for 1000 tasks
    sums = sums.select(F.col("_group").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_group").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = grouped.withColumn("_inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(sums, F.col("_group") == F.col("_of"))
    return placed.select(*files.columns, (F.col("_before") + F.col("_inside")).cast("long").alias("first"))


def read_ids(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """Every document from the files: doc_id, start (ids before it), n_tokens, and ids (packed 32-bit, little-endian), or
    with digest their crc32 in place of them. Files are read one a task at a time, a span of blocks at once."""
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64()} | ({"ids_crc32": pa.int64()} if digest else {"ids": pa.binary()})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True):
                rows, held = [], 0
                for key, start, n, parts in FileReader(path).documents():
                    value = 0 if digest else b"".join(parts)
                    if digest:
                        for part in parts:
                            value = zlib.crc32(part, value)
                    rows.append((key, first + start, n, value))
                    held += 32 if digest else 4 * n
                    if held > BATCH_BYTES:
                        yield frame(rows)
                        rows, held = [], 0
                if rows:
                    yield frame(rows)

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    dealt = manifest.select("file", "first").repartition(max(1, manifest.count()))
    return dealt.mapInArrow(read, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")


def op11(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_ids(write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), digest=True)
