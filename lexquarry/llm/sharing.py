"""Which keys (hashes of anchors, or of shingles) more than one owner holds, without a row for each key.

Tasks settle what they can within a group of owners; the rest is sent packed, dealt by hash into buckets of bounded size.
A key that many owners of a group hold goes on as one entry with their number, so that no bucket gets all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

#: kind 0: keys and their owners. 1: keys that several owners of one group hold, and how many do; 2: those owners.
ASKED = "bucket int, kind int, keys binary, owners binary"


def to_bytes(x: np.ndarray, kind: str = "<i8") -> bytes:
    return x.astype(kind, copy=False).tobytes()


def numbers(parts, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def cuts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def batch_of(schema: str, columns) -> pa.RecordBatch:
    names, kinds = zip(*(field.split() for field in schema.split(", ")), strict=True)
    arrow = {"int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def runs(sorted_keys: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = [*cuts(sorted_keys).tolist(), len(sorted_keys)]
    return zip(edges[:-1], edges[1:], strict=True)


def pack(key: np.ndarray, owner: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """ASKED of one group: keys and owners are longs, side by side."""
    order = np.argsort(key, kind="stable")
    h, t = key[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    order, h, t = order[new], h[new], t[new]
    cut = cuts(h)
    if not len(cut):
        return
    count = np.diff(np.append(cut, len(h)))
    several = np.minimum.reduceat(t, cut) != np.maximum.reduceat(t, cut)
    known = np.repeat(several, count)
    if known.any():
        yield -1 - int(h[0]) % buckets, 2, to_bytes(h[known]), to_bytes(t[known])
    alone = np.sort(order[~known])  # in the order given: equal neighbours are sent compressed
    for kind, own, told in ((0, key[alone], owner[alone]), (1, h[cut[several]], count[several])):
        bucket = (own.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
        deal = np.argsort(bucket, kind="stable")
        own, told, bucket = own[deal], told[deal], bucket[deal]
        for x, y in runs(bucket):
            yield int(bucket[x]), kind, to_bytes(own[x:y]), to_bytes(told[x:y])


def settle(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket: owners and keys, side by side, that another owner holds too; and the shared keys with their number
    of owners, as far as they came to this bucket."""
    part = {k: pdf[pdf["kind"] == k] for k in range(3)}
    key = numbers([*part[0]["keys"], *part[1]["keys"]])
    owner, counts = numbers(part[0]["owners"]), numbers(part[1]["owners"])
    owners, keys = [numbers(part[2]["owners"])], [numbers(part[2]["keys"])]
    order = np.argsort(key, kind="stable")
    h, one = key[order], order < len(owner)
    cut = cuts(h)
    if not len(cut):
        return owners[0], keys[0], key, counts
    t = np.concatenate([owner, np.zeros(len(counts), np.int64)])[order]
    n = np.add.reduceat(np.concatenate([np.ones(len(owner), np.int64), counts])[order], cut)
    shared = (np.minimum.reduceat(t, cut) != np.maximum.reduceat(t, cut)) | ~np.logical_and.reduceat(one, cut)
    tell = np.repeat(shared, np.diff(np.append(cut, len(h)))) & one
    return np.concatenate([*owners, t[tell]]), np.concatenate([*keys, h[tell]]), h[cut[shared]], n[shared]
