"""Chunks of documents and blocks of numbers, for operators that exchange hashes by the block."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext

SENT = "chunk string, doc_ids array<bigint>, texts binary"


def packed(numbers: np.ndarray) -> bytes:
    """An array of unsigned integers, compressed byte plane by byte plane."""
    return zlib.compress(numbers.view("uint8").reshape(-1, numbers.itemsize).T.tobytes(), 1)


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(zlib.decompress(raw), dtype="uint8").reshape(size, -1).T.copy().view(kind).ravel()


def packed_hashes(hashes: np.ndarray, plain: int) -> bytes:
    """Sorted 64-bit hashes as differences, byte plane by byte plane: the ``plain`` lowest as they are, the others compressed.

    Differences of random hashes are random up to their mean, so compressing the bytes below it takes time and saves nothing.
    """
    planes = np.diff(hashes, prepend=np.uint64(0)).view("uint8").reshape(-1, 8).T.tobytes()
    low = plain * len(hashes)
    return low.to_bytes(8, "little") + planes[:low] + zlib.compress(planes[low:], 1)


def unpacked_hashes(raw: bytes) -> np.ndarray:
    end = 8 + int.from_bytes(raw[:8], "little")
    planes = raw[8:end] + zlib.decompress(raw[end:])
    return np.cumsum(np.frombuffer(planes, dtype="uint8").reshape(8, -1).T.copy().view("uint64").ravel(), dtype="uint64")


def chunked(batches, size: int):
    """(name, doc_ids, texts) of about ``size`` characters each; the same rows give the same chunks."""
    part, n, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
            if held and held + len(text) > size:
                yield f"{part}-{n}", ids, texts
                n, ids, texts, held = n + 1, [], [], 0
            ids.append(None if doc_id is pd.NA else int(doc_id))
            texts.append(text)
            held += len(text) + 1
    if texts:
        yield f"{part}-{n}", ids, texts


def sender(size: int):
    def run(batches):
        for name, ids, texts in chunked(batches, size):
            # lengths first, so that any character may occur in a text
            raw = [t.encode() for t in texts]
            head = np.array([len(raw), *map(len, raw)], dtype="int64").tobytes()
            yield pd.DataFrame({"chunk": [name], "doc_ids": [ids], "texts": [zlib.compress(head + b"".join(raw), 4)]})

    return run


def opened(blob: bytes) -> list[str]:
    raw = zlib.decompress(blob)
    n = int(np.frombuffer(raw, dtype="int64", count=1)[0])
    sizes, at, out = np.frombuffer(raw, dtype="int64", count=n, offset=8), 8 * (n + 1), []
    for s in sizes.tolist():
        out.append(raw[at:at + s].decode())
        at += s
    return out
