"""Suffix-array dedup: bytes of repeated ``LENGTH``-byte strings, by prefix doubling in bounded units.

Which texts can hold the same string is found first, without losing any:
every window of ``LENGTH`` bytes picks its least ``SEED``-byte gram (by hash;
all of them if several are equal), so equal windows pick the same gram at the
same place.  Chunks of documents send the hashes of picked grams and of their
surroundings (all windows that hold the gram) to buckets by gram hash.  A gram
that occurs once decides that its windows are unique, surroundings that occur
twice that theirs all repeat.  What is left are surroundings that share a gram
but not everything; one of each kind sends its bytes to the gram's bucket.

There the places of the surroundings are put in order by prefix doubling: a
step distributes all places of the unit by the symbols that stand before them,
stably, so that their order becomes right for prefixes of twice the length, and
marks where neighbours differ.  (The surroundings are first ordered in shards,
but that order does not change the result: the shards' Burrows-Wheeler
transforms are not merged.)  Symbols are single bytes
in the first step and the classes found so far in later ones, so eight steps
reach 200 bytes.  No step compares suffixes.  The marks are common prefixes:
between two of them at depth ``LENGTH`` lies a repeated interval.

Grams with more than ``MANY`` different surroundings do not meet in one task:
their chunks send the hashes of the windows themselves, distinct within a
chunk, and get back which of them occur elsewhere.  So a passage in a third of
all documents, or a third of all documents being copies, makes no task larger.

Grams, surroundings and, for such frequent grams, windows are told apart by
64-bit hashes.  Null text counts as empty; a long text is a
chunk of its own.  Every row is a document of its own,
matches never cross rows, and every row gives a row.  An empty table gives an
empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.blocks import SENT, chunked, opened, packed, sender, unpacked
from ledgerlens.llm.common import Scratch, pick

LENGTH = 200
SEED = 160
MANY = 200
CHUNK = 3_000_000
BUCKET = 800_000
UNIT = 60_000
BLOCK = 100_000
#: kind 0: grams and surroundings; 1: bytes of surroundings; 2: windows of frequent grams.
ASKED = "chunk string, kind int, bucket int, hashes binary, body binary"
TOLD = "chunk string, kind int, bucket int, body binary"
KEPT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
#: What a chunk is told of a gram with its surroundings (sums of these).
REPEATED, SEND, SEND_WINDOWS = 1, 2, 4
LAST = np.uint64(2**64 - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each place on (places near the end are left out)."""
    have, n, out, at = mixed(data.astype("uint64") + np.uint64(0x1234567)), 1, None, 0
    while True:
        if size & n:  # append the next n bytes to those gathered so far
            if out is None:
                out = have
            else:
                m = len(have) - at
                out = mixed(out[:m] * np.uint64(0xD6E8FEB86659FD93) + have[at:])
            at += n
            if at == size:
                return out[:max(0, len(data) - size + 1)]
        have = mixed(have[:len(have) - n] * np.uint64(0xC2B2AE3D27D4EB4F) + have[n:]) if len(have) > n else have[:0]
        n *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(x) - width + 1
    rows = np.concatenate([x, np.full(-len(x) % width, LAST)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def picks(data: np.ndarray, sizes: np.ndarray, length: int, seed: int):
    """Places of the picked grams of some documents, their surroundings [a, b), and hashes of both."""
    if len(data) < length:
        return [np.empty(0, dtype="int64")] * 3 + [np.empty(0, dtype="uint64")] * 2
    width, ends = length - seed + 1, np.cumsum(sizes)
    with np.errstate(over="ignore"):
        gram = grams(data, seed)
        least = sliding_min(gram, width)
        whole = np.arange(len(least)) + length <= np.repeat(ends, sizes)[:len(least)]
        # of the windows that hold a gram, the one with the largest least gram
        high = np.concatenate([np.full(width - 1, LAST), np.where(whole, LAST - least, LAST), np.full(width - 1, LAST)])
        high = LAST - sliding_min(high, width)
        places = np.flatnonzero((gram == high[:len(gram)]) & (high[:len(gram)] > 0))
        own = np.searchsorted(ends, places, side="right")
        a = np.maximum((ends - sizes)[own], places - (width - 1))
        b = np.minimum(ends[own], places + length)
        around = mixed(gram[a] * np.uint64(3) + mixed(gram[b - seed] + (b - places).astype("uint64")))
        around = mixed(around + (places - a).astype("uint64") * np.uint64(0x9FB21C651E98DF25))
        # least hashes are small ones: mixed again, they spread over the buckets
        return places, a, b, mixed(gram[places] * np.uint64(0xBF58476D1CE4E5B9)), around


class Picked:
    """The picked grams of a chunk and their surroundings [a, b), distinct pairs in order."""

    def __init__(self, texts: list[str], length: int, seed: int):
        raws = [t.encode() for t in texts]
        self.raw, self.length = b"".join(raws), length
        self.sizes = np.array([len(r) for r in raws], dtype="int64")
        del raws
        parts = []
        for begin, end, sizes in self.blocks():
            place, a, b, key, around = picks(np.frombuffer(self.raw, "uint8", end - begin, begin) if end > begin else np.empty(0, "uint8"), sizes, length, seed)
            parts.append((a + begin, b + begin, key, around))
        self.a, self.b, keys, around = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((around, keys))
        keys, around = keys[order], around[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (around[1:] != around[:-1])
        self.keys, self.around = keys[new], around[new]
        self.first = order[new]
        self.pair = np.empty(len(order), dtype="int64")
        self.pair[order] = np.cumsum(new) - 1
        self.counts = np.bincount(self.pair, minlength=len(self.keys))

    def blocks(self):
        """(begin, end, sizes) of runs of documents that are worked on at once, so that the arrays stay in the cache."""
        ends = np.cumsum(self.sizes)
        i, begin = 0, 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, begin + BLOCK, side="right")))
            yield begin, int(ends[j - 1]), self.sizes[i:j]
            i, begin = j, int(ends[j - 1])

    def slices(self, keys: np.ndarray, buckets: int):
        bounds = np.array([(b + 1) * 2**64 // buckets for b in range(buckets - 1)], dtype="uint64")
        begin = 0
        for b, end in enumerate([*np.searchsorted(keys, bounds).tolist(), len(keys)]):
            if end > begin:
                yield b, begin, end
            begin = end

    def codes(self, told: pd.DataFrame) -> np.ndarray:
        """What the buckets said of each pair."""
        parts = [unpacked(x, "uint8") for x in told[told["kind"] == 0].sort_values("bucket")["body"]]
        out = np.concatenate(parts) if parts else np.empty(0, dtype="uint8")
        if len(out) != len(self.keys):
            raise ValueError("a chunk and what it was told differ")
        return out

    def frequent_windows(self, codes: np.ndarray):
        """Starts and hashes (sorted by hash) of the windows around frequent grams."""
        at = self.first[(codes & SEND_WINDOWS) > 0]
        n = self.b[at] - self.length - self.a[at] + 1
        starts = np.unique(np.repeat(self.a[at] - (np.cumsum(n) - n), n) + np.arange(n.sum()))
        if not len(starts):
            return starts, np.empty(0, dtype="uint64")
        hashes = np.empty(len(starts), dtype="uint64")
        for begin, end, _ in self.blocks():
            i, j = np.searchsorted(starts, [begin, end])
            if j > i:
                with np.errstate(over="ignore"):
                    hashes[i:j] = grams(np.frombuffer(self.raw, "uint8", end - begin, begin), self.length)[starts[i:j] - begin]
        order = np.argsort(hashes, kind="stable")
        return starts[order], hashes[order]


def first_asker(chunk: int, buckets: int, length: int, seed: int):
    def run(batches):
        for name, _, texts in chunked(batches, chunk):
            x = Picked(texts, length, seed)
            rows = []
            for b, i, j in x.slices(x.keys, buckets):
                body = np.concatenate([x.around[i:j], x.counts[i:j].astype("uint64")])
                rows.append((name, 0, b, packed(np.diff(x.keys[i:j], prepend=np.uint64(0))), packed(body)))
            yield pd.DataFrame(rows, columns=["chunk", "kind", "bucket", "hashes", "body"])

    return run


def judged(many: int):
    """What a bucket of grams tells each chunk of its pairs."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        with np.errstate(over="ignore"):
            keys = [np.cumsum(unpacked(h, "uint64"), dtype="uint64") for h in rows["hashes"]]
        bodies = [unpacked(b, "uint64") for b in rows["body"]]
        sizes = [len(k) for k in keys]
        keys = np.concatenate(keys)
        around = np.concatenate([b[:n] for b, n in zip(bodies, sizes)])
        counts = np.concatenate([b[n:] for b, n in zip(bodies, sizes)]).astype("int64")
        order = np.lexsort((around, keys))
        k, a = keys[order], around[order]
        new_key = np.ones(len(k), dtype=bool)
        new_key[1:] = k[1:] != k[:-1]
        new_pair = new_key.copy()
        new_pair[1:] |= a[1:] != a[:-1]
        pair, key = np.cumsum(new_pair) - 1, np.cumsum(new_key) - 1
        total = np.bincount(pair, weights=counts[order])[pair]
        kinds = np.bincount(key[new_pair])[key]
        send = new_pair & (kinds > 1)  # the first of equal surroundings stands for them
        code = np.where(total > 1, REPEATED, 0) + np.where(send, np.where(kinds > many, SEND_WINDOWS, SEND), 0)
        out = np.empty(len(k), dtype="uint8")
        out[order] = code
        parts = np.split(out, np.cumsum(sizes)[:-1])
        return pd.DataFrame({"chunk": rows["chunk"], "kind": 0, "bucket": rows["bucket"], "body": [packed(p) for p in parts]})

    return run


def second_asker(buckets: int, length: int, seed: int):
    """A chunk's bytes of surroundings, and its hashes of windows around frequent grams."""

    def run(sent: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        x = Picked(opened(sent["texts"].iloc[0]), length, seed)
        codes, name, rows = x.codes(told), sent["chunk"].iloc[0], []
        chosen = np.flatnonzero(codes & SEND)
        for b, i, j in x.slices(x.keys[chosen], buckets):
            at = x.first[chosen[i:j]]
            a, e = x.a[at], x.b[at]
            body = np.concatenate([a, e - a]).astype("int64").tobytes() + b"".join(x.raw[s:t] for s, t in zip(a.tolist(), e.tolist()))
            rows.append((name, 1, b, packed(x.keys[chosen[i:j]]), zlib.compress(body, 6)))
        _, hashes = x.frequent_windows(codes)
        for b, i, j in x.slices(hashes, buckets):
            rows.append((name, 2, b, packed(np.diff(hashes[i:j], prepend=np.uint64(0))), b""))
        return pd.DataFrame(rows, columns=["chunk", "kind", "bucket", "hashes", "body"])

    return run


def refined(order: np.ndarray, classes: np.ndarray, shift: int, left: np.ndarray):
    """The order and the classes of places for prefixes of depth + shift, from those of depth.

    ``order`` lists places by their prefixes; ``left`` is how many bytes of its
    string each place still has.  Each place is moved ``shift`` to the left and
    distributed by the class of the symbol there, stably; a place whose string
    ends within the symbol comes first.
    """
    moved = order - np.int32(shift)
    moved = moved[moved >= 0]
    moved = moved[left[moved] > shift]
    moved = np.concatenate([np.flatnonzero(left <= shift).astype("int32"), moved])
    spread = moved[np.argsort(classes[moved], kind="stable")]
    pair = classes.astype("int64") << 17
    pair[:len(pair) - shift] += np.where(left[:len(pair) - shift] > shift, classes[shift:] + np.int64(1), 0)
    along = pair[spread]
    new = np.empty(len(spread), dtype=bool)
    new[0] = True
    np.not_equal(along[1:], along[:-1], out=new[1:])
    out = np.empty_like(classes)
    out[spread] = np.cumsum(new) - 1
    return spread, out


def interleaved(data: np.ndarray, left: np.ndarray, order: np.ndarray, length: int):
    """Places in the order of their prefixes of ``length`` bytes, refined from an interleave, and the prefixes' classes."""
    order = order[np.argsort(data[order], kind="stable")]
    present = np.zeros(256, dtype="int64")
    present[data] = 1
    classes, depth = (np.cumsum(present) - 1).astype("uint16")[data], 1
    while depth < length:
        step = min(depth, length - depth)
        order, classes = refined(order, classes, step, left)
        depth += step
    return order, classes


def merged(strings: list[bytes], length: int, shards: int = 2):
    """For each place of the strings the class of its next ``length`` bytes; the order of the shards does not change it."""
    data = np.frombuffer(b"".join(strings), dtype="uint8")
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes)
    text_end = np.repeat(ends, sizes)
    left = (text_end - np.arange(len(data))).astype("int32")
    cuts = [int(ends[i]) for i in np.linspace(0, len(strings), shards + 1)[1:-1].astype(int) - 1 if i >= 0]
    orders, begin = [], 0
    for cut in [*cuts, len(data)]:
        if cut > begin:
            own, _ = interleaved(data[begin:cut], left[begin:cut], np.arange(cut - begin, dtype="int32"), length)
            orders.append(own + np.int32(begin))
            begin = cut
    _, classes = interleaved(data, left, np.concatenate(orders), length)
    return classes, text_end


def repeated_windows(rows: pd.DataFrame, length: int) -> list[bytes]:
    """For each chunk's surroundings, bits that tell which of their windows occur at another place."""
    keys, spots, texts, owner = [], [], [], []
    for c, (h, body) in enumerate(zip(rows["hashes"], rows["body"])):
        k = unpacked(h, "uint64")
        raw = zlib.decompress(body)
        head = np.frombuffer(raw, dtype="int64", count=2 * len(k)).reshape(2, -1)
        at = 16 * len(k)
        for a, n in head.T.tolist():
            texts.append(raw[at:at + n])
            spots.append(a)
            at += n
        keys.append(k)
        owner.append(np.full(len(k), c))
    keys, owner, spots = np.concatenate(keys), np.concatenate(owner), np.array(spots)
    bits = [None] * len(texts)
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0, [True]])).tolist()
    unit, size = [], 0

    def flush():
        nonlocal unit, size
        if not unit:
            return
        strings = [texts[k] for k in unit]
        classes, text_end = merged(strings, length)
        n = np.array([len(s) for s in strings])
        begin = np.cumsum(n) - n
        place = np.concatenate([np.arange(b, b + m - length + 1) for b, m in zip(begin.tolist(), n.tolist())])
        which = np.repeat(np.arange(len(unit)), n - length + 1)
        spot = owner[unit][which] * np.int64(2**40) + spots[unit][which] + place - begin[which]
        cls = classes[place].astype("int64")
        low = np.full(65_536, np.iinfo("int64").max)
        high = np.full(65_536, -1, dtype="int64")
        np.minimum.at(low, cls, spot)
        np.maximum.at(high, cls, spot)
        again = low[cls] != high[cls]
        for k, part in zip(unit, np.split(again, np.cumsum(n - length + 1)[:-1])):
            bits[k] = part
        unit, size = [], 0

    for i, j in zip(edges[:-1], edges[1:]):
        group = order[i:j].tolist()
        more = sum(len(texts[k]) for k in group)
        if size + more > UNIT:
            flush()
        unit += group
        size += more
    flush()
    ends = np.cumsum([0, *[np.count_nonzero(owner == c) for c in range(len(rows))]])
    return [packed(np.concatenate(bits[i:j]).astype("uint8")) for i, j in zip(ends[:-1], ends[1:])]


def counted_windows(rows: pd.DataFrame) -> list[bytes]:
    with np.errstate(over="ignore"):
        keys = [np.cumsum(unpacked(h, "uint64"), dtype="uint64") for h in rows["hashes"]]
    _, number, total = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    again = (total[number] > 1).astype("uint8")
    return [packed(p) for p in np.split(again, np.cumsum([len(k) for k in keys])[:-1])]


def answered(length: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        bodies = repeated_windows(rows, length) if rows["kind"].iloc[0] == 1 else counted_windows(rows)
        return pd.DataFrame({"chunk": rows["chunk"], "kind": rows["kind"], "bucket": rows["bucket"], "body": bodies})

    return run


def remover(length: int, seed: int):
    """A chunk's documents without the bytes that repeated windows cover."""

    def run(sent: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        x = Picked(opened(sent["texts"].iloc[0]), length, seed)
        codes = x.codes(told)
        edge = np.zeros(len(x.raw) + 1, dtype="int64")

        def cover(a, b):
            np.add.at(edge, a, 1)
            np.add.at(edge, b, -1)

        whole = (codes[x.pair] & REPEATED) > 0
        cover(x.a[whole], x.b[whole])

        def bits(kind):
            parts = [unpacked(b, "uint8") for b in told[told["kind"] == kind].sort_values("bucket")["body"]]
            return np.concatenate(parts) > 0 if parts else np.empty(0, dtype=bool)

        at = x.first[np.flatnonzero(codes & SEND)]
        n = x.b[at] - length - x.a[at] + 1
        starts = (np.repeat(x.a[at] - (np.cumsum(n) - n), n) + np.arange(n.sum()))[bits(1)]
        cover(starts, starts + length)
        starts = x.frequent_windows(codes)[0]
        # equal hashes within the chunk repeat too
        starts = starts[bits(2)]
        cover(starts, starts + length)

        covered = np.cumsum(edge[:-1]) > 0
        ends = np.cumsum(x.sizes)
        begin = ends - x.sizes
        data = np.frombuffer(x.raw, dtype="uint8")
        starts = covered.copy()
        starts[1:] &= ~covered[:-1]
        head = begin[x.sizes > 0]
        starts[head] = covered[head]  # a run ends with its document
        sums = lambda v: np.concatenate([[0], np.cumsum(v)])
        removed, spans = sums(covered), sums(starts)
        ids = list(sent["doc_ids"].iloc[0])
        return pd.DataFrame({
            "doc_id": pd.array([None if pd.isna(i) else int(i) for i in ids], dtype="Int64"), "n_bytes": x.sizes,
            "n_removed": removed[ends] - removed[begin], "n_spans": spans[ends] - spans[begin],
            "kept": [data[i:j][~covered[i:j]].tobytes() for i, j in zip(begin.tolist(), ends.tolist())]})

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, many: int = MANY, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes): one row per document."""
    scratch = Scratch(docs.sparkSession, "repeats")
    d = pick(docs, doc_id="bigint", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    picked = 2 * size // (length - seed + 2)  # about as many grams
    buckets = max(1, -(-picked // bucket))
    asked = d.mapInPandas(first_asker(chunk, buckets, length, seed), ASKED)
    codes = scratch.write(asked.groupBy("bucket").applyInPandas(judged(many), TOLD), "codes")
    sent = d.mapInPandas(sender(chunk), SENT)
    again = sent.groupBy("chunk").cogroup(codes.groupBy("chunk")).applyInPandas(second_asker(buckets, length, seed), ASKED)
    bits = scratch.write(again.groupBy("kind", "bucket").applyInPandas(answered(length), TOLD), "bits")
    return sent.groupBy("chunk").cogroup(codes.union(bits).groupBy("chunk")).applyInPandas(remover(length, seed), KEPT)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
