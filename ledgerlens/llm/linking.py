"""Components of similar sets, from the keys that the sets share.

Given are sets (id, n, grams) and keys (key, id, n); two sets are candidates if
they share a key, and linked if their Jaccard similarity reaches a percentage.
The result is the component of every linked id.  Not all pairs of a key are
made:

* Keys with the same members are one column of the incidence and count once.
* Rounds: each member of a key is tested with one hub of it, at first the
  smallest id, later a member of the key's largest component.  A round costs
  rows in proportion to the members outside that component, and a key whose
  members form one component is finished: a further link would change nothing.
  Rounds end when they join few.
* What is left, keys with several components, is proved by a blocked sparse
  product: members are dealt to blocks of bounded size by their most frequent
  key, component and size, and two blocks meet once however many keys their
  members share.  Blocks of one component and blocks whose sizes exclude a link
  never meet.  A product adds up the overlap counts of all pairs of two blocks
  over slices of grams.  Keys with few such pairs are tested pair by pair.

So every candidate pair is tested or connected already; nothing is capped.
Every table that is read twice is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch

#: A key with so many open pairs for a member is tested pair by pair.
SPREAD = 2
#: A further round follows while it links at least one in so many of its pairs.
WORTH = 20
#: Grams of a block, and of a slice of a product.
ENTRIES, WIDTH = 60_000, 4096


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id, component (its smallest member) of all ids in links (a, b).

    Alternating large-star and small-star steps: each joins the neighbours of
    an id to the smallest of them, so no step gathers an id's neighbours and
    the number of steps is logarithmic in practice.
    """
    edges = scratch.write(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.write(large.distinct(), "large")  # every edge points down: a > b
        least = scratch.write(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        small = scratch.write(small, "small")
        # done when every id has one edge and it leads to an id that has none
        roots = small.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        unfinished = small.select("b").distinct().join(small.select(F.col("a").alias("b")), "b", "left_semi")
        if roots.where("n > 1").isEmpty() and unfinished.isEmpty():
            return small.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
                small.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        edges = small


def distinct_keys(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of keys with several members, of keys with the same members one: key, id, n, members."""
    seen = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    one = seen.where("members > 1").groupBy("members", "x", "y").agg(F.min("key").alias("key")).select("key", "members")
    return scratch.write(keys.join(scratch.write(one, "columns"), "key"), "keys")


def joined(parts: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components with further links (a, b) between them."""
    if parts is None:
        return scratch.write(components(links, scratch), "parts")
    a = links.join(parts.toDF("a", "c_a"), "a", "left").select(F.coalesce("c_a", "a").alias("a"), "b")
    both = a.join(parts.toDF("b", "c_b"), "b", "left").select("a", F.coalesce("c_b", "b").alias("b"))
    moved = scratch.write(components(scratch.write(both, "between"), scratch).toDF("component", "to"), "moved")
    old = parts.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    own = moved.select(F.col("component").alias("id"), F.col("to").alias("component"))  # ids that stood alone until now
    return scratch.write(old.union(own).distinct(), "parts")


def open_keys(keys: DataFrame, parts: DataFrame | None, r: int, scratch: Scratch) -> DataFrame:
    """Members of keys with several components, labelled, with the key's hub (h, n_h), largest component and open pairs (left)."""
    if parts is None:
        rows = keys.withColumn("component", F.col("id"))
        hub = F.min(F.struct("id", "n"))
    else:
        rows = keys.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
        rows = scratch.write(rows.select("key", "id", "n", "members", "component"), "labelled")
        hub = F.min(F.struct(F.xxhash64("id", F.lit(r)), "id", "n"))
    if parts is None:  # each member is a component of its own
        one = rows.groupBy("key").agg(hub.alias("hub"), F.min("members").alias("members"))
        pairs = F.col("members").cast("double") * (F.col("members") - 1) / 2
        heads = one.select("key", F.col("hub.id").alias("h"), F.col("hub.n").alias("n_h"), F.col("hub.id").alias("main"), pairs.alias("left"))
    else:
        sizes = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("of"), hub.alias("hub"))
        of = F.col("of").cast("double")
        heads = sizes.groupBy("key").agg(F.max(F.struct("of", "component", "hub")).alias("top"), F.count(F.lit(1)).alias("parts"),
                                         ((F.sum(of) * F.sum(of) - F.sum(of * of)) / 2).alias("left")).where("parts > 1")
        heads = heads.select("key", F.col("top.hub.id").alias("h"), F.col("top.hub.n").alias("n_h"), F.col("top.component").alias("main"), "left")
    heads = scratch.write(heads, "heads")
    return rows.join(heads, "key")


def sized(pairs: DataFrame, percent: int) -> DataFrame:
    return pairs.where((F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent))


def hub_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Each member outside a key's main component with the key's hub."""
    x = rows.where("component <> main AND id <> h")
    low = F.col("h") < F.col("id")
    pairs = x.select(F.least("h", "id").alias("a"), F.greatest("h", "id").alias("b"),
                     F.when(low, F.col("n_h")).otherwise(F.col("n")).alias("n_a"), F.when(low, F.col("n")).otherwise(F.col("n_h")).alias("n_b"))
    return sized(pairs, percent).select("a", "b").distinct()


def open_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """The pairs of a key that are in different components."""
    x = rows.select("key", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("c_a"))
    y = rows.select("key", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("c_b"))
    return sized(x.join(y, "key").where("a < b AND c_a <> c_b"), percent).select("a", "b").distinct()


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar.  ``grams`` may lack what no other set holds; n counts all."""
    # each side takes its sets by the pairs, which are small, before the sides meet
    x = pairs.join(sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("grams").alias("grams_a")), "a")
    y = pairs.join(sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("grams").alias("grams_b")), "b")
    common = F.size(F.array_intersect("grams_a", "grams_b"))
    return x.join(y, ["a", "b"]).where(common * 100 >= (F.col("n_a") + F.col("n_b") - common) * percent).select("a", "b")


def overlaps(x: list[np.ndarray], y: list[np.ndarray], width: int = WIDTH) -> np.ndarray:
    """Overlap counts of all pairs of two blocks of sets: a sparse product, slice by slice of the shared grams."""
    flat_x, flat_y = np.concatenate(x), np.concatenate(y)
    shared = np.intersect1d(flat_x, flat_y)
    out = np.zeros((len(x), len(y)), dtype="int64")
    if not len(shared):
        return out
    sides = []
    for sets, flat in ((x, flat_x), (y, flat_y)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        place = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        own = shared[place] == flat
        sides.append((row[own], place[own], len(sets)))
    for begin in range(0, len(shared), width):
        end = min(begin + width, len(shared))
        dense = []
        for row, place, n in sides:
            own = (place >= begin) & (place < end)
            m = np.zeros((n, end - begin), dtype="float32")  # counts of a slice are exact
            m[row[own], place[own] - begin] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype("int64")
    return out


def product(percent: int):
    """Links between two blocks, of which as many as connect what the blocks' links connect."""

    def run(batches):
        for batch in batches:
            for x, y in zip(batch["x"], batch["y"]):
                ids, n, sets = zip(*((side["id"], side["n"], [np.asarray(g) for g in side["grams"]]) for side in (x, y)))
                o = overlaps(*sets)
                union = np.asarray(n[0])[:, None] + np.asarray(n[1])[None, :] - o
                root, links = {}, []

                def find(k):
                    while root.setdefault(k, k) != k:
                        root[k] = k = root[root[k]]
                    return k

                for i, j in zip(*np.nonzero((o > 0) & (100 * o >= percent * union))):
                    a, b = int(ids[0][i]), int(ids[1][j])
                    p, q = find(a), find(b)
                    if p != q:
                        root[p] = q
                        links.append((a, b))
                if links:
                    yield pd.DataFrame(links, columns=["a", "b"])

    return run


def block_links(rows: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, entries: int) -> DataFrame:
    """Links between the members of open keys (key, id, n, members, component, main), by products of blocks."""
    rows = scratch.write(rows, "dealt")
    own = rows.groupBy("id").agg(F.max(F.struct("members", "key", "main")).alias("home"), F.min("n").alias("n"), F.min("component").alias("component"))
    # sizes whose classes differ by more than one exclude a link
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)))
    own = own.select("id", F.col("home.key").alias("home"), F.when(F.col("home.main") == F.col("component"), F.col("component")).alias("whole"), size.alias("size"), "n")
    own = scratch.write(own, "own")
    deal = ["home", "whole", "size"]
    many = own.groupBy(*deal).agg(F.ceil(F.sum("n") / entries).alias("blocks")).withColumnsRenamed({c: f"d_{c}" for c in deal})
    same = (F.col("home") == F.col("d_home")) & F.col("whole").eqNullSafe(F.col("d_whole")) & (F.col("size") == F.col("d_size"))
    block = F.xxhash64("home", "whole", "size", F.pmod(F.xxhash64("id"), F.col("blocks")))
    placed = scratch.write(own.join(scratch.write(many, "many"), same).select("id", "whole", "size", block.alias("block")), "placed")
    met = rows.select("key", "id").join(placed, "id").groupBy("key", "block").agg(F.first("whole").alias("whole"), F.first("size").alias("size"))
    met = scratch.write(met, "met")
    x, y = (met.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "whole", "size")]) for s in "xy")
    other = ~F.coalesce(F.col("whole_x") == F.col("whole_y"), F.lit(False))
    meet = x.join(y, "key").where((F.col("block_x") <= F.col("block_y")) & other & (F.abs(F.col("size_x") - F.col("size_y")) <= 1))
    meet = scratch.write(meet.select("block_x", "block_y").distinct(), "meet")
    whole = placed.select("id", "block").join(sets, "id").groupBy("block").agg(F.collect_list(F.struct("id", "n", "grams")).alias("s"))
    side = F.struct(F.col("s.id").alias("id"), F.col("s.n").alias("n"), F.col("s.grams").alias("grams"))
    whole = scratch.write(whole.select("block", side.alias("s")), "blocks")
    both = meet.join(whole.toDF("block_x", "x"), "block_x").join(whole.toDF("block_y", "y"), "block_y").select("x", "y")
    conf, at_once = sets.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(at_once)
    conf.set(at_once, "16")  # a row holds two blocks
    found = scratch.write(both.mapInPandas(product(percent), "a bigint, b bigint"), "found")
    conf.set(at_once, before)
    return found


def linked(keys: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, entries: int = ENTRIES, spread: int = SPREAD) -> DataFrame | None:
    """id, component of all ids that have a link (None if there is none).

    ``keys``: key, id, n.  ``sets``: id, n, grams (array of bigint, distinct); written tables.
    """
    keys, parts, tested, r = distinct_keys(keys, scratch), None, None, 0
    if keys.isEmpty():
        return None
    while True:
        pairs = hub_pairs(open_keys(keys, parts, r, scratch), percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.write(pairs, "pairs")
        links = scratch.write(similar(pairs, sets, percent), "links")
        n_pairs, n_links = pairs.count(), links.count()
        if n_links:
            parts = joined(parts, links, scratch)
        tested = pairs if tested is None else tested.union(pairs)
        r += 1
        if n_links * WORTH <= n_pairs:
            break
    rows = open_keys(keys, parts, r, scratch)
    rows = scratch.write(rows.select("key", "id", "n", "members", "component", "main", "left"), "open")
    few = F.col("left") <= F.col("members") * spread
    pairs = scratch.write(open_pairs(rows.where(few), percent).join(tested, ["a", "b"], "left_anti"), "pairs")
    links = similar(pairs, sets, percent)
    large = rows.where(~few)
    if not large.isEmpty():
        links = links.union(block_links(large.drop("left"), sets, percent, scratch, entries))
    links = scratch.write(links, "links")
    return parts if links.isEmpty() else joined(parts, links, scratch)
