"""SimHash near-duplicates found with vantage-point trees.

Texts become 64-bit fingerprints. For links of at most `radius` differing bits the bits are cut into three blocks;
two linked fingerprints differ in at most radius // 3 bits of one block. For each block a vantage-point tree, fitted on
a bounded sample of fingerprints, partitions all of them by Hamming distance within the block. At a node with vantage
point p and bound m, the triangle inequality says that linked points differ by at most r in their distance to p, so the
inner shard takes distances up to m and the outer shard those from m + 1 - r: a pair is never cut, and only the thin
shell at the boundary is sent to both. Each shard then verifies pairs exactly on all 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, claim, components, materialize, text_bytes

SAMPLE = 200_000  # most fingerprints the trees are fitted on; all are indexed
LEAF = 1_500  # fingerprints wanted in a shard
CELL = 20_000  # a shard above this is dealt out as pairs of chunks


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 values of all `width`-word shingles; fewer words: one shingle; none: zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist())), np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half the hashes."""
    counts, n = np.zeros(64, np.int64), len(hashes)
    for i in range(0, n, 1 << 15):
        part = hashes[i : i + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row. A-Z are lower-cased, words are runs of bytes other than ASCII white space; null text counts as empty."""

    def run(batches):
        claim("simhash")
        for batch in batches:
            fps = np.fromiter((fingerprint(t) for t in text_bytes(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(mask, radius within it) of the three blocks."""
    cuts = [0, 21, 42, 64]
    return [((1 << b) - (1 << a), radius // 3) for a, b in zip(cuts, cuts[1:])]


def grow(sample: np.ndarray, mask: int, r: int, leaf: float, rng: np.random.Generator):
    """A tree of (vantage, bound, inner, outer); None is a leaf."""
    if len(sample) <= max(leaf, 2):
        return None
    best = None
    for p in rng.choice(sample, 6):
        d = np.bitwise_count((sample ^ p) & np.uint64(mask))
        m = int(np.median(d))
        for bound in (m - 1, m):
            inner, outer = int((d <= bound).sum()), int((d >= bound + 1 - r).sum())
            if inner and outer and (best is None or max(inner, outer) < best[0]):
                best = (max(inner, outer), p, bound, d)
    if best is None or best[0] > 0.95 * len(sample):
        return None
    _, p, bound, d = best
    return (p, bound, grow(sample[d <= bound], mask, r, leaf, rng), grow(sample[d >= bound + 1 - r], mask, r, leaf, rng))


def leaves(tree, x: np.ndarray, mask: int, r: int):
    """(leaf number, indexes of x) of every leaf reached."""
    stack, found = [(tree, np.arange(len(x)), 1)], []
    while stack:
        node, at, name = stack.pop()
        if not len(at):
            continue
        if node is None:
            found.append((name, at))
            continue
        d = np.bitwise_count((x[at] ^ node[0]) & np.uint64(mask))
        stack.append((node[2], at[d <= node[1]], 2 * name))
        stack.append((node[3], at[d >= node[1] + 1 - r], 2 * name + 1))
    return found


def forest(x: np.ndarray, radius: int, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect exactly what links of at most `radius` bits connect, without listing all pairs.

    Breadth first from `width` points at a time, each the root of a tree. Points reached leave the pool for the queue, so a
    dense ball costs a few passes. A point that leaves the queue is compared with the pool, with those that leave with it and
    with queued points of other trees; trees that a link joins are one from then on."""
    pool, out = np.arange(len(x)), []
    queue = tree = np.empty(0, np.int64)
    while len(pool) or len(queue):
        if not len(queue):
            queue, pool = pool[:width], pool[width:]
            tree = np.arange(len(queue))
        rows, of, queue, tree = queue[:width], tree[:width], queue[width:], tree[width:]
        close = np.bitwise_count(x[rows][:, None] ^ x[pool][None, :]) <= radius
        hit = close.any(0)
        got = close[:, hit]
        joined = (got.astype(np.float32) @ got.T.astype(np.float32)) > 0
        joined |= np.bitwise_count(x[rows][:, None] ^ x[rows][None, :]) <= radius
        i, j = np.nonzero(np.triu(joined & (of[:, None] != of[None, :]), 1))
        out.append((rows[i], rows[j]))
        same = of[i] * width + of[j]
        if len(queue) and ((of != tree[0]).any() or (tree != tree[0]).any()):
            across = np.bitwise_count(x[rows][:, None] ^ x[queue][None, :]) <= radius
            i, j = np.nonzero(across & (of[:, None] != tree[None, :]))
            between, first = np.unique(of[i] * width + tree[j], return_index=True)  # one link joins two trees
            out.append((rows[i[first]], queue[j[first]]))
            same = np.concatenate((same, between))
        reached, by = pool[hit], got.argmax(0) if hit.any() else np.empty(0, np.int64)
        out.append((reached, rows[by]))
        queue, tree, pool = np.concatenate((queue, reached)), np.concatenate((tree, of[by])), pool[~hit]
        name = np.arange(width)
        for a, b in (divmod(pair, width) for pair in np.unique(same).tolist()):
            name[name == name[b]] = name[a]
        tree = name[tree]
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def near_links(prints: DataFrame, radius: int = 4, sample: int = SAMPLE, leaf: int = LEAF, cell: int = CELL) -> DataFrame:
    """Edges (a, b) over the distinct values of `prints` (fp long) whose components are those of all links of at most `radius` bits."""
    spark = prints.sparkSession
    n = prints.count()
    share = min(1.0, sample / max(n, 1))
    some = prints.where(F.abs(F.xxhash64("fp", F.lit(7)) % 1_000_000) < int(share * 1_000_000)) if share < 1 else prints
    base = np.array([r.fp for r in some.limit(2 * sample).toLocalIterator()], np.int64).view(np.uint64)
    base.sort()
    rng = np.random.default_rng(11)
    blocks = _blocks(radius)
    trees = [(grow(base, mask, r, leaf * len(base) / max(n, 1), rng), mask, r) for mask, r in blocks]

    def route(batches):
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for block, (tree, mask, r) in enumerate(trees):
                for name, at in leaves(tree, x, mask, r):
                    where = np.full(len(at), name * 4 + block, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(x[at].view(np.int64))], ["shard", "fp"])

    # fingerprints are small and routing them is not: more tasks than their size alone would give
    tasks = max(spark.sparkContext.defaultParallelism, n // 10_000)
    placed = materialize(prints.select("fp").repartition(tasks, "fp").mapInArrow(route, "shard long, fp long"), "fingerprint-shards")
    sizes = placed.groupBy("shard").agg(F.ceil(F.count("*") / cell).cast("int").alias("cuts"))
    mine = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    cells = placed.join(sizes, "shard").withColumn("mine", mine)
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    cells = cells.select("shard", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")

    def link(table: pa.Table) -> pa.Table:
        x = np.unique(table.column("fp").to_numpy()).view(np.uint64)
        mask, r = blocks[int(table.column("shard")[0].as_py()) % 4]
        # a shard that the sample was too small to divide is divided here by a tree of its own
        tree = grow(x, mask, r, 2 * leaf, np.random.default_rng(12))
        pairs = [tuple(x[at[side]] for side in forest(x[at], radius)) for _, at in leaves(tree, x, mask, r)]
        a, b = (np.concatenate([p[side] for p in pairs]) if pairs else np.empty(0, np.uint64) for side in (0, 1))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return cells.groupBy("shard", "i", "j").applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """(id, fingerprint hex, component_id) for every row.

    Rows link when their fingerprints differ in at most `radius` bits; component_id is the smallest id reachable.
    Null and blank texts have fingerprint zero and link like any other. Rows with a null id get a result too, but
    never name a component. Repeated ids keep one result row each. Other columns of `docs` are not looked at."""
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    firsts = materialize(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fp")
    groups = components(near_links(firsts.select("fp"), radius))
    named = groups.join(firsts, groups.node == firsts.fp).select("node", "root", "first")
    roots = named.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = materialize(named.join(roots, "root").select(F.col("node").alias("fp"), "component_id"), "linked-fp")
    every = firsts.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(every, "fp").select(F.col("id").alias(id_col), hexed, "component_id")
