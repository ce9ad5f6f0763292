"""Near copies by the exact Jaccard similarity of the texts' five-word shingles, for the pipeline's near-dedup stage.

Candidates are the links of operator 6: SimHash fingerprints of the shingle sets, found with its vantage-point trees. Within
the few bits at which trees prune, these are the closest copies only: texts of similarity 0.8 differ in about ten of 64 bits,
where the triangle bound leaves nothing out. The rest therefore comes from MinHash: two texts of similarity s share a band
of ROWS minima with a chance of 1 - (1 - s^ROWS)^BANDS, at 0.8 all but 3 in 100,000. Texts that are linked either way,
directly or by others, form a candidate group; each text goes to its group once. There every link is confirmed by whole
shingle sets, and components of the confirmed links are the near copies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, claim, components, materialize, ragged, text_bytes
from .decontaminate import shingles
from .simhash import majority, near_links

WIDTH = 5
SIMILARITY = 0.8
ROWS, BANDS = 4, 20
RADIUS = 4  # bits within which the trees look
CELL = 16_000_000  # bytes of text above which a candidate group is dealt out as pairs of chunks
_FACTORS = np.random.default_rng(5).integers(0, 1 << 64, ROWS * BANDS, np.uint64, endpoint=False) | np.uint64(1)
_cache: dict[bytes, int] = {}


def shingle_set(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of `width` words; fewer words are one shingle."""
    if len(_cache) > 500_000:
        _cache.clear()
    for w in words:
        if w not in _cache:
            _cache[w] = xxhash.xxh64_intdigest(w, 5)
    return np.unique(shingles(np.fromiter(map(_cache.__getitem__, words), np.uint64, len(words)), width))


def bands(s: np.ndarray) -> np.ndarray:
    """A hash of every band of minima of a non-empty set."""
    low = np.full(ROWS * BANDS, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 4096):
            np.minimum(low, (_FACTORS[:, None] * s[None, i : i + 4096]).min(1), out=low)
        out = np.arange(BANDS, dtype=np.uint64)
        for column in low.reshape(BANDS, ROWS).T:
            out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def links(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Edges that connect exactly what all pairs of at least `similarity` connect.

    Breadth first over an inverted index: sets reached leave the pool, so a dense group costs a few passes."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    pool, left, live, a, b = np.ones(len(sets), bool), len(sets), len(sets), [], []
    for first in range(len(sets)):
        if not pool[first]:
            continue
        pool[first] = False
        left -= 1
        queue = [first]
        while queue and left:
            if left < live // 2:  # sets that have been reached leave the index
                keep = pool[owner]
                flat, owner, live = flat[keep], owner[keep], left
            x = queue.pop()
            lo, hi = np.searchsorted(flat, sets[x]), np.searchsorted(flat, sets[x], "right")
            both = np.bincount(owner[ragged(lo, hi - lo)], minlength=len(sets))
            hit = np.flatnonzero(pool & (both >= similarity * (sizes + sizes[x] - both) - 1e-9))
            pool[hit] = False
            left -= len(hit)
            a += [x] * len(hit)
            b += hit.tolist()
            queue += hit.tolist()
    return a, b


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """(id, tag, mark, component) of every row: rows of one component are linked by texts of at least `similarity`.

    tag is xxhash64 of the text (null counts as empty) and with the id names a row; mark is a hash of its words, so texts
    that differ in ASCII case or white space alone are one. Wordless texts are copies of each other."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))

    def marks(column):
        words = [t.lower().split() for t in text_bytes(column)]
        return words, pa.array(np.fromiter((xxhash.xxh64_intdigest(b" ".join(w), 9) for w in words), np.uint64, len(words)).view(np.int64))

    def sign(batches):
        claim("near copies", _cache.clear)
        for batch in batches:
            words, mark = marks(batch.column(2))
            sets = [shingle_set(w) for w in words]
            keys = [bands(s).view(np.int64) if len(s) else np.empty(0, np.int64) for s in sets]
            prints = np.fromiter((majority(s) for s in sets), np.uint64, len(sets)).view(np.int64)
            ends = np.cumsum([0] + [len(k) for k in keys]).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), mark, held, pa.array(prints)], ["id", "tag", "mark", "bands", "fp"])

    def marked(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([marks(batch.column(0))[1], batch.column(0)], ["mark", "text"])

    signed = materialize(rows.mapInArrow(sign, "id long, tag long, mark long, bands array<long>, fp long"), "minhash")
    placed = signed.select("mark", F.explode("bands").alias("band"))
    shared = placed.groupBy("band").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low < high").select("band", "low")
    by_band = placed.join(shared, "band").where("mark != low").select(F.col("mark").alias("a"), F.col("low").alias("b"))
    prints = materialize(signed.where(F.size("bands") > 0).groupBy("fp").agg(F.min("mark").alias("low")), "distinct-fp")
    alike = signed.join(prints, "fp").where("mark != low").select(F.col("mark").alias("a"), F.col("low").alias("b"))
    close = near_links(prints.select("fp"), RADIUS)
    close = close.join(prints.select(F.col("fp").alias("a"), F.col("low").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("low").alias("y")), "b")
    groups = components(by_band.union(alike).union(close.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    groups = materialize(groups.select(F.col("node").alias("mark"), "root"), "candidates")
    texts = rows.select("text").mapInArrow(marked, "mark long, text string").join(groups, "mark").dropDuplicates(["mark"])
    texts = materialize(texts.select("root", "mark", "text"), "candidate-texts")
    cuts = texts.groupBy("root").agg(F.ceil(F.sum(F.octet_length("text")) / cell).cast("int").alias("cuts"))
    mine = F.pmod(F.xxhash64("mark"), F.col("cuts")).cast("int")
    cells = texts.join(cuts, "root").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    cells = cells.select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mark", "text")

    def confirm(table: pa.Table) -> pa.Table:
        claim("near copies", _cache.clear)
        mark = table.column("mark").to_numpy()
        a, b = links([shingle_set(t.lower().split()) for t in text_bytes(table.column("text"))], similarity)
        return pa.table({"a": pa.array(mark[a], pa.int64()), "b": pa.array(mark[b], pa.int64())})

    linked = components(cells.groupBy("root", "i", "j").applyInArrow(confirm, "a long, b long"))
    named = signed.select("id", "tag", "mark").join(linked.withColumnRenamed("node", "mark"), "mark", "left")
    return named.select("id", "tag", "mark", F.coalesce("root", "mark").alias("component"))
