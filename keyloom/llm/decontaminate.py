"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so their Jaccard similarity is small even where the whole item is copied, and
symmetric signatures would miss it. Containment is therefore searched from the item's side: a MinHash signature of an
item is a sample of its own shingles, those of least value under 2k hash functions; each lies in a containing document
with probability equal to the containment, so an item at the threshold is missed with a chance under `miss`, whatever its
size. Items are partitioned by size (powers of two of their shingle count): partitions of at most 4k shingles keep all of
them and miss none, larger ones are searched by signatures. Items of fewer words than a shingle form partitions of their
own, by number of words, and are searched among the texts' shingles of that many words. Every text's shingles are probed
against the signatures; the few candidates are then verified by exact containment, on the words themselves."""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, claim

WIDTH = 5
THRESHOLD = 0.8
BLOCK = 20_000  # items searched for in one pass over the documents
SIZE = 20_000_000  # characters of them
_WORD = re.compile(r"\w+")
_MULT = np.uint64(0x9E3779B97F4A7C15)
_cache: dict[str, int] = {}


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the lower-cased words; a worker remembers words it has met."""
    found = _WORD.findall(text.lower())
    try:
        return np.fromiter(map(_cache.__getitem__, found), np.uint64, len(found))
    except KeyError:
        if len(_cache) > 500_000:
            _cache.clear()
        for w in found:
            if w not in _cache:
                _cache[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 3)
        return np.fromiter(map(_cache.__getitem__, found), np.uint64, len(found))


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hashes of all runs of `width` words; a shorter text is one shingle; none without words."""
    if not len(words):
        return words
    k = min(width, len(words))
    with np.errstate(over="ignore"):
        h = np.zeros(len(words) - k + 1, np.uint64)
        for i in range(k):
            h = (h ^ words[i : len(words) - k + 1 + i]) * _MULT
            h ^= h >> np.uint64(29)
    return h


def signature(items: np.ndarray, k: int) -> np.ndarray:
    """The shingles of least value under k hash functions: a uniform sample of the set for each function."""
    with np.errstate(over="ignore"):
        seeds = np.arange(1, k + 1, dtype=np.uint64)[:, None] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (items[None, :] ^ seeds) * _MULT
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return np.unique(items[mixed.argmin(1)])


def exact_shingles(words: list[str], width: int) -> set[tuple[str, ...]]:
    return set(zip(*(words[i:] for i in range(width))))


class ItemIndex:
    """Signatures of a block of items by width and shingle, and the items' words."""

    def __init__(self, items: list[tuple[int, str]], width: int, threshold: float, miss: float):
        self.ids, self.sets, self.widths, probes = [], [], [], {}
        k = math.ceil(math.log(miss) / math.log(1 - threshold)) if threshold < 1 else 1
        for i, text in items:
            words = _WORD.findall((text or "").lower())
            if not words:
                continue
            w = min(width, len(words))
            s = np.unique(shingles(word_hashes(text), w))
            size = 1 << (len(s) - 1).bit_length()  # the partition's largest size
            probe = s if size <= 4 * k else signature(s, 2 * k)
            keys, owners = probes.setdefault(w, ([], []))
            keys.append(probe), owners.append(np.full(len(probe), len(self.ids)))
            self.ids.append(i), self.sets.append(exact_shingles(words, w)), self.widths.append(w)
        self.probes = {}
        for w, (keys, owners) in probes.items():
            key, owner = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(key, kind="stable")
            self.probes[w] = key[order], owner[order]

    def hits(self, text: str, threshold: float) -> list[tuple[int, int, int]]:
        """(item, shared, shingles of the item) of every item whose containment in the text is at the threshold."""
        hashes, candidates = word_hashes(text), []
        for w, (key, owner) in self.probes.items():
            if len(hashes) >= w:
                hit = np.isin(key, shingles(hashes, w))
                if hit.any():
                    candidates += np.unique(owner[hit]).tolist()
        if not candidates:
            return []
        words, found = _WORD.findall(text.lower()), []
        own = {w: exact_shingles(words, w) for w in {self.widths[c] for c in candidates}}
        for c in candidates:
            both = len(self.sets[c] & own[self.widths[c]])
            if both >= threshold * len(self.sets[c]):
                found.append((self.ids[c], both, len(self.sets[c])))
        return found


def _blocks(items: DataFrame, item_col: str, item_text: str, width: int, threshold: float, miss: float, block: int, size: int):
    """Broadcast indexes of blocks of items, each of `block` items and `size` characters at most (or of one item)."""
    context = items.sparkSession.sparkContext
    batch: list[tuple[int, str]] = []
    held = 0
    for i, text in items.select(F.col(item_col).cast("long"), F.col(item_text).cast("string")).toLocalIterator():
        if batch and (len(batch) == block or held + len(text or "") > size):
            yield context.broadcast(ItemIndex(batch, width, threshold, miss))
            batch, held = [], 0
        batch.append((i, text))
        held += len(text or "")
    yield context.broadcast(ItemIndex(batch, width, threshold, miss))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, miss: float = 1e-9, block: int = BLOCK, size: int = SIZE) -> DataFrame:
    """(id, item, n_shared, n_item, containment) of every row and item whose containment is `threshold` or more.

    Containment: the part of the item's distinct shingles of `width` lower-cased words (an item of fewer words is one
    shingle) that the text has anywhere. Null and wordless texts and items match nothing. Repeated rows and repeated items
    each give their own result rows; long texts are searched whole. The items are a stated query set, searched in blocks of
    at most `block` items and `size` characters, each sent to every executor and one pass over the texts."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"{id_col} long, {item_col} long, n_shared long, n_item long, containment double"
    kind = pa.schema([(id_col, pa.int64()), (item_col, pa.int64()), ("n_shared", pa.int64()), ("n_item", pa.int64()), ("containment", pa.float64())])

    def search(held) -> DataFrame:
        def run(batches):
            claim("words", _cache.clear)
            for b in batches:
                out = [(i, item, both, n, both / n) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for item, both, n in held.value.hits(text or "", threshold)]
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=kind.names), kind, preserve_index=False)

        return rows.mapInArrow(run, schema)

    found = [search(held) for held in _blocks(items, item_col, item_text, width, threshold, miss, block, size)]
    return functools.reduce(DataFrame.unionByName, found)


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, miss: float = 1e-9, block: int = BLOCK, size: int = SIZE) -> DataFrame:
    """The rows of `docs`, all columns, whose text contains no item. Rows are judged by themselves, so neither null nor
    shared ids matter; nothing is shuffled."""
    bounded_batches(docs.sparkSession)
    out = docs.select(F.col(text_col).cast("string").alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    schema = out.schema

    def clean(rows: DataFrame, held) -> DataFrame:
        def run(batches):
            claim("words", _cache.clear)
            for b in batches:
                yield b.filter(pa.array([not held.value.hits(text or "", threshold) for text in b.column(0).to_pylist()], pa.bool_()))

        return rows.mapInArrow(run, schema)

    for held in _blocks(items, item_col, item_text, width, threshold, miss, block, size):
        out = clean(out, held)
    return out.select("doc.*")
