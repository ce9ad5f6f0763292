"""Text quality by an interpolated modified Kneser-Ney model over pairs of words.

Words and runs of signs, lower-cased, fall into 65,535 classes by a hash; class 0 stands before a text. Pairs are counted
over the trusted texts outside a held-out fold, so the table grows with the corpus; the order below it, over single
classes, is a table of 65,536 numbers. Pairs are dealt to shards by their first word, which all pairs of a context share:
a shard's contexts need no other, and each shard is one record of packed, sorted pairs. To score every text without
shipping a row per word, a map task inverts its texts: per block and shard one row with the distinct pairs and, for each,
the texts and counts. Shards of model and postings are joined; a frequent word's shard is dealt out by blocks. The shards'
sums per text are added up into log-likelihoods.

Texts that the model has learned from, and their copies, look better than others, so thresholds come from held-out trusted
texts. There is no lower one: it would reject texts that the model knows, and not those that repeat a few common words."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, claim, materialize, text_bytes
from .language import held_out_of

SHARDS = 64  # at least
SHARD = 64_000_000  # bytes of text for each further one
BLOCK = 1_500_000  # words inverted together
QUANTILE = 0.98  # of held-out trusted texts' perplexities, up to which a text is kept
_WORD = re.compile(r"\w+|[^\w\s]+")
_classes: dict[str, int] = {}


def shards_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of pairs, by their first words."""
    return ((keys.astype(np.uint64) >> np.uint64(16)) * np.uint64(40503) % np.uint64(65536) % np.uint64(shards)).astype(np.uint64)


def pack(*columns: np.ndarray) -> bytes:
    """Whole numbers of 0 to 2^32 - 1, each column's four bytes apart and compressed apart: the high ones take next to no room."""
    squeeze, out = zstandard.ZstdCompressor(level=3).compress, []
    for x in columns:
        for plane in np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T):
            body = squeeze(plane.tobytes()) if plane.any() else b""
            out += [len(x).to_bytes(4, "little"), len(body).to_bytes(4, "little"), body]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    """The columns of packed numbers, as 64-bit ones."""
    at, planes, expand = 0, [], zstandard.ZstdDecompressor().decompress
    while at < len(data):
        n, size = (int.from_bytes(data[k : k + 4], "little") for k in (at, at + 4))
        planes.append(np.frombuffer(expand(data[at + 8 : at + 8 + size]), np.uint8) if size else np.zeros(n, np.uint8))
        at += 8 + size
    return [np.ascontiguousarray(np.stack(planes[k : k + 4], 1)).view("<u4").ravel().astype(np.int64) for k in range(0, len(planes), 4)]


def classes(text: str) -> np.ndarray:
    """Classes of a text's words: 1 to 65,535 by a hash; a worker remembers words it has met."""
    found = _WORD.findall(text.lower())
    try:
        return np.fromiter(map(_classes.__getitem__, found), np.uint32, len(found))
    except KeyError:
        if len(_classes) > 500_000:
            _classes.clear()
        for w in found:
            if w not in _classes:
                _classes[w] = 1 + xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 4) % 65535
        return np.fromiter(map(_classes.__getitem__, found), np.uint32, len(found))


def keys_of(text: str) -> np.ndarray:
    """The pair that ends at each word: the class before it, 0 at the start, and its own."""
    x = np.concatenate((np.zeros(1, np.uint32), classes(text)))
    return (x[:-1] << np.uint32(16)) | x[1:]


def _texts(column: pa.Array) -> list[str]:
    return [b.decode("utf-8", "replace") for b in text_bytes(column)]


def _parts(keys: np.ndarray):
    """A text's pairs in parts of a block at most."""
    return [keys[lo : lo + BLOCK] for lo in range(0, max(len(keys), 1), BLOCK)]


def count_pairs(texts: DataFrame, shards: int) -> DataFrame:
    """(shard, part, pairs): the sorted distinct pairs of `texts` (text) and their counts, packed; a shard has many parts."""

    def run(batches):
        claim("classes", _classes.clear)
        part, held, size = TaskContext.get().partitionId() << 20, [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            at = shards_of(keys, shards)
            order = np.argsort(at, kind="stable")
            edges = np.searchsorted(at[order], np.arange(shards + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(edges))
            body = [pack(np.diff(keys[o].astype(np.int64), prepend=0), n[o]) for o in (order[edges[k] : edges[k + 1]] for k in full)]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), part, np.int64)), pa.array(body, pa.binary())], ["shard", "part", "pairs"])

        for batch in batches:
            for text in _texts(batch.column(0)):
                for piece in _parts(keys_of(text)):
                    held.append(piece)
                    size += len(piece)
                    if size > BLOCK:
                        yield flush()
                        part, held, size = part + 1, [], 0
        if size:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        parts = [unpack(p.as_py()) for p in table.column("pairs")]
        keys, at = np.unique(np.concatenate([np.cumsum(k) for k, _ in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)
        return pa.table({"shard": table.column("shard").slice(0, 1), "part": pa.array([0], pa.int64()), "pairs": pa.array([pack(np.diff(keys, prepend=0), n)], pa.binary())})

    kind = "shard int, part long, pairs binary"
    # two rounds, so that no task merges all parts of a shard at once
    some = texts.mapInArrow(run, kind).groupBy("shard", F.pmod(F.xxhash64("part"), F.lit(16))).applyInArrow(merge, kind)
    return some.groupBy("shard").applyInArrow(merge, kind)


class Discounts:
    """Modified Kneser-Ney discounts of an order from its counts of counts."""

    def __init__(self, counts: dict[int, int]):
        n1, n2, n3, n4 = (counts.get(i, 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.5, 3 - 4 * y * n4 / n3 if n3 else 0.5]
        self.d = [min(max(v, 0.05), i) for v, i in zip(raw, (0.95, 1.9, 2.85))]

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.where(n >= 3, self.d[2], np.where(n == 2, self.d[1], np.where(n == 1, self.d[0], 0.0)))


class Model:
    """A trained model: `shards` (shard, pairs) packed, `single`, the probability of a class by itself (65,536 numbers), the
    discounts of pairs, and the number of shards and, for each, among how many tasks its texts are dealt."""

    def __init__(self, shards: DataFrame, single: np.ndarray, discounts: Discounts, salts: np.ndarray):
        self.shards, self.single, self.discounts, self.salts = shards, single, discounts, salts


def fit(texts: DataFrame, size: int) -> Model:
    """Counts and discounts over all rows of `texts` (text); `size`, the bytes of all texts to be scored, sets the shards."""
    bounded_batches(texts.sparkSession)
    n_shards = min(65536, max(SHARDS, 1 << max(0, size // SHARD).bit_length()))
    shards = materialize(count_pairs(texts, n_shards), "pairs")

    def summed(batches):  # by class the distinct words before it; by 1 to 4 the pairs of that count; by shard the words
        after, few, words = np.zeros(65536, np.int64), np.zeros(5, np.int64), {}
        for b in batches:
            for shard, data in zip(b.column(0).to_pylist(), b.column(1)):
                keys, n = unpack(data.as_py())
                after += np.bincount(np.cumsum(keys) & 65535, minlength=65536)
                few += np.bincount(np.minimum(n, 5), minlength=6)[:5]
                words[shard] = words.get(shard, 0) + int(n.sum())
        for what, at, n in (("after", np.flatnonzero(after), after[after > 0]), ("few", np.arange(5), few), ("words", np.array(list(words), np.int64), np.array(list(words.values()), np.int64))):
            yield pa.RecordBatch.from_arrays([pa.array([what] * len(at), pa.string()), pa.array(at), pa.array(n)], ["what", "at", "n"])

    sums = shards.select("shard", "pairs").mapInArrow(summed, "what string, at long, n long").groupBy("what", "at").agg(F.sum("n").alias("n")).toArrow()  # 131,077 rows at most
    tables = {"after": np.zeros(65536), "few": np.zeros(5), "words": np.zeros(n_shards)}
    for what, table in tables.items():
        mine = sums.filter(pc.equal(sums["what"], what))
        table[mine["at"].to_numpy()] = mine["n"].to_numpy()
    one, few, words = tables["after"], tables["few"], tables["words"]
    cut = Discounts({n: int((one == n).sum()) for n in (1, 2, 3, 4)}).of(one)
    single = (one - cut) / one.sum() + cut.sum() / one.sum() / 65536 if one.sum() else np.full(65536, 1 / 65536)
    salts = np.maximum(1, np.ceil(words / max(words.sum(), 1) * n_shards / 3)).astype(np.int64)
    return Model(shards.select("shard", "pairs"), single, Discounts({n: int(few[n]) for n in (1, 2, 3, 4)}), salts)


def _invert(texts: DataFrame, salts: np.ndarray) -> DataFrame:
    """(shard, salt, block, ids, tags, sizes, postings): per block and shard the distinct pairs with the texts they are in."""
    names = ["shard", "salt", "block", "ids", "tags", "sizes", "postings"]
    shards = len(salts)

    def flush(block, ids, tags, parts):
        sizes = np.array([len(p) for p in parts], np.int64)
        key = np.concatenate(parts).astype(np.uint64)
        packed = (shards_of(key, shards) << np.uint64(48)) | (key << np.uint64(16)) | np.repeat(np.arange(len(parts), dtype=np.uint64), sizes)
        packed.sort()
        first = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
        times, packed = np.diff(first, append=len(packed)), packed[first]
        edges = np.searchsorted(packed, np.arange(shards + 1, dtype=np.uint64) << np.uint64(48))
        for s in range(shards):
            lo, hi = edges[s], edges[s + 1]
            if lo == hi and s:
                continue
            gram = ((packed[lo:hi] >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            new = np.concatenate(([True], gram[1:] != gram[:-1])) if hi > lo else np.empty(0, bool)
            postings = pack(np.diff(gram[new], prepend=0), np.diff(np.flatnonzero(new), append=hi - lo), packed[lo:hi] & np.uint64(65535), times[lo:hi])
            held = (ids, tags, sizes.tolist()) if s == 0 else ([], [], [])
            arrays = [pa.array([s], pa.int32()), pa.array([block % salts[s]], pa.int64()), pa.array([block], pa.int64())] + [pa.array([h], pa.list_(pa.int64())) for h in held] + [pa.array([postings], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    def run(batches):
        claim("classes", _classes.clear)
        block = TaskContext.get().partitionId() << 20
        ids, tags, parts, held = [], [], [], 0
        for batch in batches:
            for i, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch.column(2))):
                for part in _parts(keys_of(text)):
                    ids.append(i), tags.append(tag), parts.append(part)
                    held += len(part)
                    if held > BLOCK or len(ids) == 65_000:
                        yield from flush(block, ids, tags, parts)
                        block, ids, tags, parts, held = block + 1, [], [], [], 0
        if ids:
            yield from flush(block, ids, tags, parts)

    return texts.mapInArrow(run, "shard int, salt long, block long, ids array<long>, tags array<long>, sizes array<long>, postings binary")


def log_probabilities(wanted: np.ndarray, keys: np.ndarray, counts: np.ndarray, single: np.ndarray, discounts: Discounts) -> np.ndarray:
    """Natural logarithms of the interpolated probabilities of pairs, from all pairs of their contexts, sorted."""
    p = single[wanted & 65535]
    if len(keys):
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        n = np.where(keys[at] == wanted, counts[at], 0)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] >> 16 != keys[:-1] >> 16)))
        context, total, freed = keys[first] >> 16, np.add.reduceat(counts, first), np.add.reduceat(discounts.of(counts), first)
        at = np.minimum(np.searchsorted(context, wanted >> 16), len(context) - 1)
        p = np.where(context[at] == wanted >> 16, (n - discounts.of(n)) / total[at] + freed[at] / total[at] * p, p)
    return np.log(p)


def log_likelihoods(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(id, tag, log_p, n_words) of every distinct row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    salts, discounts = model.salts, model.discounts
    single = spark.sparkContext.broadcast(model.single)

    def dealt(batches):
        for b in batches:
            at = np.repeat(np.arange(b.num_rows), salts[b.column(0).to_numpy()])
            salt = np.concatenate([np.arange(salts[s]) for s in b.column(0).to_pylist()] or [np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(salt), b.column(1).take(pa.array(at))], ["shard", "salt", "pairs"])

    def score(postings: pa.Table, table: pa.Table) -> pa.Table:
        keys, counts = unpack(table.column("pairs")[0].as_py()) if table.num_rows else (np.empty(0, np.int64),) * 2
        keys, sums = np.cumsum(keys), []
        for data in postings.column("postings"):
            gram, uses, text, times = unpack(data.as_py())
            log_p = log_probabilities(np.cumsum(gram), keys, counts, single.value, discounts)
            sums.append(np.bincount(text, times * np.repeat(log_p, uses)).astype("<f4").tobytes())
        return postings.select(["block", "ids", "tags", "sizes"]).append_column("sums", pa.array(sums, pa.binary()))

    shards = model.shards.mapInArrow(dealt, "shard int, salt long, pairs binary")
    partial = _invert(rows, salts).groupBy("shard", "salt").cogroup(shards.groupBy("shard", "salt")).applyInArrow(
        score, "block long, ids array<long>, tags array<long>, sizes array<long>, sums binary"
    )

    def add(table: pa.Table) -> pa.Table:
        head = next(r for r in table.select(["ids", "tags", "sizes"]).to_pylist() if r["ids"])
        total = np.zeros(len(head["ids"]))
        for data in table.sort_by("sums").column("sums"):  # a fixed order of adding
            part = np.frombuffer(data.as_py(), "<f4")
            total[: len(part)] += part
        return pa.table({"id": pa.array(head["ids"], pa.int64()), "tag": pa.array(head["tags"], pa.int64()), "log_p": total, "n_words": pa.array(head["sizes"], pa.int64())})

    added = partial.groupBy("block").applyInArrow(add, "id long, tag long, log_p double, n_words long")
    return added.groupBy("id", "tag").agg(F.sum("log_p").alias("log_p"), F.sum("n_words").alias("n_words"))


def _trusted(labels: DataFrame) -> DataFrame:
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null")
    return good.select(F.col("doc_id").cast("long").alias("good")).distinct()


def trusted_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts (text) outside the held-out fold whose id is labelled of good quality and not toxic.

    The ids travel as lists per 1,024 numbers in a stored table, so Spark broadcasts it while it is small, by its own
    check, and joins by shuffle beyond that."""
    good = _trusted(labels).where(~held_out_of("good")).withColumnRenamed("good", "i")
    lists = good.groupBy(F.floor(F.col("i") / 1024).alias("span")).agg(F.array_sort(F.collect_set(F.pmod("i", F.lit(1024)).cast("short"))).alias("good"))
    lists = materialize(lists, "trusted-ids")
    one = F.col(id_col).cast("long")
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.floor(one / 1024).alias("span"), F.pmod(one, F.lit(1024)).cast("short").alias("place"))
    return rows.join(lists, "span").where(F.array_contains("good", F.col("place"))).select("text")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """(id, lang, perplexity per word, threshold, keep) of every distinct (id, text, lang).

    The model learns from the texts labelled good (`labels`: doc_id, quality, toxic) outside the held-out fold; a language's
    threshold is the `quantile` of the perplexities of the trusted texts within it. A language without such texts takes that
    of all; without any, rows have a null threshold and are kept. Texts without words, empty and null ones too, have null
    perplexity and are not kept. A null language is a language of its own. Equal perplexities are judged alike; long texts
    are scored whole, in parts of a block."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    model = fit(trusted_texts(docs, labels, id_col, text_col), size)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    langs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tag"), F.col(lang_col).alias("lang")).distinct()
    scored = log_likelihoods(docs, model, id_col, text_col)
    scored = scored.select("id", "tag", F.exp(-F.col("log_p") / F.when(F.col("n_words") > 0, F.col("n_words"))).alias("perplexity"))
    both = langs["id"].eqNullSafe(scored["id"]) & (langs["tag"] == scored["tag"])
    table = materialize(langs.join(scored, both).select(langs["id"], "lang", "perplexity"), "perplexities")
    held = table.join(_trusted(labels).where(held_out_of("good")), F.col("id") == F.col("good"))
    cut = F.percentile_approx("perplexity", quantile, 100_000)
    cuts = held.groupBy("lang").agg(cut.alias("own")).withColumnRenamed("lang", "of")
    overall = held.agg(cut.alias("all")).first()[0]
    joined = table.join(cuts, table["lang"].eqNullSafe(cuts["of"]), "left")
    threshold = F.coalesce("own", F.lit(overall).cast("double"))
    keep = F.col("perplexity").isNotNull() & (threshold.isNull() | (F.col("perplexity") <= threshold))
    return joined.select(F.col("id").alias(id_col), "lang", "perplexity", threshold.alias("threshold"), keep.alias("keep"))
