"""Token ids kept in wavelet matrices, one file per shard.

Documents are dealt by ranges of their ids, so shards follow ascending ids. A shard holds whole documents of about
`SHARD` ids. File layout, little-endian: magic, number of ids n, planes p, blocks k of a plane; for each plane from the
highest bit its number of zeros; then the directory: of each plane and block the ones before it (u4) and the end of its
bytes (u8); then the planes' blocks of BITS bits, each compressed by itself, so that rank and select touch one block of a
plane; then the documents' ids and lengths, compressed."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import bounded_batches, materialize, shuffle_partitions
from .tokens import encoder, public_path

MAGIC = b"KLWM0002"
SHARD = 1 << 20
BITS = 1 << 16  # bits of a block


def dump(ids: np.ndarray, docs: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of a shard: `ids` of all its documents in order, the documents' numbers and lengths."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    blocks = -(-len(ids) // BITS)
    zeros_of, before, bodies = [], np.zeros((planes, blocks), "<u4"), []
    x = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    for p, bit in enumerate(range(planes - 1, -1, -1)):
        one = (x & x.dtype.type(1 << bit)) != 0
        zeros = x.take(np.flatnonzero(~one))  # faster than masks on mixed bits
        packed = np.packbits(one, bitorder="little")
        if blocks:
            ones = np.add.reduceat(one, np.arange(0, len(one), BITS), dtype=np.int64)
            before[p] = np.cumsum(ones) - ones
        bodies += [squeeze(packed[k : k + BITS // 8].tobytes()) for k in range(0, len(packed), BITS // 8)]
        zeros_of.append(len(zeros))
        x = np.concatenate((zeros, x.take(np.flatnonzero(one))))
    ends = np.cumsum([len(b) for b in bodies]).astype("<u8")
    out = [MAGIC, struct.pack("<QQQ", len(ids), planes, blocks), np.array(zeros_of, "<u8").tobytes(), before.tobytes(), ends.tobytes(), *bodies]
    for column in (docs.astype("<i8"), lengths.astype("<i8")):
        body = squeeze(column.tobytes())
        out += [struct.pack("<QQ", len(column), len(body)), body]
    return b"".join(out)


class WaveletMatrix:
    """Reads a shard file: access, rank (count up to a place), select (place of an occurrence), and whole decoding. Blocks are
    unpacked when they are needed."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.n, self.planes, self.blocks = struct.unpack_from("<QQQ", data, 8)
        self._data, at, cells = data, 32, self.planes * self.blocks
        self.zeros = np.frombuffer(data, "<u8", self.planes, at).astype(np.int64).tolist()
        at += 8 * self.planes
        self._before = np.frombuffer(data, "<u4", cells, at).astype(np.int64).reshape(self.planes, self.blocks)
        at += 4 * cells
        ends = np.frombuffer(data, "<u8", cells, at).astype(np.int64) + at + 8 * cells
        self._edges = np.concatenate(([at + 8 * cells], ends))
        at = int(self._edges[-1])
        columns = []
        for _ in range(2):
            _, size = struct.unpack_from("<QQ", data, at)
            columns.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at + 16 : at + 16 + size]), "<i8"))
            at += 16 + size
        self.docs, self.lengths = columns
        self._open: dict[int, np.ndarray] = {}

    def _block(self, plane: int, block: int) -> np.ndarray:
        """The bits of a block, packed."""
        at = plane * self.blocks + block
        if at not in self._open:
            body = self._data[self._edges[at] : self._edges[at + 1]]
            self._open[at] = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
        return self._open[at]

    def _rank1(self, plane: int, at: int) -> int:
        """Ones before place `at` of a plane: those before its block, from the directory, and those of the block."""
        if at >= self.n:
            return self.n - self.zeros[plane]
        block, rest = divmod(at, BITS)
        bits = self._block(plane, block)
        part = int(np.bitwise_count(bits[: rest >> 3]).sum(dtype=np.int64))
        return int(self._before[plane, block]) + part + (int(bits[rest >> 3]) & ((1 << (rest & 7)) - 1)).bit_count()

    def _select(self, plane: int, bit: int, k: int) -> int:
        """The place of the k-th one or zero of a plane: its block by the directory, then within the block."""
        before = self._before[plane] if bit else np.arange(self.blocks) * BITS - self._before[plane]
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self._block(plane, block), bitorder="little")
        return block * BITS + int(np.flatnonzero(bits == bit)[k - before[block]])

    def access(self, at: int) -> int:
        """The id at a place from 0."""
        value = 0
        for p in range(self.planes):
            bit = int(self._block(p, at // BITS)[at % BITS >> 3]) >> (at & 7) & 1
            ones = self._rank1(p, at)
            at = self.zeros[p] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def access_many(self, at: np.ndarray) -> np.ndarray:
        """The ids at many places: every plane is opened once and its blocks' ones are summed up by byte."""
        at, value = at.astype(np.int64), np.zeros(len(at), np.int64)
        for p in range(self.planes if len(at) else 0):
            bits = np.concatenate([self._block(p, k) for k in range(self.blocks)])
            inner = np.bitwise_count(bits).astype(np.int64)
            inner = np.cumsum(inner) - inner  # ones before each byte, less those before its block
            byte, block = at >> 3, at // BITS
            ones = self._before[p, block] + inner[byte] - inner[block * (BITS // 8)]
            ones += np.bitwise_count(bits[byte] & ((1 << (at & 7)) - 1).astype(np.uint8)).astype(np.int64)
            bit = bits[byte] >> (at & 7).astype(np.uint8) & 1
            at = np.where(bit == 1, self.zeros[p] + ones, at - ones)
            value = value << 1 | bit
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """Where the occurrences of an id before `end` stand after the last plane."""
        start = 0
        for p in range(self.planes):
            a, b = self._rank1(p, start), self._rank1(p, end)
            if value >> (self.planes - 1 - p) & 1:
                start, end = self.zeros[p] + a, self.zeros[p] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, value: int, end: int) -> int:
        """Occurrences of an id before place `end`."""
        if value >> self.planes:
            return 0
        start, end = self._range(value, end)
        return end - start

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The place of occurrence number k (from 0) of an id, from the last plane up; -1 if there are not so many."""
        if value >> self.planes:
            return -1
        start, end = self._range(value, self.n)
        if k >= end - start:
            return -1
        at = start + k
        for p in range(self.planes - 1, -1, -1):
            bit = value >> (self.planes - 1 - p) & 1
            at = self._select(p, bit, at - self.zeros[p] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids in order, by undoing the planes' stable partitions from the lowest bit up."""
        x = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for p in range(self.planes - 1, -1, -1):
            bits = np.concatenate([self._block(p, k) for k in range(self.blocks)]) if self.blocks else np.empty(0, np.uint8)
            one = np.unpackbits(bits, count=self.n, bitorder="little").view(bool)
            y = np.empty_like(x)
            y[np.flatnonzero(~one)] = x[: self.zeros[p]]
            y[np.flatnonzero(one)] = x[self.zeros[p] :] | x.dtype.type(1 << (self.planes - 1 - p))
            x = y
        return x.astype(np.uint32)


def write_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, style: str = "word", end_id: int = 2, shard: int = SHARD) -> DataFrame:
    """Encodes texts, appends `end_id`, and writes shard files; reads them back as (part, seq, n_docs, n_tokens, data).

    Parts ascend with ids, and seq within a part. Equal ids are ordered by text; null ids come first; null texts count as
    empty. Each file is a Parquet container of one record, so any file system that Spark writes to will do."""
    path = tokenizer or public_path("word_bpe_49k.json")

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        enc = encoder(path, style)
        held, names, sizes, total = [], [], [], 0

        def file():
            data = dump(np.concatenate(held), np.array(names, np.int64), np.array(sizes, np.int64))
            arrays = [pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([len(names)], pa.int64()), pa.array([total], pa.int64()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["part", "seq", "n_docs", "n_tokens", "data"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(texts), 100):
                flat, counts = enc.encode([t or "" for t in texts[lo : lo + 100]])
                ends = np.cumsum(counts)
                whole = np.insert(flat, ends, np.uint32(end_id))
                edge = 0
                for i, n in zip(ids[lo : lo + 100], (counts + 1).tolist()):
                    held.append(whole[edge : edge + n].astype(np.uint16) if enc.tokenizer.get_vocab_size() <= 1 << 16 else whole[edge : edge + n])
                    names.append(-(1 << 63) if i is None else i), sizes.append(n)
                    edge += n
                    total += n
                    if total >= shard:
                        yield file()
                        seq += 1
                        held, names, sizes, total = [], [], [], 0
        if names:
            yield file()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    bounded_batches(spark)
    dealt = rows.repartitionByRange(shuffle_partitions(spark), "id").sortWithinPartitions("id", "text")
    shards = dealt.mapInArrow(run, "part long, seq long, n_docs long, n_tokens long, data binary")
    return materialize(shards, "wavelet", maxRecordsPerFile=1)


def read_documents(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32, last_id) of every document, decoded from shard files; start counts all ids before
    it, and last_id is the id at the document's last place, by access through the planes."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                matrix = WaveletMatrix(batch.column(2)[row].as_py())
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(matrix.lengths)
                starts = ends - matrix.lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, batch.column(0)[row].as_py(), np.int64)), pa.array(np.full(n, batch.column(1)[row].as_py(), np.int64)), pa.array(matrix.docs, mask=matrix.docs == -(1 << 63)), pa.array(starts), pa.array(matrix.lengths), pa.array(crc, pa.int64()), pa.array(matrix.access_many(ends - 1))],
                    ["part", "seq", "id", "local", "n_tokens", "ids_crc32", "last_id"],
                )

    found = shards.select("part", "seq", "data").mapInArrow(run, "part long, seq long, id long, local long, n_tokens long, ids_crc32 long, last_id long")
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    totals = totals.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    bases = shards.select("part", "seq", within.alias("within")).join(totals, "part")
    bases = bases.select("part", "seq", (F.col("before") + F.col("within")).alias("base"))
    return found.join(bases, ["part", "seq"]).select(F.col("id").alias(id_col), (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "last_id")
