"""Substring dedup by sliding sentence spans.

A text is cut after . ! ? , ; : and at line ends. From every piece on, the shortest run of at least RUN consecutive pieces
that has LEAST words or more is hashed to 128 bits; equal runs meet in a global join; every piece that a run other than the
first of its kind covers goes. A bound in words, not in sentences alone, leaves short phrases that many texts share, and
pieces smaller than sentences leave few words of a shared passage outside whole pieces."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, materialize

RUN = 2
LEAST = 25
_SENTENCE = re.compile(r"[^.!?,;:\n]*(?:[.!?,;:]+|\n|$)\s*")


def sentences(text: str) -> list[str]:
    """A text cut after signs and at line ends; the pieces joined give the text. Blank pieces join the one before."""
    out: list[str] = []
    for s in _SENTENCE.findall(text):
        if not s:
            continue
        if out and not s.strip():
            out[-1] += s
        else:
            out.append(s)
    return out


def runs(words: list[int], run: int = RUN, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of the shortest run from each piece on, for pieces of `words` words; the whole text if there is none."""
    out: list[tuple[int, int]] = []
    end = held = 0
    for start, n in enumerate(words):
        while end < len(words) and (held < least or end - start < run):
            held += words[end]
            end += 1
        if held < least or end - start < run:
            break
        out.append((start, end))
        held -= n
    return out or ([(0, len(words))] if any(words) else [])


def span_marks(text: str, run: int = RUN, least: int = LEAST) -> list[tuple[int, int, bytes]]:
    """(start, end, 16-byte digest) of every run, compared in lower case and without regard to white space."""
    split = [s.lower().split() for s in sentences(text)]
    plain = [" ".join(s).encode("utf-8", "surrogatepass") for s in split]
    return [(a, b, xxhash.xxh3_128_digest(b"\n".join(plain[a:b]))) for a, b in runs([len(s) for s in split], run, least)]


def drop_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, least: int = LEAST) -> DataFrame:
    """Per row: id, n_sentences (pieces), n_removed and kept (the text without the removed pieces).

    First is the run with the smallest (id, hash of the text, place). A text without a run, because it is short or has no
    signs, is one run, so whole copies of it go but the first. Null texts count as empty; empty and blank texts have no run.
    Null ids come before all others. Rows with the same id and text have the same runs, of which the first stays in each of
    them. Texts of any length are hashed whole; an empty table gives an empty result. Other columns are not read."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))

    def hashed(batches):
        for batch in batches:
            found = [span_marks(t, run, least) for t in batch.column(2).to_pylist()]
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            marks = np.frombuffer(b"".join(m for f in found for _, _, m in f), "<i8").reshape(-1, 2)
            starts = np.array([a for f in found for a, _, _ in f], np.int32)
            ends = np.array([b for f in found for _, b, _ in f], np.int32)
            arrays = [batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(starts), pa.array(ends)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "tag", "mark", "rest", "start", "end"])

    spans = materialize(rows.mapInArrow(hashed, "id long, tag long, mark long, rest long, start int, end int"), "spans")
    # half of the digest finds what may repeat; only that travels on, and is held against the whole digest
    # (written, so that both sides of the join are plain shuffles, of which Spark splits a very frequent mark)
    twice = materialize(spans.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"), "repeated-marks")
    repeated = materialize(spans.join(twice, "mark"), "repeated-spans")
    place = F.struct("id", "tag", "start")
    heads = materialize(repeated.groupBy("mark", "rest").agg(F.min(place).alias("head"), F.count("*").alias("n")).where("n > 1").drop("n"), "first-spans")
    later = repeated.join(heads, ["mark", "rest"]).where(~place.eqNullSafe(F.col("head")))
    again = later.groupBy("id", "tag").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def cut(batches):
        for batch in batches:
            counts, gone, kept = [], [], []
            for body, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts = sentences(body)
                out = np.zeros(len(parts) + 1, np.int64)
                for s in found or ():
                    out[s["start"]] += 1
                    out[s["end"]] -= 1
                out = (np.cumsum(out)[:-1] > 0).tolist()
                counts.append(len(parts)), gone.append(sum(out))
                kept.append("".join(s for s, o in zip(parts, out) if not o))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [id_col, "n_sentences", "n_removed", "kept"])

    same = rows["id"].eqNullSafe(again["id"]) & (rows["tag"] == again["tag"])
    joined = rows.join(again, same, "left").select(rows["id"], "text", "spans")
    return joined.mapInArrow(cut, f"{id_col} long, n_sentences long, n_removed long, kept string")
