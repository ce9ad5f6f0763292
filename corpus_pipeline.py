"""Corpus pipeline: language ID, near-dedup by exact Jaccard, suffix-array dedup, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
`docs`, whatever others there are besides doc_id, text and, for language ID, lang. Null texts count as empty."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontaminate, language, near_copies, packing, suffix_dedup
from keyloom.llm._shared import materialize

MIN_SCORE = 0.4  # least mean probability of a text's language
REPEAT_BYTES = 200  # repeated strings of this length go; about 35 words


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts that no known language fits; a rejected row goes."""
    model = language.fit(docs, fold=None)
    rows = docs.select("text", F.struct(*[docs[c] for c in docs.columns]).alias("doc"))  # columns of any name pass through
    kept = language.identify(rows, model)
    return kept.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every component of near copies (five-word Jaccard of 0.8 or more): that with the smallest doc_id.

    A row is named by its doc_id and a hash of its text; null ids come after all others, then the hash decides. Of rows
    equal in both, one stays."""
    rows = materialize(near_copies.near_copies(docs), "near-copies")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "tag")
    heads = rows.groupBy("component").agg(F.min(place).alias("head"), F.count("*").alias("n")).where("n > 1")
    grouped = rows.join(heads, "component")
    gone = grouped.where(~place.eqNullSafe(F.col("head"))).select("id", "tag").distinct()
    twice = grouped.where(place.eqNullSafe(F.col("head"))).groupBy("id", "tag").count().where("count > 1").select("id", "tag")
    twice = materialize(twice, "repeated-rows")
    tag = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))

    def named(some: DataFrame):
        return docs["doc_id"].eqNullSafe(some["id"]) & (tag == some["tag"])

    left = docs.join(gone, named(gone), "left_anti").select(*docs.columns)
    if twice.isEmpty():
        return left
    again = left.join(twice, named(twice), "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return left.join(twice, named(twice), "left_anti").select(*docs.columns).unionByName(again)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated strings of REPEAT_BYTES out of the texts, all occurrences but the first; a text with nothing left goes.

    First is the occurrence of the least doc_id (null before all), then by a hash of the text, then by place. Bytes of a
    character that was cut through go with it. A column n_chars, if there is one, follows the new text."""
    _, verdict = suffix_dedup.verdicts(docs, length=REPEAT_BYTES, anchor=48, keep_first=True)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("of"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("mark"))
    joined = rows.join(verdict, rows["of"].eqNullSafe(verdict["id"]) & (rows["mark"] == verdict["tag"]), "left").select("doc", "spans", "whole")
    names = docs.columns

    def apply(batches):
        for b in batches:
            columns = dict(zip(names, b.column(0).flatten()))
            spans, whole = b.column(1).to_pylist(), b.column(2).to_pylist()
            texts, keep = columns["text"].to_pylist(), []
            sizes = columns["n_chars"].to_pylist() if "n_chars" in columns else [None] * len(texts)
            for i, text in enumerate(texts):
                touched = bool(spans[i]) or bool(whole[i])
                if touched:
                    left, _ = suffix_dedup.cut(text.encode(), spans[i], whole[i], REPEAT_BYTES)
                    texts[i] = left.decode("utf-8", "ignore")
                    sizes[i] = len(texts[i])
                keep.append(not touched or bool(texts[i].strip()))
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(apply, docs.schema)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every row whose text contains a benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts' token ids into sequences: a row per piece."""
    return packing.pack_documents(docs)[1]


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_repeats),
    ("decontamination", decontaminate_documents),
    ("packing", pack_sequences),
]

#: The stages hash, sort suffixes, train and tokenize, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
