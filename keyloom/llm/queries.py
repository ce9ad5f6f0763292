"""The registered queries opN_<name>: thin applications of the operators to whole tables, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, licenses, media, packing, quality, sentence_dedup, simhash, suffix_dedup, wavelet


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents have no paths: source, then 5,000s, 500s and 50s of doc_id stand for directories.

    Ids that 63, 21 or 7 divides lie in the directory of the source, of the 5,000 or of the 500, so that directories above
    others hold files; all others lie in the lowest. Every fourth document is a licence file."""
    i = F.col("doc_id")
    tops = [F.when(i % step != 0, F.floor(i / size)) for step, size in ((63, 5000), (21, 500), (7, 50))]
    name = F.when(i % 4 == 0, F.concat(F.lit("LICENSE."), i)).otherwise(F.concat(i, F.lit(".txt")))
    return licenses.scan(_table(spark, sf_dir, "documents"), F.concat_ws("/", "source", *tops, name))


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(_table(spark, sf_dir, "documents"))[1]
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.read_media(media.write_media(_table(spark, sf_dir, "documents"))))


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_documents(wavelet.write_shards(_table(spark, sf_dir, "documents")))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sentence_dedup.drop_repeated_spans(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_sentences", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    text = F.expr("make_valid_utf8(cast(kept as string))")  # bytes of a character that was cut through become U+FFFD
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text.alias("text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", language.held_out_of("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_benchmark_leaks": op2_benchmark_leaks,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_kneser_ney_quality": op4_kneser_ney_quality,
    "op5_png_media": op5_png_media,
    "op6_simhash_components": op6_simhash_components,
    "op7_wavelet_tokens": op7_wavelet_tokens,
    "op8_sentence_spans": op8_sentence_spans,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_language_id": op10_language_id,
}

_OP2 = r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
  i AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, array_to_string(w[n:n + least(len(w), 5) - 1], ' ') AS gram FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - least(len(w), 5), 0) + 2)) AS n) WHERE len(w) > 0),
  s AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY 1),
  g AS (SELECT DISTINCT doc_id, k, array_to_string(w[n:n + k - 1], ' ') AS gram FROM w, (SELECT DISTINCT k FROM i) q, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS n) WHERE len(w) >= k),
  f AS (SELECT doc_id, item_id, count(*) AS n_shared FROM g JOIN i USING (k, gram) GROUP BY ALL)
  SELECT doc_id, item_id, n_shared, n_item, n_shared::double / n_item AS containment FROM f JOIN s USING (item_id) WHERE n_shared >= 0.8::double * n_item"""

_OP8 = r"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^.!?,;:\n]*(?:[.!?,;:]+|\n|$)\s*'), lambda s: s <> '') AS parts FROM documents),
  p AS (SELECT doc_id, unnest(parts) AS part, unnest(range(0, len(parts))) AS n FROM t),
  q AS (SELECT doc_id, n, part, trim(regexp_replace(lower(part), '\s+', ' ', 'g')) AS plain FROM p),
  c AS (SELECT doc_id, n, part, plain, CASE WHEN plain = '' THEN 0 ELSE len(string_split(plain, ' ')) END AS words, coalesce(sum(CASE WHEN plain = '' THEN 0 ELSE len(string_split(plain, ' ')) END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q),
  e AS (SELECT a.doc_id, a.n AS a, min(b.n) + 1 AS b FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.n BETWEEN a.n + 1 AND a.n + 27 AND b.before + b.words - a.before >= 25 GROUP BY ALL),
  r AS (SELECT * FROM e UNION ALL SELECT doc_id, 0, count(*) FROM c WHERE doc_id NOT IN (SELECT doc_id FROM e) GROUP BY doc_id HAVING sum(words) > 0),
  m AS (SELECT r.doc_id, r.a, r.b, string_agg(c.plain, chr(10) ORDER BY c.n) AS run FROM r JOIN c ON c.doc_id = r.doc_id AND c.n >= r.a AND c.n < r.b GROUP BY ALL),
  l AS (SELECT doc_id, a, b FROM m QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, a) > 1),
  g AS (SELECT DISTINCT c.doc_id, c.n FROM l JOIN c ON c.doc_id = l.doc_id AND c.n >= l.a AND c.n < l.b)
  SELECT t.doc_id, len(t.parts)::bigint AS n_sentences, count(g.n) AS n_removed, sha256(coalesce(string_agg(c.part, '' ORDER BY c.n) FILTER (g.n IS NULL), '')) AS kept_sha256
  FROM t LEFT JOIN c ON c.doc_id = t.doc_id LEFT JOIN g ON g.doc_id = c.doc_id AND g.n = c.n GROUP BY t.doc_id, t.parts"""

#: The other operators hash, tokenize, train or pack, which SQL does not express. Ids of documents stand once.
ORACLE_SQL = {"op2_benchmark_leaks": _OP2, "op8_sentence_spans": _OP8}
