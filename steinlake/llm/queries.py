"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, prepared, table


def op1_feistel_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .training_order import training_order

    return training_order(table(spark, sf_dir, "documents")).drop("file")


def op2_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate

    prepared(spark)
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op3_lsh_forest_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_and_read

    return archive_and_read(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_karmarkar_karp_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op7_script_viterbi_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_stupid_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import backoff_scores

    scored = backoff_scores(table(spark, sf_dir, "documents"))
    share = F.when(F.col("n_words") > 0, F.col("n_seen") / F.col("n_words")).otherwise(0.0)
    return scored.select("doc_id", "n_words", "n_seen", F.round("log_score", 3).alias("log_score"), share.alias("seen_share"))


def op9_voronoi_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import knn_join

    rows = table(spark, sf_dir, "embeddings")
    return knn_join(rows, F.col("vec_id") % 20 == 0)


def op10_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_license_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("places", "expressions")


def op12_refined_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_four_russians_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import mine_negatives

    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES = {
    f.__name__: f
    for f in (
        op1_feistel_training_order,
        op2_wu_manber_decontamination,
        op3_lsh_forest_near_dedup,
        op4_seekable_warc,
        op5_best_fit_packing,
        op6_karmarkar_karp_sharding,
        op7_script_viterbi_language_id,
        op8_stupid_backoff_scores,
        op9_voronoi_knn_join,
        op10_kneser_ney_toxicity,
        op11_license_expressions,
        op12_refined_whitening,
        op13_four_russians_negatives,
    )
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"

ORACLE_SQL: dict[str, str] = {
    "op2_wu_manber_decontamination": f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS.format('[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format('[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')} AS w FROM benchmark),
items AS MATERIALIZED (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM items),
grams AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM
  (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= k)),
hits AS MATERIALIZED (SELECT doc_id, i, g.k, item_id FROM grams g JOIN items USING (k, g)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""",
    "op3_lsh_forest_near_dedup": f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS.format('[^\\x20\\x09-\\x0D]+')} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM
  (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_in FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * both_in >= 85 * (p.n + q.n - both_in)),
reach AS (SELECT x AS doc_id, x AS other FROM (SELECT DISTINCT x FROM links) UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other),
least_id AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_id USING (doc_id)""",
    "op4_seekable_warc": """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS h FROM pages),
m AS (SELECT h, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN m USING (h)""",
    "op13_four_russians_negatives": """
WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM
  (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op8_stupid_backoff_scores": f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS.format('[^\\x20\\x09-\\x0D]+')} AS w FROM documents),
t AS MATERIALIZED (SELECT doc_id, i, w[i] AS g1, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS g2, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS g3,
  CASE WHEN i > 1 THEN w[i - 1] END AS h1, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] END AS h2 FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c1 AS (SELECT g1 AS g, count(*) AS n FROM t GROUP BY 1), c2 AS (SELECT g2 AS g, count(*) AS n FROM t WHERE g2 IS NOT NULL GROUP BY 1), c3 AS (SELECT g3 AS g, count(*) AS n FROM t WHERE g3 IS NOT NULL GROUP BY 1),
s AS (SELECT doc_id, CASE WHEN c3.n >= 2 THEN 1 ELSE 0 END AS seen, CASE WHEN c3.n >= 2 THEN ln(c3.n) - ln(k2.n) WHEN c2.n >= 2 THEN ln(c2.n) - ln(k1.n) + CASE WHEN g3 IS NULL THEN 0 ELSE ln(0.4) END
  ELSE ln(c1.n) - ln((SELECT count(*) FROM t)) + CASE WHEN g2 IS NULL THEN 0 ELSE ln(0.4) END + CASE WHEN g3 IS NULL THEN 0 ELSE ln(0.4) END END AS v
  FROM t JOIN c1 ON c1.g = g1 LEFT JOIN c2 ON c2.g = g2 LEFT JOIN c3 ON c3.g = g3 LEFT JOIN c1 k1 ON k1.g = h1 LEFT JOIN c2 k2 ON k2.g = h2),
r AS (SELECT doc_id, count(*) AS n_words, sum(seen) AS n_seen, sum(v) AS v FROM s GROUP BY 1)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_seen, 0) AS BIGINT) AS n_seen, round(coalesce(v, 0.0), 3) AS log_score,
  coalesce(CAST(n_seen AS DOUBLE) / n_words, 0.0) AS seen_share FROM d LEFT JOIN r USING (doc_id)""",
    "op9_voronoi_knn_join": """
WITH e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20""",
}
