"""One query per operator, with its production parameters, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import linededup, pii, setjoin, tokens, toxicity, vectors, warc
from tidemark.llm.common import Scratch, read_table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.jaccard_join(read_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(read_table(spark, sf_dir, "documents").select("doc_id", "text"), pii.surrogate_key(spark), count_col="n_entities")


def op3_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_sample(docs, read_table(spark, sf_dir, "labels")))
    return toxicity.score_documents(docs, model).withColumn("held_out", toxicity.held_out(F.col("doc_id")))


def op4_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "archives")
    folder = scratch.path("warc")
    written = warc.write_archives(read_table(spark, sf_dir, "pages"), folder, scratch)
    return warc.read_archives(written, folder, payloads=False).drop("url")


def op5_token_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.length_histogram(tokens.token_lengths(read_table(spark, sf_dir, "documents")))


def op6_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), removed_col="n_removed_bytes")


def op7_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"), 0.93)


def op8_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(read_table(spark, sf_dir, "documents"), columns=("n_tokens", "ids_sha256", "decoded_sha256"))


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest_neighbours(read_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pack_documents(read_table(spark, sf_dir, "documents"), capacity=2048)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_surrogates, op3_compression_toxicity, op4_dictionary_warc, op5_token_length_histogram, op6_line_alignment, op7_sorted_projections, op8_bpe_trie, op9_nn_descent, op10_best_fit_packing)}

#: DuckDB SQL where it can express the operator.
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2]))) END AS s FROM w),
        x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p WHERE 100 * c >= 90 * (na + nb - c)),
        t AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, t.b FROM r JOIN t ON r.other = t.a),
        m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.class_id, m.component_id, (SELECT count(*) FROM t WHERE t.a = s.doc_id) AS n_links
        FROM s JOIN m ON s.doc_id = m.doc_id JOIN (
            SELECT doc_id, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(s)) END AS class_id FROM s) c ON s.doc_id = c.doc_id""",
    "op7_sorted_projections": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
        e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.93),
        r(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, e.b FROM r JOIN e ON r.other = e.a),
        m AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a)
        SELECT m.vec_id, coalesce(n_links, 0) AS n_links, component_id, m.vec_id = component_id AS kept FROM m LEFT JOIN n ON m.vec_id = n.vec_id""",
    "op4_dictionary_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT payload_digest, max(page_id) AS target FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
               CASE WHEN target IS NULL OR target = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN target <> page_id THEN target END AS refers_to
        FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest""",
}
