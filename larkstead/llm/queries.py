"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hmm, jaccard, knn, line_dedup, media, mixing, packing, quality, token_counts, toxicity
from .common import saved, table
from .labelled import remainder

WORD = r"[^\x20\x09-\x0D]+"
SEQUENCE = 4096


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, 10)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenise(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), SEQUENCE, keep_ids=False)
    return packing.pack(saved(pieces), SEQUENCE).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", size.alias("size"))
    return mixing.mix(saved(docs)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), 4, 85, 100).select("doc_id", "n_shingles", "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), remainder("doc_id", 3) == 1
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held)
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), remainder("doc_id", 10) == 0
    words = hmm.vocabulary(docs.where(~held).select(F.col("text").alias("t")))
    encoded = saved(hmm.encode(docs, words, held))
    return hmm.score(encoded, words, hmm.train(encoded.where("not held_out")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), remainder("doc_id", 5) == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_texts(table(spark, sf_dir, "documents"))
    seen = media.inspect_media(stored, ["doc_id", "n_bytes"])
    return seen.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.size("carved").cast("long").alias("n_carved"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), least=line_dedup.LEAST).select("doc_id", "text", "n_removed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_token_counts, op2_exact_topk, op3_best_fit_packing, op4_mixing, op5_jaccard_join, op6_quality,
        op7_lm_scoring, op8_toxicity, op9_media_columns, op10_line_dedup,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op2_exact_topk": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
            FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op5_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, sh FROM (
                SELECT doc_id, unnest(CASE WHEN len(a) >= 4 THEN list_transform(range(1, len(a) - 2), lambda i: array_to_string(a[i:i + 3], ' '))
                    WHEN len(a) > 0 THEN [array_to_string(a, ' ')] END) AS sh FROM w)
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), p AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL
        ), e AS (
            SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
        ), r AS (
            SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
        )
        SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.least AS component_id
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(b) AS least FROM r GROUP BY a) c ON c.a = w.doc_id
    """,
}
