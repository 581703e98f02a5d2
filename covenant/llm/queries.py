"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat_format, gumbel, langid, packing, simhash, tiff, token_counts, toxicity, warc


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.swapped_answers(read(spark, sf_dir, "conversations"))
    found = chat_format.preference_examples(turns)
    return found.select(
        "pair_id", "n_common", "prompt", "chosen", "rejected", "identical",
        chat_format.mask_text(F.col("chosen_mask")).alias("chosen_mask"),
        chat_format.mask_text(F.col("rejected_mask")).alias("rejected_mask"),
    )


def op3_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.round_trip(read(spark, sf_dir, "documents"))


def op4_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gumbel.sampled_segmentations(read(spark, sf_dir, "documents"))


def op5_warc_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"
    )


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.predicted(docs, langid.fit(docs))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_preference_format": op2_preference_format,
        "op3_tiff_media": op3_tiff_media,
        "op4_gumbel_segmentations": op4_gumbel_segmentations,
        "op5_warc_reader": op5_warc_reader,
        "op6_simhash_near_dedup": op6_simhash_near_dedup,
        "op7_anisotropic_ann": op7_anisotropic_ann,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_language_id": op9_language_id,
        "op10_token_counts": op10_token_counts,
    }


ORACLE = {
    "op2_preference_format": """
        WITH t AS (
            SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role,
                replace(coalesce(text, ''), '<|im_', '<|' || chr(8203) || 'im_') AS text
            FROM conversations
        ), a AS (
            SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS answer
            FROM t WHERE role = 'assistant' GROUP BY conv_id
        ), n AS (
            SELECT a.conv_id, a.last_turn, coalesce(o.answer, '') AS other
            FROM a LEFT JOIN a AS o ON o.conv_id = xor(a.conv_id, 1)
        ), b AS (
            SELECT t.conv_id, t.role, t.text,
                CASE WHEN t.role = 'assistant' AND t.turn = n.last_turn THEN n.other ELSE t.text END AS other,
                row_number() OVER (PARTITION BY t.conv_id ORDER BY t.turn, t.role, t.text) AS pos
            FROM t LEFT JOIN n USING (conv_id)
        ), d AS (
            SELECT *, coalesce(min(CASE WHEN text <> other THEN pos END) OVER (PARTITION BY conv_id) - 1,
                count(*) OVER (PARTITION BY conv_id)) AS n_common,
                '<|im_start|>' || role || chr(10) AS head, '<|im_end|>' || chr(10) AS tail,
                CASE WHEN role = 'assistant' THEN ':1' ELSE ':0' END AS flag
            FROM b
        )
        SELECT conv_id AS pair_id, CAST(min(n_common) AS INTEGER) AS n_common,
            coalesce(string_agg(head || text || tail, '' ORDER BY pos) FILTER (WHERE pos <= n_common), '') AS prompt,
            coalesce(string_agg(head || text || tail, '' ORDER BY pos) FILTER (WHERE pos > n_common), '') AS chosen,
            coalesce(string_agg(head || other || tail, '' ORDER BY pos) FILTER (WHERE pos > n_common), '') AS rejected,
            count(*) FILTER (WHERE pos > n_common) = 0 AS identical,
            coalesce(string_agg(length(head) || ':0,' || length(text || tail) || flag, ',' ORDER BY pos)
                FILTER (WHERE pos > n_common), '') AS chosen_mask,
            coalesce(string_agg(length(head) || ':0,' || length(other || tail) || flag, ',' ORDER BY pos)
                FILTER (WHERE pos > n_common), '') AS rejected_mask
        FROM d GROUP BY conv_id""",
    "op5_warc_reader": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html FROM pages
        ), d AS (
            SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p
        ), f AS (
            SELECT *, CASE WHEN payload_bytes >= 100
                THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS first_id
            FROM d
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
            TRUE AS verified
        FROM f""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
