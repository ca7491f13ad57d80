"""The queries ``opN_<name>`` of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskline.session import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duskline.llm.language_id import held_out
    from duskline.llm.toxicity import fit, score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    apart = held_out("doc_id", 4, 2)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~apart)
    model = fit(docs, labels)
    return score_toxicity(docs, model, without=("text",)).select("doc_id", apart.alias("held_out"), "score", "predicted", "toxic_spans")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duskline.llm.decontaminate import find_contaminated

    return find_contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


SQL_op2_decontaminate = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark WHERE text IS NOT NULL
), s AS (
  SELECT DISTINCT side, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN ['short ' || array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w
), n AS (SELECT id, count(*) AS n_item FROM s WHERE side = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, CAST(n.n_item AS INTEGER) AS n_item, CAST(count(*) AS INTEGER) AS n_common
FROM s d JOIN s i ON d.g = i.g AND d.side = 'd' AND i.side = 'i' JOIN n ON n.id = i.id
GROUP BY d.id, i.id, n.n_item
HAVING count(*) * 100 >= n.n_item * 80
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from duskline.llm.token_counts import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), without=("text",)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duskline.llm.language_id import held_out
    from duskline.llm.quality import fit, grade_texts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    apart = held_out("doc_id", 5, 0)
    # Graded ratings: 0 poor text, 1 good but toxic text, 2 good and clean text.
    grade = F.expr("case when quality = 0 then 0 when quality = 1 and coalesce(toxic, 0) = 1 then 1 when quality = 1 then 2 end")
    rated = table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade")).where(~apart)
    model = fit(docs, rated)
    return grade_texts(docs, model, without=("text",)).select("doc_id", apart.alias("held_out"), "expected_grade", "p_top", "p_pass", "selected")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from duskline.llm.packing import pack_documents
    from duskline.llm.token_counts import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), without=("text",)))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duskline.llm.fingerprints import add_near_groups, fingerprint_edits

    return add_near_groups(fingerprint_edits(table(spark, sf_dir, "documents")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duskline.llm.url_filter import fit, judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), fit(spark))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duskline.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duskline.llm.language_id import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    apart = held_out("doc_id", 5, 0)
    model = fit(docs.select("doc_id", "text", "lang").where(~apart))
    return identify(docs.select("doc_id", "text"), model, without=("text",)).select("doc_id", apart.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duskline.llm.secret_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), without=("text",))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from duskline.llm.token_alignment import align

    return align(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duskline.llm.stream_dedup import deduplicate

    return deduplicate(spark, f"{sf_dir.rstrip('/')}/documents.parquet")


SQL_op12_exact_dedup = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duskline.llm.spelling import count_words, group_variants

    return group_variants(count_words(table(spark, sf_dir, "documents").select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {k.removeprefix("SQL_"): v for k, v in globals().items() if k.startswith("SQL_")}
