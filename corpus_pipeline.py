"""Corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again for the next one. All
but the last return the columns of ``docs``, whatever their names. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskline.llm.arrow_map import filter_by_ids, spare_name
from duskline.llm.decontaminate import drop_contaminated
from duskline.llm.language_id import fit, identify
from duskline.llm.near_dedup import near_duplicates
from duskline.llm.packing import pack_documents
from duskline.llm.secret_scan import scan_secrets
from duskline.llm.token_counts import count_tokens
from duskline.session import checkpoint_dir, remove, table

#: Documents whose best language has less of the probability than this are rejected, as are those without a letter.
LEAST_LANGUAGE_SHARE = 0.5


def _with_own_names(docs: DataFrame, step, names: tuple[str, ...]) -> DataFrame:
    """``step`` on ``docs`` with columns that clash with the step's new ones set aside and put back."""
    aside = {c: spare_name(docs, f"_aside_{c}") for c in docs.columns if c.lower() in names}
    return step(docs.withColumnsRenamed(aside)).select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language. Null, empty and letterless texts go; repeated rows are judged each, alike if
    their texts are; the model is learnt from the labelled rows of ``docs``. Without any label all documents go."""
    model = fit(docs.select("doc_id", "text", "lang"))

    def step(df: DataFrame) -> DataFrame:
        return identify(df, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SHARE))

    return _with_own_names(docs, step, ("lang_pred", "score", "bits_per_byte"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8): the one with the smallest id. Rows without id
    or without words stay; rows that repeat an id stay or go together."""
    repeated = near_duplicates(docs).where("not kept").select("doc_id")
    return filter_by_ids(docs, repeated, "doc_id", keep=False)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and wordless texts hold none; rows without id stay; rows that repeat an id
    stay or go together."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; ``n_chars`` follows the text. Null texts stay null, repeated rows are masked each."""

    def step(df: DataFrame) -> DataFrame:
        out = scan_secrets(df, redacted=True)
        return out.withColumn("n_chars", F.when(F.col("spans") != "", F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))) if "n_chars" in df.columns else out

    return _with_own_names(docs, step, ("n_assign", "n_access", "n_hex", "base_sha256", "spans"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences. A document without tokens has one row without a piece; repeated rows and rows
    without id are packed each."""
    import public_tokenizers

    return pack_documents(count_tokens(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), without=("text",)))


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("best_fit_packing", packing_stage),
]

#: Language models and packing are beyond SQL; the pipeline is tested against a brute-force version of all its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what passes between them lies in the shared checkpoint folder until the next
    stage is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
        if i:
            remove(spark, f"{folder}/{i - 1}_{STAGES[i - 1][0]}")
    return docs
