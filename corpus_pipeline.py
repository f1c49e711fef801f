"""The corpus pipeline: quality rules, near-duplicates, secrets, mixture, tokens; each stage takes what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import bpe, minhash, mixture, quality_rules, secret_scan
from cloakframe.llm.common import saved, shared_dir

TOKENIZER = "word_bpe_49k.json"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.filter_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: candidates by fingerprint blocks and by bands, links by exact 5-word similarity of 0.8 or more."""
    return minhash.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced and n_chars counted anew where the text changed."""
    old = max(docs.columns, key=len) + "_"  # a name that no column has
    out = secret_scan.redact(docs.withColumn(old, F.length("text")), shared_dir(spark))
    n = F.when(F.col(f"`{old}`").eqNullSafe(F.length("text")), F.col("n_chars")).otherwise(F.length("text"))
    return out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType)).drop(old)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixture.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row: doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    rows = bpe.encode(docs, public_tokenizers.path(TOKENIZER), keep=("doc_id", "lang", "source"))
    return rows.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long")).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("quality_rules", keep_good),
    ("near_duplicates", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
    ("tokens", encode_tokens),
]

# Near-duplicates and tokens can't be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
