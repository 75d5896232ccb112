"""A training corpus from raw documents: five stages, each one operator over all rows of the last.

Rejected documents go, one document of each near-duplicate group stays, documents with benchmark items
go, personal data is replaced, and the rest is encoded. Each stage's result is a table of its own.

Cases, the same in every stage: a null text counts as empty; an empty text stays unless its group of copies has another
first, is never contaminated, holds no personal data, and encodes to no ids; long texts are read to their end; a null
or repeated ``doc_id`` is a row like any other, but the near-copy stage keeps one row of each group, the least id first
(nulls last), and of rows that agree in id and text any one; of texts that tie in score all stay or all go; an empty
table gives no rows after every stage; columns beyond those of ``documents``, whatever their names, pass through all
stages but the last, which returns the encoded columns alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plotline.llm import bpe, decontaminate, near_copies, pii, quality, simhash
from plotline.llm.common import materialize, ship, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Links at a 5-word Jaccard similarity of 0.8, which a SimHash of 64 bits at three bits (op10) does not reach."""
    ship(spark)
    return simhash.keep_first(docs, near_copies.near_copies(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pii.redact(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` of every document that is left."""
    ship(spark)
    coder = bpe.ByteBPE(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(coder.round_trip(docs.select("doc_id", "text")), "ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("pii", pii_redaction),
    ("byte-level bpe", bpe_encoding),
]

#: The classifier and the random field are fitted models, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
