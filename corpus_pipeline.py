"""A corpus from raw documents in five stages: toxic documents go, one of each near-duplicate group stays, contaminated
documents go, sources are mixed to target weights, and the token ids are written in a binary format.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents, whatever their names;
columns beside doc_id, text and source are carried along and may be null. Every stage takes an empty table and gives one,
works on very long texts whole, and takes repeated rows and rows without an id; what it does with these, and with null
and empty texts, is said with each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from handspan.llm import decontaminate, mixing, near_dedup, token_output, toxicity
from handspan.llm.shared import numbered, stored, workers_find_library

TOKENIZER = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on labelled ones, rejects go.

    Null and empty texts have no features, so they stay unless most labelled texts are toxic; without toxic labels all
    stay. Repeated rows, and rows without an id, are judged each by their own text.
    """
    workers_find_library(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the smallest id, stays: five words to a shingle, a similarity of 0.8 or more.

    Null texts, empty ones and those without words are near to nothing and stay, as do rows without an id. Rows that
    repeat an id are one document: they stay or go together.
    """
    workers_find_library(spark)
    return near_dedup.drop_near_duplicates(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark windows go.

    Null and empty texts have no words and stay; repeated rows, and rows without an id, are judged each.
    """
    workers_find_library(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; those of small sources are repeated to bring the sources' weights to the target.

    Documents without a source are a source of their own. Null and empty texts have no tokens: they come as often as
    their source's epochs. Repeated rows come each as often; rows without an id are dealt like one id.
    """
    workers_find_library(spark)
    plan = mixing.mixture(docs, public_tokenizers.path(TOKENIZER))
    names = docs.columns
    mixed = mixing.mix(numbered(docs), plan, key=f"c_{names.index('doc_id')}", source=f"c_{names.index('source')}")
    return mixed.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(names)])


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as bit-plane token files; one row per document as read back from them.

    Null and empty texts give the end id only; repeated rows are written each; rows without an id come first.
    """
    workers_find_library(spark)
    return token_output.token_digest(token_output.write_token_shards(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: The stages use trained models and tokenizers, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
