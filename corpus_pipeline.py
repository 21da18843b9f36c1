"""A corpus pipeline of five stages: each reads what the one before has kept and its decisions take effect.

language   documents in none of the known languages go
exact      of equal texts the row with the largest doc_id stays
near       of near-duplicates the row with the smallest doc_id stays
mix        sources are read as often as the target weights say, every document at least once
encode     whole texts become token ids

The columns are those of documents until the last stage, which returns one row for each document read with its ids.

Defined results: a null or empty text has no language, so its row goes in the first stage; very long texts are read whole.
Rows with a null doc_id or source take part like others: of equal texts a row with an id stays before one without, of near
copies too. Ties of ids are broken by the row's place. Repeated rows are exact copies, of which one stays. Empty tables
give an empty result; without pages no document declares a language. Extra columns pass through; the last stage's ids and
n_tokens take the place of columns with these names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from concordat.llm import bpe, exact_stream, langid, mixing, queries, simhash
from concordat.llm.shared import scratch
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Differing bits at which fingerprints of three-word shingles propose links. README.md has the measured recall and precision.
NEAR_RADIUS = 6
#: Links count at this Jaccard similarity of the sets of five-word shingles.
NEAR_SIMILARITY = 0.8


#: What a Python worker takes at once: whole texts may be long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def _bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage under BATCH. Its result runs later, so the session keeps these limits."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for k, v in BATCH.items():
            spark.conf.set(k, v)
        return stage(spark, docs, sf_dir)

    return run_stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, queries.language_evidence(spark, sf_dir), queries.LANGUAGES)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_stream.keep_last(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Near copies whose five-word shingles are 0.8 alike differ in some 4 to 12 bits: a wider radius than query 7's proposes
    # more of them, and the texts themselves decide.
    return simhash.keep_first(docs, radius=NEAR_RADIUS, similarity=NEAR_SIMILARITY, compared=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.plan(docs, **queries.MIX), carry=tuple(docs.columns)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path(queries.BPE_50K)
    kept = tuple(c for c in docs.columns if c not in ("text", "n_tokens"))
    rows = bpe.encode(docs, vocabulary, bpe.ship_lexicon(docs, vocabulary), carry=kept)
    return rows.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("bigint"))


STAGES = [(f.__name__, _bounded(f)) for f in (language, exact, near, mix, encode)]
#: The language model, the fingerprints and the token ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
