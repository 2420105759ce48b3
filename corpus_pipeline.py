"""From raw documents to packed training sequences, in five stages.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on everything that its predecessor kept.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import linededup, pii, setjoin, tokens, toxicity
from tidemark.llm.common import Scratch, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _recounted(docs: DataFrame, before: str = "text") -> DataFrame:
    """n_chars of the text as it is now; a null text keeps what it had."""
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance calls toxic go."""
    # learnt from the labelled documents of the raw table, whatever earlier stages did
    model = toxicity.fit(toxicity.training_sample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))
    scored = toxicity.score_documents(docs, model, keep=COLUMNS)
    return scored.where("predicted = 0").toDF("_id", "_score", "_predicted", *COLUMNS).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go; so does a document of which nothing is left."""
    out = linededup.dedup_lines(docs.select(*COLUMNS), removed_col="_removed")
    return _recounted(out.where("_removed = 0 or trim(text) <> ''"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group held together by links (five words, Jaccard 0.8) the document with the smallest id stays."""
    docs = docs.select(*COLUMNS)
    groups = setjoin.jaccard_join(docs, k=5, num=80, den=100)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = Scratch(spark, "duplicates").write(gone, "gone")
    return docs.join(gone.hint("merge"), F.col("doc_id") == F.col("_gone"), "left_anti").select(*COLUMNS)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets get surrogates."""
    return _recounted(pii.replace_entities(docs.select(*COLUMNS), pii.surrogate_key(spark)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row per piece of a document."""
    return tokens.pack_documents(docs, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("pii", replace_private),
    ("best_fit_packing", pack),
]

#: No SQL for compression distances, alignments or tokenizers; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
