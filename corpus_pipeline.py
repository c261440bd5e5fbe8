"""A corpus pipeline: reject bad documents, remove repeated lines, keep one of near-duplicates, remove test items, pack what is left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. Between stages the documents are
stored, so a stage reads a table and a lost executor costs its own work only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.llm import decontamination, line_dedup, packing, quality, similar_texts, simhash
from ledgermill.llm.common import save


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more. Null and empty texts have a score too; null and repeated ids and repeated rows are scored each; without labels
    every score is 1/2, so all stay; of an empty table nothing."""
    stats, _ = save(quality.measured(docs), "stats")
    model = quality.fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of two lines or more that an earlier place keeps; ``n_chars`` follows the text. A null text stays null, a text of which nothing is
    left is empty; rows with a null id lose to documents with an id and keep nothing back; rows with equal ids don't lose to each other."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, texts of a similarity of 0.8 or more in their five-word shingles, that of the least id. Null and empty texts
    are copies of each other, as are texts without a word; of rows with equal ids one stays; rows with a null id stay."""
    return simhash.keep_one(docs, similar_texts.similar(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item, wholly or edited. Null and empty texts stay; of rows with equal ids, or without one, all go if one holds an item; without
    items all stay."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens. Null and empty texts give one piece, the end id; every row, with whatever id, keeps its pieces."""
    stored, _ = save(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces")
    return packing.pack(stored)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
