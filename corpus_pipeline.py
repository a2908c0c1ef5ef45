"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, packing.

Every stage takes all that its predecessor kept and applies its decisions. A stage is
``(spark, docs, sf_dir) -> DataFrame``; all but the last return the columns of ``docs``. ``run`` writes
each stage's result to the shared folder and reads it for the next, as a scheduler between stages would.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstone.llm import decontaminate, nearcopies, packing, quality, substrings
from veilstone.llm.common import save, table


CORE = ("doc_id", "text", "n_chars")


def apart(docs: DataFrame) -> DataFrame:
    """``docs`` with names of our own for all columns that no stage reads, so that what an operator adds can't
    take the place of one; stages give the names back."""
    return docs.toDF(*[c if c in CORE else f"own_{i}" for i, c in enumerate(docs.columns)])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from the labels of this input, predicts as good."""
    own = apart(docs)
    scored = quality.scored(own, table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 1").select(*own.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (five-word Jaccard similarity of 0.8 or more): the one of
    smallest doc_id, rows without an id last. Rows that share an id are told apart: each goes or stays by
    its own text."""
    own = apart(docs)
    return nearcopies.near_copies(own).filter("kept").select(*own.columns).toDF(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; documents of which nothing is left go,
    those that lose nothing keep their text as it is."""
    own = apart(docs)
    cut = substrings.without_repeats(own)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")).alias("text")
    kept = cut.filter("n_removed = 0 or n_words > n_removed").withColumn("__text", text)
    made = {"text": F.col("__text").alias("text"), "n_chars": F.length("__text").cast("long").alias("n_chars")}
    return kept.select(*[made.get(c, F.col(c)) for c in own.columns]).toDF(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that resembles a benchmark item. A row is named by a 64-bit hash of its
    text, on which alone the decision depends, so rows without an id or with a shared one get their own."""
    own = apart(docs)
    keyed = own.withColumn("__key", F.xxhash64("text"))
    leaks = decontaminate.contaminated(keyed.select(F.col("__key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(leaks.select(F.col("doc_id").alias("__key")).distinct(), "__key", "left_anti").select(*own.columns).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]
#: SQL can express neither the learned classifier nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = save(docs, name.replace(" ", "-"))
    return docs
