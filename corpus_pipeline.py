"""A corpus pipeline: toxicity, quality, exact deduplication, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Every stage works on all that the one before kept, written as Parquet and read again.
Columns of any other names go through unread, also where they are named like a stage's own; an empty
table gives an empty table; null texts are empty; null ids are told apart by their texts.
"""

from __future__ import annotations

from itertools import count

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import drop_written, table, text_of, written
from sievework.llm.exact_dedup import exact_dedup
from sievework.llm.ngram_jaccard import jaccard_components
from sievework.llm.packing import pack
from sievework.llm.quality import fit_quality, rows_with_quality
from sievework.llm.queries import GOOD_FROM, TOXIC_FROM
from sievework.llm.toxicity import fit_toxicity, rows_with_toxicity


def _keyed(docs: DataFrame) -> DataFrame:
    """row (docs' columns) with what tells rows apart: the id (null is an id too) and the text's digest."""
    return docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").isNull().alias("none"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.sha2(text_of("text").cast("binary"), 256).alias("digest"),
    )


KEYS = ["none", "id", "digest"]


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs with one of these KEYS, with docs' columns. Of rows equal in id and text one
    stays, the least by its columns, so that the choice cannot change between runs.
    The rows are partitioned by one key for the join and for leaving repeated rows out."""
    kept = _keyed(docs).join(keys, KEYS, "left_semi")
    return kept.groupBy(*KEYS).agg(F.min("row").alias("row")).select("row.*")


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(number, text) of docs' rows, and (number, doc_id, KEYS) with one row for each number. A number
    stands for an id and a text; where ids are null it is null. Numbers are hashes, so they are drawn
    anew should two rows that differ share one."""
    rows = _keyed(docs)
    for seed in count():
        number = F.when(~F.col("none"), F.xxhash64("id", "digest", F.lit(seed)))
        what = F.struct(F.col("row.doc_id").alias("doc_id"), *KEYS)
        both = rows.where("NOT none").select(number.alias("number"), what.alias("what")).groupBy("number")
        names = written(both.agg(F.min("what").alias("what"), F.max("what").alias("other")), "numbers")
        if names.where("what <> other").isEmpty():
            return rows.select(number.alias("number"), F.col("row.text").alias("text")), names.select("number", "what.*")
        drop_written(names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. It learns from the labels of the input."""
    scores = rows_with_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scores.where(F.col("score") < TOXIC_FROM).select("row.*")


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    scores = rows_with_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scores.where(F.col("score") >= GOOD_FROM).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; a row repeated with its id stays once. Rows
    that share an id, or have none, but differ in their texts are judged apart."""
    kept = exact_dedup(docs).where("kept")
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return _only(docs, kept.select(F.col("doc_id").isNull().alias("none"), id_.alias("id"), F.col("text_sha256").alias("digest")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays, and of its texts, should
    it have several in the group, the one with the least digest. Groups are made of rows: texts that
    share an id are linked only by being similar. A row without an id is similar to none and stays."""
    texts, names = _numbered(docs)
    groups = jaccard_components(texts, id_col="number").join(names, "number")
    first = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", *KEYS)).alias("first"))
    kept = first.select(*(F.col(f"first.{k}").alias(k) for k in KEYS))
    without = _keyed(docs).where("none").select(*KEYS)
    return _only(docs, kept.unionByName(without))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in windows of 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_bad),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("packing", pack_windows),
]

#: Classifiers and packing have no SQL; tests/llm/ compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. A stage's table is deleted once the next stage has been written from it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
