"""The corpus pipeline: five stages over documents, each one operator of siftstone.llm.

Each stage takes (spark, docs, sf_dir), where docs are the rows its predecessor kept, and
returns a DataFrame that is written as Parquet and read again before the next stage. All but the last
return the columns of documents. Stages that hand whole texts to Python set Arrow batches of 2,000 rows and 1 MB and
scans of 512 rows at a time, unless the session has sizes of its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.llm import bayes_lsh, cnn, gam, positional_index, sp_agenda
from siftstone.llm.common import materialise, short_batches, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the additive model predicts to be of quality (score of 0.3 or more)."""
    short_batches(spark)
    model = gam.train(docs, table(spark, sf_dir, "labels"), "quality", folds=5, held_out=0)
    return gam.score(docs, model, 0.3, score_col="__score", predicted_col="__kept").filter("__kept = 1").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the convolutional classifier predicts to be toxic (score of 0.7 or more)."""
    short_batches(spark)
    model = cnn.train(docs, table(spark, sf_dir, "labels"), "toxic", folds=3, held_out=1)
    return cnn.score(docs, model, 0.7, score_col="__score", predicted_col="__toxic").filter("__toxic = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the one with the smallest id (of its texts the one with the smallest hash). Texts
    under one id are told apart; rows without an id or without words stay."""
    short_batches(spark)
    classes = bayes_lsh.similar_documents(docs, threshold=0.8, shingle=5, hashed=True)
    members = classes.filter("doc_id is not null and n_links > 0").groupBy("class_key", F.struct("doc_id", "h").alias("own")).agg(F.count("*").alias("n"))
    members = materialise(members, "members")
    first = members.groupBy("class_key").agg(F.min("own").alias("first"))
    named = members.join(first, "class_key").select(
        F.col("own.doc_id").alias("__id"), F.col("own.h").alias("__h"), "n", (F.col("own") != F.col("first")).alias("gone")
    )
    h = bayes_lsh.text_hash("text")

    def same(rows: DataFrame) -> Column:
        return (rows["doc_id"] == F.col("__id")) & (h == F.col("__h"))

    gone = named.filter("gone").select("__id", "__h")
    copied = materialise(named.filter("not gone and n > 1").select("__id", "__h"), "copied")
    kept = docs.join(gone, same(docs), "left_anti")
    if copied.isEmpty():
        return kept.select(*docs.columns)
    # Equal rows under one id: one of each stays, the least by its remaining columns.
    rest = F.to_json(F.struct(*docs.columns))
    place = F.row_number().over(Window.partitionBy("doc_id", h).orderBy(rest))
    one = docs.join(copied, same(docs), "left_semi").withColumn("__place", place).filter("__place = 1")
    return kept.join(copied, same(kept), "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten consecutive words of a benchmark item (or a whole shorter item)."""
    found = positional_index.contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    hit = found.filter("contaminated").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__h"))
    return docs.join(hit, same, "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with their digests and those of the decoded texts."""
    short_batches(spark)
    return sp_agenda.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), digests_only=True)


STAGES = [
    ("quality_classifier", quality),
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", tokens),
]

# The classifiers and the tokenizer can't be put into SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
