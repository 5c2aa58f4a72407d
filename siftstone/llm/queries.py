"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bayes_lsh,
    cnn,
    gam,
    histogram_sort,
    kmeans_tree,
    license_join,
    positional_index,
    rans,
    sp_agenda,
    template_html,
)
from .common import table


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = rans.new_path(spark)
    rans.encode(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path, end_id=0
    )
    return rans.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    index = kmeans_tree.build(vectors, k=20)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return kmeans_tree.search(index, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scan(table(spark, sf_dir, "documents")).drop("spans")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional_index.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, slop=5
    )
    return found.drop("h", "items")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = gam.train(docs, table(spark, sf_dir, "labels"), "quality", folds=5, held_out=0)
    return gam.score(docs, model, 0.3, keep=["doc_id"]).select(
        "doc_id", (gam.fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted"
    )


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes_lsh.similar_documents(table(spark, sf_dir, "documents"), threshold=0.8, shingle=5)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = cnn.train(docs, table(spark, sf_dir, "labels"), "toxic", folds=3, held_out=1)
    return cnn.score(docs, model, 0.7, keep=["doc_id"]).select(
        "doc_id", (gam.fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted"
    )


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_html.extract(table(spark, sf_dir, "pages")).drop("n_template")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_agenda.encode_decode(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digests_only=True
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = histogram_sort.shard(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_ids": op1_token_ids,
    "op2_nearest": op2_nearest,
    "op3_license_scan": op3_license_scan,
    "op4_decontamination": op4_decontamination,
    "op5_quality": op5_quality,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_toxicity": op9_toxicity,
    "op6_html_text": op6_html_text,
    "op7_sentencepiece": op7_sentencepiece,
    "op10_sharding": op10_sharding,
}
