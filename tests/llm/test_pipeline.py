"""The pipeline's stages on awkward rows and against brute force."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from test_operators import AWKWARD, brute_contamination, brute_links

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark, documents):
    rows = [(i, t, "en", "s", None, "x", 1) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, predicted int")


def test_stage_list():
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_the_columns(spark, awkward, name, stage):
    for docs in (awkward, awkward.filter("false")):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.count() <= docs.count()
        assert got.exceptAll(docs).count() == 0


def test_near_duplicates_leave_one_of_each_class(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, documents, SF).select("doc_id").collect()}
    assert kept == {c for _, c, _ in brute_links(rows)}


def test_near_duplicates_tell_texts_under_one_id_apart(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(20)) for x in "abcd")
    # 5 holds a copy of 1's text and a text of its own; the class of b has its smallest id in 5's second text.
    rows = [(1, a), (5, a), (5, c), (5, b), (9, b), (7, d), (7, d), (7, d + " end"), (None, a), (None, a), (8, ""), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((i, t) for i, t in corpus_pipeline.near_duplicates(spark, docs, SF).collect()), key=repr)
    ends = {t for i, t in got if i == 7}
    assert len([1 for i, _ in got if i == 7]) == 1 and ends <= {d, d + " end"}
    assert [x for x in got if x[0] != 7] == sorted([(1, a), (5, c), (5, b), (None, a), (None, a), (8, ""), (8, "")], key=repr)


def test_decontamination_drops_what_brute_force_finds(spark, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    clean = {r[0] for r in brute_contamination(rows, items) if not r[-1]}
    assert {r["doc_id"] for r in corpus_pipeline.decontamination(spark, documents, SF).select("doc_id").collect()} == clean


def test_run_ends_with_the_library_ids(spark, documents):
    got = corpus_pipeline.run(spark, SF).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert 0 < len(got) < len(texts)
    for r in got:
        ids = np.array(sp.encode(texts[r["doc_id"]], add_bos=True, add_eos=True), "<u4").tobytes()
        assert r["ids_sha256"] == hashlib.sha256(ids).hexdigest()
