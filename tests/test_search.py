import math

import pytest
from pyspark.sql import functions as F

from siftstone.operators import index, ingest, summary
from siftstone.operators.cache import ResultCache
from siftstone.operators.search import Search, expand_synonyms
from siftstone.plans.query import Range, SearchQuery, bits, parse_params

DOCS = [
    (1, "a b c", "x", 10, 1, 0, 1.0, 0, 0),
    (2, "a b", "x", 20, 2, 1, 0.5, 0, 1),
    (3, "c d", "y", 30, 3, 2, 0.2, 0, 0),
    (4, "", None, None, 0, 0, 0.1, 0, 1),
    (5, "d d d d d d d", "y", 50, 4, 0, 0.3, -1, 0),
]
SCHEMA = "id long, text string, source string, n_chars long, category long, slevel int, rank double, status int, secid int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def built(docs):
    return index.build(docs)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_boolean_operators(built):
    run = lambda **k: ids(Search(built, SearchQuery(**k)).filtered)
    assert run(terms=("a", "c")) == [1, 2, 3]
    assert run(terms=("a", "c"), bool_and=True) == [1]
    assert run(terms=("a", "zzz"), bool_and=True) == []
    assert run(terms=("a",), not_terms=("c",)) == [2]
    assert run(terms=("a", "b", "c"), hit_scale=60) == [1, 2]
    assert run() == [1, 2, 3, 4]
    assert run(ignore_status=True) == [1, 2, 3, 4, 5]
    assert run(blocked_levels=(1, 2)) == [1, 4]
    assert run(category_all=3) == [3]
    assert run(category_block=1) == [2, 4]
    assert run(ranges=(Range("n_chars", 25, 15),)) == [2]


def test_or_holds_and_total_ignores_top(built):
    one = Search(built, SearchQuery(terms=("a", "c"), top=1, count=1))
    assert one.hits().count() == 1 and one.total().first()["total"] == 3
    assert set(ids(Search(built, SearchQuery(terms=("a", "c"), bool_and=True)).filtered)) <= set(ids(one.filtered))


def test_relevance_by_hand(built):
    s = Search(built, SearchQuery(terms=("d",), relevance="bm25"))
    got = {r["id"]: r["rel"] for r in s.scored().select("id", "rel").collect()}
    n, df, mean = 5, 2, (4 + 3 + 3 + 0 + 8) / 5
    idf = math.log((n - df + 0.5) / (df + 0.5))
    assert got[3] == pytest.approx(idf * 1 * 3 / (1 + 0.5 + 1.5 * 3 / mean))


def test_negative_idf_becomes_one(spark, docs):
    many = docs.filter("id <= 2")
    s = Search(index.build(many), SearchQuery(terms=("a",), relevance="bm25"))
    assert s.term_frame.first()["idf"] == 1.0


def test_phrase_counts_both_ends(built):
    s = Search(built, SearchQuery(terms=("a", "b"), phrase=True, base_phrase=1))
    assert {r["id"]: r["score"] for r in s.scored().select("id", "score").collect()} == {1: 4 * 10**8, 2: 4 * 10**8}


def test_facets_come_before_the_category_filter(built):
    s = Search(built, SearchQuery(terms=("a", "c"), category_any=1, category_facets=3))
    assert {r["bit"]: r["n"] for r in s.facets().collect()} == {0: 2, 1: 2}
    assert s.total().first()["total"] == 2


def test_stored_index_gives_the_same(spark, built, tmp_path):
    path = f"file://{tmp_path}/index"
    built.write(path)
    assert sorted(map(tuple, index.Index.read(spark, path).terms.collect())) == sorted(map(tuple, built.terms.collect()))
    q = SearchQuery(terms=("a", "d"), base_term=1)
    assert Search(index.Index.read(spark, path), q).hits().collect() == Search(built, q).hits().collect()


def test_query_string():
    q = parse_params("query=Some+Words&booland=1&rangefilter=2:[9,5],4:[,1.5]&in=2:[1,2]&bitfields=3[0,2]3{5}&keys=0:a|b&catfilter=1,5;9&multicat=1&order=-1&from=20&count=5&ntop=9999&display=0%23,1&zzz=1")
    assert q.terms == ("some", "words") and q.bool_and and q.descending and q.top == 2000
    assert q.ranges == (Range("n_chars", 5, 9), Range("rank", None, 1.5))
    assert q.in_lists == (("n_chars", (1, 2)),) and q.any_bits == (("category", 5),) and q.no_bits == (("category", 32),)
    assert q.field_terms == ((0, ("a",), ("b",)),) and q.category_all == bits("1,5;9") and q.category_any == 0
    assert q.display == (("text", True), ("source", False)) and q.unused == {"zzz": "1"}
    assert parse_params("").descending is False
    assert q.cache_key() == parse_params("query=Some+Words&booland=1&rangefilter=2:[9,5],4:[,1.5]&in=2:[1,2]&bitfields=3[0,2]3{5}&keys=0:a|b&catfilter=1,5;9&multicat=1&order=-1&from=0&count=7&ntop=9999").cache_key()


def test_upsert_cases_and_idempotence(spark):
    schema = "id long, version long, crc string, status int, rank double, body string"
    old = spark.createDataFrame([(1, 1, "a", 0, 1.0, "one"), (2, 1, "b", 0, 1.0, "two"), (3, 1, "c", 0, 1.0, "three")], schema)
    new = spark.createDataFrame([(1, 2, "a", 0, 9.0, "ignored"), (2, 2, "x", 0, 2.0, "TWO"), (3, 2, "z", -1, 5.0, "gone"), (4, 2, "d", 0, 1.0, "four")], schema)
    once = ingest.upsert(old, new)
    got = {r["id"]: (r["rank"], r["status"], r["body"]) for r in once.collect()}
    assert got == {1: (9.0, 0, "one"), 2: (2.0, 0, "TWO"), 3: (1.0, -1, "three"), 4: (1.0, 0, "four")}
    assert sorted(ingest.upsert(once, new).collect()) == sorted(once.collect())
    actions = {r["id"]: r["action"] for r in ingest.upsert_actions(old, new).collect()}
    assert actions == {1: "update", 2: "reindex", 3: "disable", 4: "insert"}


def test_merge_keeps_old_where_new_is_empty(spark):
    old = spark.createDataFrame([(1, "f1", "f2")], "id long, f1 string, f2 string")
    new = spark.createDataFrame([(1, "", "x")], "id long, f1 string, f2 string")
    assert tuple(ingest.merge_records(old, new, "id", ["f1", "f2"]).first()) == (1, "f1", "x")


def test_stale_changes_are_ignored_by_both(spark):
    schema = "id long, version long, crc string, status int, rank double, body string"
    old = spark.createDataFrame([(1, 5, "a", 0, 1.0, "one")], schema)
    late = spark.createDataFrame([(1, 4, "x", -1, 9.0, "late")], schema)
    assert ingest.upsert(old, late).collect() == old.collect()
    assert [r["action"] for r in ingest.upsert_actions(old, late).collect()] == ["ignore"]


def test_category_changes(spark):
    docs = spark.createDataFrame([(1, 5), (2, None), (3, 8), (4, None)], "id long, category long")
    rows = [(1, 1, "set", 2), (1, 2, "unset", 1), (1, 3, "set", 1), (1, 3, "unset", 4), (2, 1, "set", -(1 << 63)), (3, 1, "unset", 8), (3, 1, "set", 8), (None, 1, "set", 1), (9, 1, "set", 1), (4, 1, "set", None)]
    got = ingest.category_updates(docs, spark.createDataFrame(rows, "id long, seq long, op string, bits long"))
    assert {r["id"]: r["category"] for r in got.collect()} == {1: 3, 2: -(1 << 63), 3: 0, 4: None}


def test_limits_raise_and_nothing_is_dropped(spark):
    many = " ".join(f"w{i}" for i in range(33))
    for text in (f"query={many}", "in=2:[" + ",".join(map(str, range(600))) + "]"):
        with pytest.raises(ValueError, match="at most"):
            parse_params(text)
    syn = spark.createDataFrame([(1, "a"), *((1, f"s{i}") for i in range(100)), (None, "a"), (2, None)], "synid int, term string")
    assert len(expand_synonyms(("a",), syn, 200)) == 101 and expand_synonyms((), syn) == ()
    with pytest.raises(ValueError, match="synonyms"):
        expand_synonyms(("a",), syn)


def test_sections_databases_and_display(spark, built):
    q = parse_params("nosecs=1&dbid=2&display=0%23,2&op=1&qid=7&geofilter=x")
    assert (q.no_sections, q.database, q.clear_cache, q.query_id, q.unused) == ((1,), 2, True, "7", {"geofilter": "x"})
    assert ids(Search(built, SearchQuery(no_sections=(1,))).filtered) == [1, 3]
    s = Search(built, parse_params("query=a&bnterm=1&display=0%23,2&order=-1"))
    assert {r["id"]: r["json"] for r in s.response().collect()} == {1: '{"id":"1","text":"<b>a</b> b c","n_chars":"10"}', 2: '{"id":"2","text":"<b>a</b> b","n_chars":"20"}'}


def test_result_cache(built):
    now = [0.0]
    cache = ResultCache(built, lifetime=10, most=2, clock=lambda: now[0])
    page = lambda text: [tuple(r) for r in cache.run(text).orderBy("id").collect()]
    full = page("query=a+c&bnterm=1&order=-1")
    assert len(full) == 3 and cache.state() == {"queries": 1, "cache_hits": 0, "hits_scale": 0.0}
    parts = [page(f"query=a+c&bnterm=1&order=-1&from={k}&count=1") for k in range(4)]
    assert sorted(sum(parts, [])) == sorted(full) and parts[3] == [] and cache.hits == 4
    assert [p[0] for p in parts[:3]] == [tuple(r) for r in Search(built, parse_params("query=a+c&bnterm=1&order=-1")).hits().collect()]
    now[0] = 11
    page("query=a+c&bnterm=1&order=-1")
    assert cache.hits == 4
    page("query=a+c&bnterm=1&order=-1&op=1"), page("query=b"), page("query=d")
    assert cache.hits == 4 and len(cache.entries) == 2
    cache.clear()
    assert not cache.entries


def test_index_update_equals_a_new_index(spark, docs, built):
    changed = spark.createDataFrame([(1, "b b z", "x", 10, 1, 0, 1.0, 0, 0), (2, "a b", "x", 20, 2, 1, 0.5, -1, 1), (9, "new a", "y", 1, 1, 0, 1.0, 0, 0)], SCHEMA)
    after = index.update(built, changed)
    gone = docs.filter("id = 2").withColumn("status", F.lit(-1)).withColumns({"text": F.lit(""), "source": F.lit("")})
    fresh = index.build(docs.filter("id > 2").unionByName(changed.filter("id <> 2")).unionByName(gone))
    for name in ("postings", "bigrams", "terms", "stats"):
        a, b = getattr(after, name), getattr(fresh, name)
        assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect())), name
    assert {r["id"]: r["terms_total"] for r in after.docs.collect()}[2] == 0
    none = index.update(built, docs.limit(0))
    assert sorted(map(tuple, none.terms.collect())) == sorted(map(tuple, built.terms.collect()))


def test_phrases_count_in_every_text_field(spark):
    docs = spark.createDataFrame([(1, "a b", "a b", 1, 0, 0, 1.0, 0, 0), (2, "x", "a b", 1, 0, 0, 1.0, 0, 0), (3, "b a", None, 1, 0, 0, 1.0, 0, 0)], SCHEMA)
    s = Search(index.build(docs), SearchQuery(terms=("a", "b"), phrase=True, base_phrase=1, hit_fields=2))
    assert {r["id"]: r["score"] // 10**8 for r in s.scored().select("id", "score").collect()} == {1: 12, 2: 12, 3: 0}


def test_a_line_of_many_neighbouring_hits(spark):
    docs = spark.createDataFrame([(1, "a b " * 300)], "id long, text string")
    found = summary.passages(docs, [("a", 2.5), ("b", 1.5)])
    assert [(r["hits"], r["score"]) for r in found.collect()] == [(600, (1200 + 599 * 10 + 2) * 10**6)]
    assert summary.best_passages(found).first()["summary"] == "a b " * 300


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_and_positions_are_made_inside_rows(spark, docs):
    for found in (index.postings(docs), index.positions(docs)):
        assert "Exchange" not in plan(found) and found.count() > 0


def test_postings_and_positions_of_rows_that_share_an_id(spark):
    rows = [(1, "B a b, c", "a x"), (2, "a", None), (1, "c a", "x"), (None, "n", ""), (None, "n m", "n"), (3, None, None), (4, "", "z Z")]
    docs = spark.createDataFrame(rows, "id long, text string, source string")
    got = {(r["id"], r["term"]): (r["tf"], r["field_bits"]) for r in index.postings(docs).collect()}
    assert got == {(1, "a"): (3, 3), (1, "b"): (2, 1), (1, "c"): (2, 1), (1, "x"): (2, 2), (2, "a"): (1, 1), (None, "n"): (3, 3), (None, "m"): (1, 1), (4, "z"): (2, 2)}
    got = {(r["id"], r["term"]): r["positions"] for r in index.positions(docs).collect()}
    assert got == {(1, "a"): [1, 1], (1, "b"): [0, 2], (1, "c"): [0, 3], (2, "a"): [0], (None, "n"): [0, 0], (None, "m"): [1]}


def test_a_search_stores_the_tables_that_it_reads(spark, docs, built, tmp_path):
    stored = index.StoredIndex(spark, str(tmp_path / "i"), lambda: index.build(docs))
    names = lambda: sorted(p.name for p in (tmp_path / "i").iterdir())
    assert ids(Search(stored, SearchQuery(rank=True, base_rank=10)).scored()) == [1, 2, 3, 4] and names() == ["docs"]
    assert ids(Search(stored, SearchQuery(terms=("a", "c"))).filtered) == [1, 2, 3] and names() == ["docs", "postings", "stats", "terms"]
    assert sorted(map(tuple, stored.terms.collect())) == sorted(map(tuple, built.terms.collect()))


def test_updated_terms_need_no_stored_postings(spark, docs, built, tmp_path):
    stored = index.StoredIndex(spark, str(tmp_path / "i"), lambda: index.build(docs))
    changed = docs.filter("id <> 3").withColumns({"status": F.when(F.col("id") == 1, -1).otherwise(0), "text": F.col("source")})
    after = index.updated_terms(stored, changed)
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, index.update(built, changed).terms.collect()))
    assert {r["term"]: (r["df"], r["total"]) for r in after.collect()} == {"x": (1, 2), "y": (2, 3), "c": (1, 1), "d": (1, 1)}
    assert sorted(p.name for p in (tmp_path / "i").iterdir()) == ["docs", "terms"]
