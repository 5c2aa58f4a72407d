"""Registered queries of the search, crawl and ingest operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import markup, text
from .operators import crawl, index, ingest, segment, summary
from .operators.cache import ResultCache
from .operators.search import Search, expand_synonyms, facet_counts, group_counts
from .plans.query import Range, SearchQuery, parse_params
from .sources import dumps
from .storage import fingerprint, shared_dir
from .streaming import flows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TERMS = ("thing", "erin", "thnt")
SYNONYMS = [(1, "thing"), (1, "thnt"), (2, "erin"), (2, "eron")]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and labels as a collection: id, text, source, n_chars, category bits, slevel, rank, status, secid."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    language = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in (("en", 1), ("de", 2), ("fr", 4), ("es", 8)) for x in kv)), F.col("lang")), F.lit(0))
    bits = language + F.when(F.col("quality") == 1, 16).otherwise(0) + F.when(F.col("toxic") == 1, 32).otherwise(0)
    return (
        table(spark, sf_dir, "documents")
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("id"),
            "text",
            "source",
            "lang",
            "n_chars",
            bits.cast("long").alias("category"),
            F.coalesce("toxic", F.lit(0)).alias("slevel"),
            (F.lit(1.0) / (F.col("doc_id") + 1)).alias("rank"),
            F.when(F.col("doc_id") % 17 == 0, -1).when(F.col("doc_id") % 5 == 0, 1).otherwise(0).alias("status"),
            (F.col("doc_id") % 4).alias("secid"),
            (F.col("doc_id") % 3).alias("dbid"),
        )
    )


_STORED: dict[tuple[str, str, str], str] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> index.StoredIndex:
    """The index of the whole collection; each of its tables is written once for the tables as they are, when a search first
    reads it, and read by every later search."""
    version = fingerprint(spark, [f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet"])
    key = (spark.sparkContext.applicationId, sf_dir, version)
    path = _STORED.setdefault(key, shared_dir(spark, "index"))
    return index.StoredIndex(spark, path, lambda: index.build(documents(spark, sf_dir)))


def search(spark: SparkSession, sf_dir: str, q: SearchQuery, **more) -> Search:
    return Search(stored_index(spark, sf_dir), q, **more)


def matched_ids(s: Search) -> DataFrame:
    return s.filtered.select("id")


# --- term search, boolean operators -------------------------------------------------------------


@query
def term_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = search(spark, sf_dir, SearchQuery(terms=TERMS, relevance="reference", count=20))
    return s.scored().select("id", F.round(F.col("rel") * 1e8, 2).alias("rel"), "category").orderBy(F.desc("rel"), "id").limit(20)


@query
def bm25_textbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = search(spark, sf_dir, SearchQuery(terms=TERMS, relevance="bm25"))
    return s.scored().select("id", F.round("rel", 6).alias("rel"))


@query
def bool_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, sf_dir, SearchQuery(terms=TERMS)).filtered.select("id", "n_hits")


@query
def bool_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_ids(search(spark, sf_dir, SearchQuery(terms=TERMS, bool_and=True)))


@query
def bool_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_ids(search(spark, sf_dir, SearchQuery(terms=("thing",), not_terms=("erin", "thnt"))))


@query
def min_should_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, sf_dir, SearchQuery(terms=TERMS, hit_scale=60)).filtered.select("id", "n_hits")


@query
def field_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, sf_dir, SearchQuery(terms=("thing", "src1"), field_mask=2)).filtered.select("id", "hit_bits")


@query
def keys_per_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_ids(search(spark, sf_dir, parse_params("keys=0:thing|erin,1:src0")))


@query
def synonym_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = expand_synonyms(("thing", "erin"), spark.createDataFrame(SYNONYMS, "synid int, term string"))
    return search(spark, sf_dir, SearchQuery(terms=terms)).filtered.select("id", "n_hits")


@query
def block_term_forbidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_ids(search(spark, sf_dir, SearchQuery(terms=("thing", "erin")), blocked=frozenset({"erin"})))


@query
def ignore_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_ids(search(spark, sf_dir, SearchQuery(terms=("thing",), ignore_status=True)))


# --- index ---------------------------------------------------------------------------------------


@query
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(documents(spark, sf_dir))


@query
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.terms(index.postings(documents(spark, sf_dir)))


@query
def term_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.positions(documents(spark, sf_dir)).select("id", "term", F.concat_ws(",", F.col("positions").cast("array<string>")).alias("positions"))


@query
def term_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.bigrams(documents(spark, sf_dir)).filter("field_bit = 1").drop("field_bit")


@query
def doc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", index.length().cast("long").alias("terms_total"))


@query
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.stats(documents(spark, sf_dir))


# --- predicates ----------------------------------------------------------------------------------


def _filter(name: str, q: SearchQuery) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return matched_ids(search(spark, sf_dir, q))

    run.__name__ = name
    query(run)


_filter("filter_range_int", parse_params("rangefilter=2:[2000,500]"))
_filter("filter_range_double_open", parse_params("rangefilter=4:[0.005,]"))
_filter("filter_in_list", SearchQuery(in_lists=(("n_chars", (250, 338, 380, 416)),)))
_filter("filter_bits_any", parse_params("bitfields=3[1,5]"))
_filter("filter_bits_none", parse_params("bitfields=3{0,4}"))
_filter("cat_any", parse_params("catfilter=2,5"))
_filter("cat_all", parse_params("catfilter=0,4&multicat=1"))
_filter("cat_block", parse_params("catblock=0"))
_filter("slevel_block", parse_params("slevel=1"))
_filter("section_prune", SearchQuery(sections=(1, 3)))
_filter("section_exclude", parse_params("nosecs=0,2&dbid=1"))
_filter("filter_range_long", parse_params("rangefilter=3:[17,2]"))
_filter("filter_in_long", parse_params("in=3:[1,17,20]"))
_filter("filter_in_double", parse_params("in=4:[0.5,0.25,0.0625]"))
_filter("filter_bits_int", parse_params("bitfields=2[3,5]2{0}"))


# --- facets, groups, totals ------------------------------------------------------------------------


@query
def facet_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facet_counts(documents(spark, sf_dir), 0b111111)


@query
def facet_before_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = search(spark, sf_dir, SearchQuery(terms=("thing",), category_any=1, category_facets=0b111111))
    return s.facets().crossJoin(F.broadcast(s.total()))


@query
def groupby_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_counts(table(spark, sf_dir, "lineitem"), "l_linenumber")


@query
def groupby_double_1024(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_counts(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@query
def groupby_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, sf_dir, parse_params("query=thing&groupby=3")).groups()


@query
def total_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, sf_dir, SearchQuery(terms=TERMS, top=5)).total()


# --- scores ----------------------------------------------------------------------------------------


def _score(name: str, q: SearchQuery, **more) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search(spark, sf_dir, q, **more).scored().select("id", "score")

    run.__name__ = name
    query(run)


_score("score_hits", SearchQuery(terms=TERMS, hit_scale=1, base_hits=10))
_score("score_field_hits", SearchQuery(terms=("thing", "src1"), hit_fields=3, base_field_hits=7))
_score("score_nterm", SearchQuery(terms=("thing", "éeau"), base_term=3), down=frozenset({"éeau"}))
_score("score_phrase_bigram", SearchQuery(terms=("was", "with"), phrase=True, base_phrase=5, hit_fields=1))
_score("score_catboost", SearchQuery(terms=("thing",), base_term=1, up=32, down=16, base_category_up=100, base_category_down=7))
_score("score_rank", SearchQuery(terms=("thing",), rank=True, base_rank=1000, down=32))
_score("score_weighted_terms", SearchQuery(terms=TERMS, weigh_terms=True, base_hits=10), down=frozenset({"erin"}))
_score("score_filter_only", SearchQuery(rank=True, base_rank=1000, up=1, base_category_up=50))
_score("score_ignored", SearchQuery(terms=("thing",), ignore_rank=True, base_term=9))


# --- order, pages ------------------------------------------------------------------------------------


@query
def orderby_long_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = SearchQuery(terms=TERMS, order_by="n_chars", base_term=1, count=30)
    return search(spark, sf_dir, q).hits()


@query
def orderby_int_then_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = SearchQuery(terms=TERMS, order_by="category", base_term=1, descending=False, count=30)
    return search(spark, sf_dir, q).hits()


@query
def page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, sf_dir, SearchQuery(terms=TERMS, base_term=1, top=100, offset=20, count=15)).hits()


@query
def query_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = parse_params("query=thing+erin&booland=1&bnterm=2&rank=1&brank=100&rangefilter=2:[500,]&catblock=5&order=-1&from=0&count=25&ntop=50")
    return search(spark, sf_dir, q).hits()


@query
def fetch_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = parse_params("op=2&key=3,5,8,999999999")
    return dumps.fetch(documents(spark, sf_dir), list(q.fetch), ["lang", "n_chars"])


# --- presentation --------------------------------------------------------------------------------------


@query
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select("id", F.md5(text.highlight(F.col("text"), ["thing", "erin"])).alias("marked"))


@query
def summary_best_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summary.passages(documents(spark, sf_dir), [("thing", 2.5), ("erin", 1.5)])
    return found.groupBy("id").agg(F.max_by(F.struct("line", "score"), F.struct("score", -F.col("at"))).alias("b")).select("id", F.md5("b.line").alias("line"), "b.score")


@query
def summary_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summary.passages(documents(spark, sf_dir), [("thing", 2.5), ("erin", 1.5)])
    return summary.best_passages(found).select("id", F.md5("summary").alias("summary"))


@query
def json_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = SearchQuery(terms=("thing",), base_term=1, count=10)
    page = search(spark, sf_dir, q).page(["source", "lang"])
    return summary.respond(page, [("source", False), ("lang", False)], list(q.terms))


@query
def display_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display columns and marks of a query string, answered through the result cache."""
    asked = "query=thing&bnterm=1&order=-1&display=1#,2&from=5&count=10"
    return ResultCache(stored_index(spark, sf_dir)).response(asked)


@query
def summary_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best lines of the hits by tf x idf of the index."""
    s = search(spark, sf_dir, SearchQuery(terms=("thing", "erin"), base_term=1, count=25))
    found = s.passages()
    return found.groupBy("id").agg(F.max_by(F.struct("line", "score"), F.struct("score", -F.col("at"))).alias("b")).select("id", F.md5("b.line").alias("line"), "b.score")


@query
def index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term statistics after a third of the documents lost their text and another third was taken over by their sources."""
    docs = documents(spark, sf_dir)
    changed = docs.filter("id % 3 <> 0").withColumn("status", F.when(F.col("id") % 3 == 1, -1).otherwise(0)).withColumn("text", F.col("source"))
    return index.updated_terms(stored_index(spark, sf_dir), changed)


# --- pages, URLs, links --------------------------------------------------------------------------------


@query
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.html_title(F.col("html")).alias("title"))


@query
def html_strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.html_strip(F.col("html"))).alias("text"))


@query
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.concat_ws(" ", text.html_links(F.col("html"))).alias("links"))


@query
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(text.url_host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query
def url_key_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.url_key(F.col("url")).alias("url_key"))


@query
def url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.first_by_url(table(spark, sf_dir, "pages"))


@query
def link_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.link_edges(table(spark, sf_dir, "pages"))


@query
def frontier_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.frontier(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id").select("page_id", "host", "turn")


@query
def template_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crawl.extract(table(spark, sf_dir, "pages"), crawl.Template(r'<li><a href="([^"]*)">([^<]*)</a>', ("href", "label"), all_rows=True))
    return found.select("page_id", "row", "href", "label")


@query
def new_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = crawl.page_links(pages).select(F.col("link").alias("url"))
    return crawl.new_urls(found, pages.select("url"))


def _url_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a tree of URL nodes: the parent of node n is n div 3; every fifth has a sibling record."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).distinct()
    k = F.col("id")
    return keys.select(
        "id",
        F.when(k > 2, F.floor(k / 3)).alias("parent"),
        F.when(k % 5 == 0, k).alias("brother"),
        (k % 7).cast("int").alias("nodeid"),
    )


@query
def parent_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.chain_ends(_url_nodes(spark, sf_dir))


@query
def parent_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("id")).agg(F.min("o_orderpriority").alias("p"))
    records = records.select("id", F.when(F.col("id") % 2 == 0, F.col("p")).otherwise("").alias("priority"))
    return crawl.inherit(_url_nodes(spark, sf_dir), records, ["priority"])


@query
def ancestor_for_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.ancestor_of_node(_url_nodes(spark, sf_dir), 3)


# --- records, upserts, dumps -------------------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("f1"), F.col("o_orderpriority").alias("f2")
    )
    old = orders.filter("id % 3 <> 0")
    new = orders.filter("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, "").otherwise("X").alias("f1"), F.concat("f2", F.lit("!")).alias("f2"))
    return old, new


@query
def record_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.merge_records(*_records(spark, sf_dir), "id", ["f1", "f2"])


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """events as changes of users: a first collection and later changes."""
    e = table(spark, sf_dir, "events")
    change = e.select(
        F.col("user_id").alias("id"),
        F.col("event_id").alias("version"),
        F.md5("event_type").alias("crc"),
        F.when(F.col("event_id") % 11 == 0, -1).otherwise(0).alias("status"),
        F.col("value").alias("rank"),
        F.col("event_type").alias("body"),
    )
    return ingest.latest(change.filter("version < 300"), "id", "version"), change.filter("version >= 300")


@query
def upsert_latest_by_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.upsert(*_versions(spark, sf_dir))


@query
def upsert_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.upsert_actions(*_versions(spark, sf_dir))


@query
def category_update_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 3 == 0, "unset").otherwise("set").alias("op"),
        F.expr("shiftleft(1L, cast(event_id % 20 as int))").alias("bits"),
    )
    return ingest.category_updates(documents(spark, sf_dir).select("id", "category"), updates)


@query
def numeric_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("value"), F.col("event_id").alias("version"))
    return ingest.field_updates(documents(spark, sf_dir).select("id", F.col("rank")), updates, "rank").select("id", F.round("rank", 9).alias("rank"))


@query
def csv_base64_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dumps.base64_columns(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


@query
def dump_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("title"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("size"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("time"),
        F.col("o_orderkey").alias("key"),
    )
    return dumps.dump_projection(source, ["title"], ["size"], ["time"], ["key"]).drop("crc")


@query
def record_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dumps.flatten_records(dumps.generate_records(spark, 1000)).select("title", "crc", "category", "int_0", "int_1", "long_2", "url").withColumn("title", F.trim("title"))


@query
def keyword_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    known = index.terms(index.postings(docs.select("id", "text", F.lit("").alias("source"))))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    scored = known.crossJoin(F.broadcast(n)).select("term", "total", F.ln((F.col("n") + 1) / F.col("df")).alias("idf"))
    kept = scored.filter((F.col("idf") >= 0.2) & ~F.col("term").isin(*segment.STOP_WORDS))
    return kept.select("term", F.col("total").alias("times"), F.round(F.col("idf") * F.col("total"), 4).alias("weight")).orderBy(F.desc("weight"), "term").limit(50)


@query
def segment_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = [("thing", 5.0, 2.0, "n"), ("erin", 3.0, 2.5, "n")]
    d = segment.Dictionary.load(spark.createDataFrame(words, "word string, tf double, idf double, attr string"))
    return segment.segmented(documents(spark, sf_dir), d).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("off").alias("first_off"))


@query
def html_block_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.blocks_of(F.col("html")).alias("blocks"))


@query
def url_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.page_links(table(spark, sf_dir, "pages")).select("page_id", F.col("link").alias("absolute"))


@query
def charset_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("data"))
    return data.select("page_id", markup.charset_of(F.col("data")).alias("charset"))


# --- streams ---------------------------------------------------------------------------------------------------


@query
def event_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.event_totals(table(spark, sf_dir, "events"))


@query
def work_queue_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("task"),
        F.col("event_id").alias("seq"),
        F.col("event_id").alias("at"),
        F.element_at(F.array(*(F.lit(x) for x in ("push", "pop", "ack", "requeue"))), (F.col("event_id") % 4 + 1).cast("int")).alias("op"),
        (F.col("user_id") % 10 == 0).alias("head"),
    )
    return flows.queue_state(log, timeout=2000)


@query
def stream_event_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file stream over events, folded batch by batch into the last event of each user."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    source = table(spark, sf_dir, "events")
    path, out, check = (shared_dir(spark, n) for n in ("stream-in", "stream-out", "stream-check"))
    source.repartitionByRange(3, "event_id").write.parquet(path)
    changes = flows.tail(spark, path, schema).select(
        F.col("user_id").alias("id"), F.col("event_id").alias("version"), F.md5("event_type").alias("crc"), F.lit(0).alias("status"), F.col("event_type").alias("body")
    )
    run = flows.start_upserts(changes, out, check)
    run.awaitTermination()
    last = run.lastProgress.batchId if run.lastProgress else 0
    return spark.read.parquet(f"{out}/v={last}").select("id", "version", "body")


@query
def queue_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.next_tasks(work_queue_state(spark, sf_dir), 20).select("task", "head", "first_seq")


@query
def term_state_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block-term maintenance: part names as terms, sizes as later states."""
    part = table(spark, sf_dir, "part")
    first = part.select(F.col("p_type").alias("term"), F.lit(0).alias("status"), F.lit(0).cast("long").alias("version")).distinct()
    later = part.select(F.col("p_type").alias("term"), (F.col("p_size") % 3).alias("status"), F.col("p_partkey").alias("version"))
    return ingest.term_states(first, later)


@query
def url_template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.url_template("http://<1>/list?id=<2>", text.url_host(F.col("url")), F.col("page_id").cast("string")).alias("filled"))


@query
def mime_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.concat(F.lit("/f."), F.element_at(F.array(*(F.lit(x) for x in ("html", "JPG", "bin", "css?v=1"))), (F.col("p_partkey") % 4 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", text.mime_type(names).alias("mime"))


@query
def http_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.http_time(text.http_date(stamp)).alias("epoch"))


@query
def summary_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", F.md5(summary.fallback(F.col("text"))).alias("head"))


@query
def over_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    item, link = crawl.Template(r"<title>([^<]*)</title>", ("title",)), crawl.Template(r'<a href="([^"]*)"', ("href",), all_rows=True)
    records, children = crawl.over_extract(pages, item, link, unique=F.col("page_id") % 7 == 0)
    return records.join(children.groupBy("page_id").agg(F.count(F.lit(1)).alias("children")), "page_id", "left")
