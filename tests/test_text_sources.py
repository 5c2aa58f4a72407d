import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftstone.functions import markup, text
from siftstone.operators import crawl, segment
from siftstone.sources import dumps
from siftstone.streaming import flows


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_scalar_functions(spark):
    assert one(spark, text.html_strip, "<p>a&amp;b<script>x</script><!-- c --> d</p>") == "a&b d"
    assert one(spark, text.url_host, "HTTP://A.Example.com:80/x") == "a.example.com"
    assert one(spark, text.mime_type, "/a/b.JPG?x=1") == "image/jpeg"
    assert one(spark, text.http_time, "Sun, 06 Nov 1994 08:49:37 GMT") == 784111777
    assert one(spark, text.http_date, 784111777, "long") == "Sun, 06 Nov 1994 08:49:37 GMT"
    assert one(spark, text.json_text, "a'\"\\\n\t") == "a&#39;&#34;\\\\"
    assert one(spark, lambda c: text.leading_number(c, "int"), " -12abc") == -12
    assert one(spark, lambda c: text.leading_number(c, "double"), "x") == 0.0
    assert one(spark, lambda c: text.highlight(c, ["cat"]), "Cat concat cat") == "<b>Cat</b> concat <b>cat</b>"
    assert one(spark, text.term_size, "aé") == 3
    assert one(spark, lambda c: text.url_template("http://h/<1>", c), "a b/é") == "http://h/a%20b/%C3%A9"
    assert one(spark, text.query_args, "a=1+2&b=%41") == {"a": "1 2", "b": "A"}


def test_charsets():
    assert markup.detect_charset("héllo".encode()) == "utf-8"
    assert markup.detect_charset(b"\xef\xbb\xbfx") == "utf-8"
    assert markup.detect_charset(b"plain") == "ascii"
    assert markup.detect_charset("<meta charset=gb2312>中文".encode("gbk")) == "gb18030"
    assert markup.to_utf8("中文字符内容说明".encode("gb18030")) == "中文字符内容说明"
    assert markup.detect_charset("café crème".encode("latin-1")) == "windows-1252"
    assert markup.to_utf8(None) is None


def test_blocks_and_sentences():
    html = "<p>" + "word " * 30 + "</p><p>short</p><div><a href=x>" + "link " * 30 + "</a></div>"
    assert markup.content_blocks(html) == [("word " * 30).strip()]
    assert markup.sentences("One. Two? Three") == ["One.", "Two?", "Three"]


def test_absolute_urls(spark):
    bases = ["http://h/a/b.html", "https://h.com", "http://h/a/b/?q=1#f", "http://h/a/b/c/d?x=/y/"]
    links = ["../c d?x=é", "x.html", "/x/y", "?n=2", "#top", "", "//o.com/p", "https://o.com/é", "mailto:a@b", "./x", "../../../x", "a/./b/../c", "x/..", "%41+%", " sp ", "a:b", "x?y=../z"]
    rows = [(b, x) for b in bases for x in links] + [(None, "x"), ("http://h/", None)]
    got = spark.createDataFrame(rows, "b string, x string").select("b", "x", text.absolute_url(F.col("b"), F.col("x")).alias("u")).collect()
    assert [(r["b"], r["x"], r["u"]) for r in got] == [(b, x, markup.join_url(b, x)) for b, x in rows]


def test_entities_and_marks(spark):
    assert one(spark, text.decode_entities, "&eacute;&#233;&#xE9;&amp;lt;&nbsp;&#x1F600;&#0;&#55296;&bogus; a&b & &#99999999;&lt") == "éééé"[:3] + "&lt; \U0001f600\ufffd\ufffd&bogus; a&b & &#99999999;&lt"
    assert one(spark, text.decode_entities, "plain") == "plain" and one(spark, text.decode_entities, None) is None
    assert one(spark, lambda c: text.highlight(c, ["c++", "a.b"]), "C++ cc axb a.b") == "<b>C++</b> cc axb <b>a.b</b>"
    assert one(spark, lambda c: text.highlight(c, ["x"], "<i $1>", "\\"), "x") == "<i $1>x\\"
    assert len(text.MIME) == 98


def test_sql_functions(spark):
    d = segment.Dictionary(WORDS)
    markup.register(spark, d)
    row = spark.sql("""SELECT html_text('<p>a&amp;b<style>x</style></p>') AS t, url_join('http://h/a/b', '../c') AS u, highlight('Cat c++', array('cat', 'c++')) AS m,
        segment('中国人民') AS s, charset_of(binary('abc')) AS c, text_sentences('A. B?') AS x, html_blocks('<p>short</p>') AS b""").first()
    assert (row["t"], row["u"], row["m"], row["c"], row["x"], row["b"]) == ("a&b", "http://h/c", "<b>Cat</b> <b>c++</b>", "ascii", ["A.", "B?"], [])
    assert [(w["word"], w["off"]) for w in row["s"]] == [("中国", 0), ("人民", 2)]


def test_parent_chain_and_inheritance(spark):
    nodes = spark.createDataFrame([(1, None, 11, 7), (2, 1, 12, 8), (3, 2, None, 9), (4, 99, None, 9)], "id long, parent long, brother long, nodeid int")
    records = spark.createDataFrame([(3, "", "own"), (11, "far", "far"), (12, "", "near")], "id long, f1 string, f2 string")
    got = {r["id"]: (r["f1"], r["f2"]) for r in crawl.inherit(nodes, records, ["f1", "f2"]).collect()}
    assert got[3] == ("far", "own")
    assert {r["id"]: r["parent"] for r in crawl.ancestor_of_node(nodes, 8).collect()} == {3: 1}


def test_parent_cycle_ends(spark):
    nodes = spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long")
    assert crawl.parent_chains(nodes, 5).agg(F.max("depth")).first()[0] == 5


def test_long_chains_and_cycles(spark):
    n = 200
    nodes = spark.createDataFrame([(i, i - 1 if i else None, 1000 + i if i % 150 == 0 else None, i) for i in range(n)], "id long, parent long, brother long, nodeid int")
    pairs = crawl.parent_chains(nodes)
    assert pairs.count() == n * (n - 1) // 2 and pairs.filter("id - ancestor <> depth").count() == 0
    assert {r["id"]: (r["depth"], r["top"]) for r in crawl.chain_ends(nodes).collect()} == {i: (i, 0) for i in range(1, n)}
    records = spark.createDataFrame([(i, "" if i < 1000 else f"b{i}") for i in [*range(n), 1000, 1150]], "id long, f string")
    got = {r["id"]: r["f"] for r in crawl.inherit(nodes, records, ["f"]).collect()}
    assert got[0] is None and got[1] == got[150] == "b1000" and got[151] == got[199] == "b1150"
    assert {r["id"]: r["parent"] for r in crawl.ancestor_of_node(nodes, 5).collect()} == {i: 4 for i in range(6, n)}
    ring = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "id long, parent long")
    for run in (crawl.parent_chains, crawl.chain_ends):
        with pytest.raises(ValueError, match="cycle"):
            run(ring)
    assert crawl.nearest_above(ring, spark.createDataFrame([(9, "x")], "id long, v string")).filter("v is not null").count() == 0
    none = nodes.limit(0)
    assert crawl.parent_chains(none).count() == crawl.chain_ends(none).count() == crawl.ancestor_of_node(none, 1).count() == 0


def test_frontier_numbers_a_hot_host(spark):
    rows = [(i, f"http://{'hot' if i % 3 else 'h' + str(i % 5)}.com/{i}") for i in range(300)] + [(None, None), (7, "http://hot.com/7")]
    urls = spark.createDataFrame(rows, "k long, url string")
    full = {}
    for r in crawl.frontier(urls, "k").collect():
        full.setdefault(r["host"], []).append((r["turn"], r["k"], r["url"]))
    for host, own in full.items():
        assert sorted(t for t, *_ in own) == list(range(1, len(own) + 1)), host
        assert [k for _, k, _ in sorted(own)] == sorted((k for _, k, _ in own), key=lambda k: (k is not None, k))
    assert sorted((r["host"] or "", r["turn"]) for r in crawl.frontier(urls, "k", 3).collect()) == sorted((h or "", t) for h, own in full.items() for t, *_ in own if t <= 3)


def test_templates(spark):
    pages = spark.createDataFrame([(1, "<b>x=1</b><b>x=2</b><i>x=3</i>"), (2, None)], "page_id long, html string")
    t = crawl.Template(r"x=(\d)", ("v",), all_rows=True)
    assert [(r["row"], r["v"]) for r in crawl.extract(pages, t).orderBy("row").collect()] == [(0, "1"), (1, "2"), (2, "3")]
    scoped = crawl.Template(r"x=(\d)", ("v",), scope="<i>(.*?)</i>")
    assert [r["v"] for r in crawl.extract(pages, scoped).collect()] == ["3"]


WORDS = {"中国": (10.0, 3.0, "ns"), "中": (5.0, 1.0, "n"), "国人": (2.0, 2.0, "n"), "人": (5.0, 1.0, "n"), "中国人": (4.0, 4.0, "n"), "民": (3.0, 1.0, "n"), "人民": (9.0, 2.5, "n")}


def test_segmentation():
    d = segment.Dictionary(WORDS)
    assert segment.forward_longest("中国人民", d) == ["中国人", "民"]
    assert segment.reverse_longest("中国人民", d) == ["中国", "人民"]
    assert segment.best_path("中国人民", d) == ["中国", "人民"]
    got = segment.segment("Hi 中国人民 3.14 S.H.E", d)
    assert [(w["word"], w["off"]) for w in got] == [("hi", 0), ("中国", 3), ("人民", 5), ("3.14", 8), ("s.h.e", 13)]
    assert segment.segment(None, d) == []


def test_segment_goes_on_after_the_longest_unit():
    got = segment.segment("x" * 70 + "-End " + "7" * 34, segment.Dictionary(WORDS))
    assert [(w["word"], w["off"]) for w in got] == [("x" * 33, 0), ("x" * 33, 33), ("xxxx-end", 66), ("7" * 33, 75), ("7", 108)]


def test_name_rules():
    after = segment.Rule(frozenset("王"), "after", "nr", most=2, exclude=frozenset("的"))
    before = segment.Rule(frozenset("镇"), "before", "ns", least=1, most=2)
    d = segment.Dictionary({**WORDS, "王": (1.0, 1.0, "n"), "镇": (1.0, 1.0, "n")}, rules=[after, before])
    assert [(w["word"], w["attr"]) for w in segment.segment("王小明的人民", d)] == [("王小明", "nr"), ("的", "un"), ("人民", "n")]
    assert [w["word"] for w in segment.segment("人民乌鱼镇", d)] == ["人民", "乌鱼镇"]


def test_inflate():
    import gzip
    import zlib

    raw = zlib.compressobj(wbits=-15)
    for data in (gzip.compress(b"text"), zlib.compress(b"text"), raw.compress(b"text") + raw.flush(), b"text"):
        assert markup.inflate(data) == b"text"
    assert markup.inflate(None) is None


def test_keywords(spark):
    rows = [("x", 1.0, "n"), ("x", 1.0, "n"), ("y", 1.5, "v"), ("the", 9.0, "n"), ("z", 0.1, "n")]
    words = spark.createDataFrame(rows, "word string, idf double, attr string")
    assert [tuple(r) for r in segment.keywords(words).collect()] == [("x", 2, 2.0), ("y", 1, 1.5)]
    assert [r["word"] for r in segment.keywords(words, attrs=("~n",)).collect()] == ["y"]


def test_binary_dump_round_trip(spark, tmp_path):
    data = b"".join(dumps.encode_binary(i, 1, 1.0, 0, 0, [(8, f"título {i}"), (1, "7")]) for i in range(5))
    (tmp_path / "a.doc").write_bytes(data + b"\x10\x00")
    rows = dumps.read_binary(spark, f"file://{tmp_path}/a.doc").orderBy("globalid").collect()
    assert [r["globalid"] for r in rows] == [0, 1, 2, 3, 4] and rows[3]["values"] == ["título 3", "7"]


def test_sinks_and_generators(spark, tmp_path):
    docs = dumps.generate(spark, 10)
    dumps.write_dumps(docs, f"file://{tmp_path}/d", rows_per_file=4)
    assert dumps.read_dumps(spark, f"file://{tmp_path}/d").count() == 10
    dumps.write_csv(docs.select("title"), f"file://{tmp_path}/c")
    back = spark.read.option("header", True).csv(f"file://{tmp_path}/c").select(F.unbase64("title").cast("string").alias("t"))
    assert {r["t"] for r in back.collect()} == {f"title:{i}" for i in range(10)}
    assert [r["id"] for r in dumps.fetch(docs.withColumnRenamed("globalid", "id"), [100_000_003, 5], ["title"]).collect()] == [100_000_003]


def test_stream_equals_batch(spark, sf, tmp_path):
    schema = "id long, version long, crc string, status int, body string"
    rows = [(i % 7, i, str(i % 3), -1 if i % 5 == 0 else 0, f"b{i}") for i in range(60)]
    spark.createDataFrame(rows, schema).repartitionByRange(4, "version").write.parquet(f"file://{tmp_path}/in")
    changes = flows.tail(spark, f"file://{tmp_path}/in", schema)
    q = flows.start_upserts(changes, f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    q.awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out/v={q.lastProgress.batchId}")
    assert {r["id"]: r["version"] for r in got.collect()} == {i: max(v for k, v, *_ in rows if k == i) for i in range(7)}


def test_queue(spark):
    log = [(1, 1, 1, "push", False), (2, 2, 2, "push", True), (3, 3, 3, "push", False), (1, 4, 4, "pop", None), (3, 5, 95, "pop", None), (3, 6, 99, "ack", None), (4, 7, 99, "push", False)]
    state = flows.queue_state(spark.createDataFrame(log, "task long, seq long, at long, op string, head boolean"), timeout=50)
    assert {r["task"]: r["state"] for r in state.collect()} == {1: "waiting", 2: "waiting", 3: "done", 4: "waiting"}
    assert [r["task"] for r in flows.next_tasks(state, 2).collect()] == [2, 1]


def test_words_come_in_bounded_batches(spark):
    d = segment.Dictionary(WORDS)
    texts = ["中国人民 a.b " * 30_000, None, "", "x y"]
    batch = pa.record_batch({"id": pa.array([1, 2, 3, 4]), "text": pa.array(texts)})
    found = list(segment.word_batches([batch, batch.slice(3)], d))
    assert max(b.num_rows for b in found) <= segment.MOST_WORDS < sum(b.num_rows for b in found)
    rows = [tuple(r.values()) for b in found for r in b.to_pylist()]
    assert rows == [(k, *u.values()) for k, t in [*zip((1, 2, 3, 4), texts), (4, "x y")] for u in segment.segment(t, d)]
    assert segment.segmented(spark.createDataFrame([(7, "x y"), (8, None)], "id long, text string"), d).count() == 2


def test_chain_joins_hold_bounded_parts(spark, monkeypatch):
    made, table = [], crawl.Workspace.table
    monkeypatch.setattr(crawl.Workspace, "table", lambda ws, df, name: made.append(df._jdf.queryExecution().executedPlan().toString()) or table(ws, df, name))
    monkeypatch.setattr(crawl, "CHAIN_ROWS", 100)
    nodes = spark.createDataFrame([(i, i // 3 if i > 2 else None) for i in range(1, 1001)] + [(5000 + i, 1) for i in range(500)], "id long, parent long")
    got = {r["id"]: (r["depth"], r["top"]) for r in crawl.chain_ends(nodes).collect()}
    want = {}
    for i in [*range(3, 1001), *range(5000, 5500)]:
        up, n = i // 3 if i <= 1000 else 1, 1
        while up > 2:
            up, n = up // 3, n + 1
        want[i] = (n, up)
    joins = [p for p in made if "Join" in p]
    assert got == want and len(joins) == 4 and all("ShuffledHashJoin" in p and "15)" in p and "Broadcast" not in p for p in joins)
