"""DuckDB SQL of the registered queries."""

from __future__ import annotations

W = r"[^\p{L}\p{N}]+"
DOCS = """docs AS (
  SELECT d.doc_id AS id, d.text, d.source, d.lang, d.n_chars,
    ((CASE d.lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 4 WHEN 'es' THEN 8 ELSE 0 END)
     + (CASE WHEN l.quality = 1 THEN 16 ELSE 0 END) + (CASE WHEN l.toxic = 1 THEN 32 ELSE 0 END))::BIGINT AS category,
    coalesce(l.toxic, 0) AS slevel, 1.0::DOUBLE / (d.doc_id + 1) AS rank,
    CASE WHEN d.doc_id % 17 = 0 THEN -1 WHEN d.doc_id % 5 = 0 THEN 1 ELSE 0 END AS status, d.doc_id % 4 AS secid, d.doc_id % 3 AS dbid
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id))"""
TOKENS = rf"""tok AS (
  SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '{W}'), lambda x: x <> '')) AS term, 1 AS bit FROM docs
  UNION ALL
  SELECT id, unnest(list_filter(regexp_split_to_array(lower(source), '{W}'), lambda x: x <> '')) AS term, 2 AS bit FROM docs)"""
POST = "post AS (SELECT id, term, count(*) AS tf, bit_or(bit) AS field_bits FROM tok GROUP BY id, term)"
LENGTH = "len AS (SELECT id, count(*) AS terms_total FROM tok GROUP BY id)"
STATS = "st AS (SELECT (SELECT count(*) FROM docs) AS n_docs, (SELECT count(*) FROM tok) AS n_terms)"
LIVE = "live AS (SELECT * FROM docs WHERE status >= 0)"
BASE = f"WITH {DOCS}, {TOKENS}, {POST}, {LENGTH}, {STATS}, {LIVE}"
ONLY = f"WITH {DOCS}, {LIVE}"
TERMS = "('thing', 'erin', 'thnt')"


def terms(values: str) -> str:
    """Hit figures of documents for some terms."""
    return f"""q AS (
      SELECT term, count(*) AS df FROM post WHERE term IN {values} GROUP BY term),
    w AS (SELECT term, df, CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) < 0 THEN 1.0 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END AS idf,
      length(term) + length(regexp_replace(term, '[\\x00-\\x7F]', '', 'g')) AS size FROM q, st),
    h AS (SELECT id, count(*) AS n_hits, bit_or(field_bits) AS hit_bits, sum(size * 2) AS term_score FROM post JOIN w USING (term) GROUP BY id)"""


def rel(kind: str) -> str:
    if kind == "reference":
        f, norm = "(tf::DOUBLE / terms_total)", "terms_total / (n_docs::DOUBLE / n_terms)"
    else:
        f, norm = "tf::DOUBLE", "terms_total * (n_docs::DOUBLE / n_terms)"
    return f"""r AS (SELECT id, sum(idf * {f} * 3.0 / ({f} + 0.5 + 1.5 * ({norm}))) AS rel
      FROM post JOIN w USING (term) JOIN len USING (id), st GROUP BY id)"""


def where(condition: str) -> str:
    return f"{ONLY} SELECT id FROM live WHERE {condition}"


NODES = """nodes AS (SELECT DISTINCT o_orderkey AS id, CASE WHEN o_orderkey > 2 THEN o_orderkey // 3 END AS parent,
    CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey END AS brother, o_orderkey % 7 AS nodeid FROM orders)"""
CHAIN = f"""WITH RECURSIVE {NODES}, chain(id, ancestor, depth) AS (
    SELECT id, parent, 1 FROM nodes WHERE parent IS NOT NULL
    UNION ALL SELECT c.id, n.parent, c.depth + 1 FROM chain c JOIN nodes n ON n.id = c.ancestor WHERE n.parent IS NOT NULL AND c.depth < 64)"""
CHANGES = """ch AS (SELECT user_id AS id, event_id AS version, md5(event_type) AS crc, CASE WHEN event_id % 11 = 0 THEN -1 ELSE 0 END AS status,
    value AS rank, event_type AS body FROM events),
  old AS (SELECT * FROM ch WHERE version < 300 QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1),
  new AS (SELECT * FROM ch WHERE version >= 300 QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1)"""
LINKS = """lk AS (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1) AS l FROM pages)"""
LOWER = "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
HOST = f"regexp_extract({LOWER}, '^[a-z]+://([^/?#:]+)', 1)"


def decoded(x: str) -> str:
    """The references that the tables hold; the ampersand last, so that each is decoded once."""
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def absolute(base: str, link: str) -> str:
    """A link against its page, for the kinds of links that the tables hold: with a scheme, from the root, or beside the page."""
    return f"""CASE WHEN {link} = '' THEN {base} WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {link}
      WHEN {link}[1:2] = '//' THEN regexp_extract({base}, '^[a-z]+:') || {link}
      WHEN {link}[1] = '/' THEN regexp_extract({base}, '^[a-z]+://[^/?#]*') || {link}
      WHEN {link}[1] = '#' THEN regexp_extract({base}, '^[^#]*') || {link}
      WHEN {link}[1] = '?' THEN regexp_extract({base}, '^[^?#]*') || {link}
      ELSE regexp_extract({base}, '^([a-z]+://[^?#]*/)[^/?#]*', 1) || {link} END"""


def encoded(x: str) -> str:
    x = f"url_encode({x})"
    for c in "/:?#[]@!$&()*+,;=~%":
        x = f"replace({x}, '%{ord(c):02X}', '{c}')"
    return f"replace({x}, '%27', chr(39))"


STRIP = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'),
  '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g')"""
LINES = f"""ln AS (SELECT id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT id, string_split(text, chr(10)) AS l FROM docs)),
  lw AS (SELECT id, pos, line, list_filter(regexp_split_to_array(lower(line), '{W}'), lambda x: x <> '') AS w FROM ln),
  lo AS (SELECT *, list_filter(w, lambda x: x IN ('thing', 'erin')) AS own FROM lw),
  ps AS (SELECT id, pos, line,
    trunc(round((len(list_filter(own, lambda x: x = 'thing')) * 2.5 + len(list_filter(own, lambda x: x = 'erin')) * 1.5) * 1000000, 2))::BIGINT
    + (10 * len(list_filter(range(1, len(w)), lambda i: w[i] IN ('thing', 'erin') AND w[i + 1] IN ('thing', 'erin'))) + len(list_distinct(own))) * 1000000 AS score
    FROM lo WHERE len(own) > 0)"""
PAGE_ORDER = "ORDER BY sort_value DESC, score DESC, id"

ORACLES: dict[str, str] = {
    "term_search_topk": f"{BASE}, {terms(TERMS)}, {rel('reference')} SELECT id, round(rel * 1e8, 2) AS rel, category FROM r JOIN live USING (id) ORDER BY 2 DESC, 1 LIMIT 20",
    "bm25_textbook": f"{BASE}, {terms(TERMS)}, {rel('bm25')} SELECT id, round(rel, 6) AS rel FROM r JOIN live USING (id)",
    "bool_or": f"{BASE}, {terms(TERMS)} SELECT id, n_hits FROM h JOIN live USING (id)",
    "bool_and": f"{BASE}, {terms(TERMS)} SELECT id FROM h JOIN live USING (id) WHERE n_hits = 3",
    "bool_not": f"{BASE} SELECT id FROM live WHERE id IN (SELECT id FROM post WHERE term = 'thing') AND id NOT IN (SELECT id FROM post WHERE term IN ('erin', 'thnt'))",
    "min_should_match": f"{BASE}, {terms(TERMS)} SELECT id, n_hits FROM h JOIN live USING (id) WHERE n_hits * 100 // 3 >= 60",
    "field_filter": f"{BASE}, {terms("('thing', 'src1')")} SELECT id, hit_bits FROM h JOIN live USING (id) WHERE hit_bits & 2 <> 0",
    "keys_per_field": f"""{BASE} SELECT id FROM live WHERE id IN (SELECT id FROM post WHERE term = 'thing' AND field_bits & 1 <> 0)
        AND id NOT IN (SELECT id FROM post WHERE term = 'erin' AND field_bits & 1 <> 0) AND id IN (SELECT id FROM post WHERE term = 'src0' AND field_bits & 2 <> 0)""",
    "synonym_expand": f"{BASE}, {terms("('thing', 'erin', 'thnt', 'eron')")} SELECT id, n_hits FROM h JOIN live USING (id)",
    "block_term_forbidden": f"{BASE}, {terms("('thing', 'erin')")} SELECT id FROM h JOIN live USING (id) WHERE status >= 1",
    "ignore_status": f"{BASE}, {terms("('thing')")} SELECT id FROM h JOIN docs USING (id)",
    "postings": f"{BASE} SELECT id, term, tf, field_bits FROM post",
    "term_stats": f"{BASE} SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM post GROUP BY term",
    "term_positions": rf"""WITH {DOCS}, x AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '{W}'), lambda x: x <> '') AS w FROM docs),
        p AS (SELECT id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM x)
        SELECT id, term, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM p GROUP BY id, term""",
    "term_bigrams": rf"""WITH {DOCS}, x AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '{W}'), lambda x: x <> '') AS w FROM docs),
        p AS (SELECT id, unnest(w[:-2]) AS "left", unnest(w[2:]) AS "right" FROM x WHERE len(w) > 1) SELECT DISTINCT id, "left", "right" FROM p""",
    "doc_length": f"{BASE} SELECT docs.id, coalesce(terms_total, 0)::BIGINT AS terms_total FROM docs LEFT JOIN len USING (id)",
    "collection_stats": f"{BASE} SELECT n_docs, n_terms FROM st",
    "filter_range_int": where("n_chars BETWEEN 500 AND 2000"),
    "filter_range_double_open": where("rank >= 0.005"),
    "filter_in_list": where("n_chars IN (250, 338, 380, 416)"),
    "filter_bits_any": where("category & 34 <> 0"),
    "filter_bits_none": where("category & 17 = 0"),
    "cat_any": where("category & 36 <> 0"),
    "cat_all": where("category & 17 = 17"),
    "cat_block": where("category & 1 = 0"),
    "slevel_block": where("slevel <> 1"),
    "section_prune": where("secid IN (1, 3)"),
    "section_exclude": where("secid NOT IN (0, 2) AND dbid = 1"),
    "filter_range_long": where("category BETWEEN 2 AND 17"),
    "filter_in_long": where("category IN (1, 17, 20)"),
    "filter_in_double": where("rank IN (0.5, 0.25, 0.0625)"),
    "filter_bits_int": where("n_chars & 40 <> 0 AND n_chars & 1 = 0"),
    "facet_category": f"WITH {DOCS} SELECT bit::INTEGER AS bit, count(*) AS n FROM docs, range(6) t(bit) WHERE (category >> bit) & 1 = 1 GROUP BY 1",
    "facet_before_filter": f"""{BASE}, {terms("('thing')")}, m AS (SELECT id, category FROM h JOIN live USING (id))
        SELECT bit::INTEGER AS bit, count(*) AS n, (SELECT count(*) FROM m WHERE category & 1 <> 0) AS total FROM m, range(6) t(bit) WHERE (category >> bit) & 1 = 1 GROUP BY 1""",
    "groupby_int": "SELECT l_linenumber::BIGINT AS key, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 1024",
    "groupby_double_1024": "SELECT trunc(round(l_extendedprice * 100000000, 2))::BIGINT AS key, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 1024",
    "groupby_hits": f"{BASE}, {terms("('thing')")} SELECT category AS key, count(*) AS n FROM h JOIN live USING (id) GROUP BY 1",
    "total_hits": f"{BASE}, {terms(TERMS)} SELECT count(*) AS total FROM h JOIN live USING (id)",
    "score_hits": f"{BASE}, {terms(TERMS)} SELECT id, (2 * n_hits * 10 * 100000000)::BIGINT AS score FROM h JOIN live USING (id)",
    "score_field_hits": f"{BASE}, {terms("('thing', 'src1')")}, f AS (SELECT id, sum(bit_count(field_bits & 3)) AS k FROM post WHERE term IN ('thing', 'src1') GROUP BY id) SELECT id, (k * 7 * 100000000)::BIGINT AS score FROM f JOIN live USING (id)",
    "score_nterm": f"{BASE}, {terms("('thing', 'éeau')")}, f AS (SELECT id, sum(CASE WHEN term = 'éeau' THEN size ELSE 2 * size END) AS k FROM post JOIN w USING (term) GROUP BY id) SELECT id, (k * 3 * 100000000)::BIGINT AS score FROM f JOIN live USING (id)",
    "score_phrase_bigram": rf"""{BASE}, {terms("('was', 'with')")},
        x AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '{W}'), lambda x: x <> '') AS w FROM docs),
        p AS (SELECT id, unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM x WHERE len(w) > 1), b AS (SELECT DISTINCT id FROM p WHERE a = 'was' AND b = 'with')
        SELECT id, CASE WHEN b.id IS NULL THEN 0 ELSE 60 END::BIGINT * 100000000 AS score FROM h JOIN live USING (id) LEFT JOIN b USING (id)""",
    "score_catboost": f"""{BASE}, {terms("('thing')")} SELECT id, ((CASE WHEN category & 32 <> 0 THEN term_score + 100 WHEN category & 16 <> 0 THEN greatest(term_score - 7, 0)
        ELSE term_score END) * 100000000)::BIGINT AS score FROM h JOIN live USING (id)""",
    "score_rank": f"{BASE}, {terms("('thing')")} SELECT id, CASE WHEN category & 32 <> 0 THEN 0 ELSE trunc(rank * 1000) END::BIGINT AS score FROM h JOIN live USING (id)",
    "score_weighted_terms": f"{BASE}, {terms(TERMS)}, f AS (SELECT id, count(*) + count(*) FILTER (term <> 'erin') AS k FROM post WHERE term IN {TERMS} GROUP BY id) SELECT id, (k * 10 * 100000000)::BIGINT AS score FROM f JOIN live USING (id)",
    "score_filter_only": f"{ONLY} SELECT id, (CASE WHEN category & 1 <> 0 THEN 50 ELSE 0 END::BIGINT * 100000000 + trunc(rank * 1000)::BIGINT) AS score FROM live",
    "score_ignored": f"{BASE}, {terms("('thing')")} SELECT id, 0::BIGINT AS score FROM h JOIN live USING (id)",
    "orderby_long_desc": f"{BASE}, {terms(TERMS)} SELECT id, (term_score * 100000000)::BIGINT AS score, n_chars AS sort_value FROM h JOIN live USING (id) {PAGE_ORDER} LIMIT 30",
    "orderby_int_then_score": f"{BASE}, {terms(TERMS)} SELECT id, (term_score * 100000000)::BIGINT AS score, category AS sort_value FROM h JOIN live USING (id) ORDER BY sort_value, score, id LIMIT 30",
    "page_slice": f"{BASE}, {terms(TERMS)} SELECT id, (term_score * 100000000)::BIGINT AS score, (term_score * 100000000)::BIGINT AS sort_value FROM h JOIN live USING (id) {PAGE_ORDER} LIMIT 15 OFFSET 20",
    "query_string": f"""{BASE}, {terms("('thing', 'erin')")}, s AS (SELECT id, (term_score * 2 * 100000000 + trunc(rank * 100))::BIGINT AS score FROM h JOIN live USING (id)
        WHERE n_hits = 2 AND n_chars >= 500 AND category & 32 = 0) SELECT id, score, score AS sort_value FROM s {PAGE_ORDER} LIMIT 25""",
    "fetch_by_ids": """SELECT doc_id AS id, '{"lang":"' || lang || '","n_chars":"' || n_chars || '"}' AS json FROM documents WHERE doc_id IN (3, 5, 8, 999999999)""",
    "highlight": r"SELECT doc_id AS id, md5(regexp_replace(text, '(?i)\b(thing|erin)\b', '<b>\1</b>', 'g')) AS marked FROM documents",
    "summary_best_line": f"WITH {DOCS}, {LINES} SELECT id, md5(line) AS line, score FROM ps QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) = 1",
    "summary_budget": f"""WITH {DOCS}, {LINES}, o AS (SELECT *, row_number() OVER o AS n,
        coalesce(sum(length(line)) OVER (PARTITION BY id ORDER BY score DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ps WINDOW o AS (PARTITION BY id ORDER BY score DESC, pos))
        SELECT id, md5(string_agg(line, ' ... ' ORDER BY n)) AS summary FROM o WHERE before < 128 GROUP BY id""",
    "json_response": f"""{BASE}, {terms("('thing')")}, s AS (SELECT id, source, lang FROM h JOIN live USING (id) ORDER BY term_score DESC, id LIMIT 10)
        SELECT id, '{{"id":"' || id || '","source":"' || source || '","lang":"' || lang || '"}}' AS json FROM s""",
    "display_response": f"""{BASE}, {terms("('thing')")}, s AS (SELECT id, source, n_chars FROM h JOIN live USING (id) ORDER BY term_score DESC, id LIMIT 10 OFFSET 5)
        SELECT id, '{{"id":"' || id || '","source":"' || source || '","n_chars":"' || n_chars || '"}}' AS json FROM s""",
    "summary_weighted": f"""{BASE}, {terms("('thing', 'erin')")}, {LINES}, g AS (SELECT term, greatest(round(ln((n_docs - df + 0.5) / (df + 0.5)), 6), 0) AS g FROM w, st),
        pg AS (SELECT id FROM h JOIN live USING (id) ORDER BY term_score DESC, id LIMIT 25),
        pw AS (SELECT id, pos, line, trunc(round((len(list_filter(own, lambda x: x = 'thing')) * (SELECT g FROM g WHERE term = 'thing')
            + len(list_filter(own, lambda x: x = 'erin')) * coalesce((SELECT g FROM g WHERE term = 'erin'), 0)) * 1000000, 2))::BIGINT
          + (10 * len(list_filter(range(1, len(w)), lambda i: w[i] IN ('thing', 'erin') AND w[i + 1] IN ('thing', 'erin'))) + len(list_distinct(own))) * 1000000 AS score
          FROM lo JOIN pg USING (id) WHERE len(own) > 0)
        SELECT id, md5(line) AS line, score FROM pw QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) = 1""",
    "index_update": rf"""WITH {DOCS}, nt AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(CASE WHEN id % 3 = 0 THEN text ELSE source END), '{W}'), lambda x: x <> '')) AS term FROM docs WHERE id % 3 <> 1
          UNION ALL SELECT id, unnest(list_filter(regexp_split_to_array(lower(source), '{W}'), lambda x: x <> '')) FROM docs WHERE id % 3 <> 1)
        SELECT term, count(DISTINCT id) AS df, count(*) AS total FROM nt GROUP BY term""",
    "html_title": f"SELECT page_id, {decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title FROM pages",
    "html_strip_text": f"SELECT page_id, md5({decoded(STRIP)}) AS text FROM pages",
    "html_links": f"WITH {LINKS} SELECT page_id, array_to_string(l, ' ') AS links FROM lk",
    "url_host": f"SELECT {HOST} AS host, count(*) AS n FROM pages GROUP BY 1",
    "url_key_md5": f"SELECT page_id, md5({LOWER})[1:16] AS url_key FROM pages",
    "url_dedup": f"SELECT md5({LOWER})[1:16] AS url_key, page_id, url FROM pages QUALIFY row_number() OVER (PARTITION BY md5({LOWER}) ORDER BY page_id, url) = 1",
    "link_graph_edges": f"WITH {LINKS}, e AS (SELECT {HOST} AS from_host, unnest(l) AS link FROM lk) SELECT from_host, link, count(*) AS n FROM e GROUP BY 1, 2",
    "frontier_turns": f"SELECT page_id, {HOST} AS host, row_number() OVER (PARTITION BY {HOST} ORDER BY page_id, url)::INTEGER AS turn FROM pages",
    "template_extract": r"""WITH m AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1) AS a, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 2) AS b FROM pages)
        SELECT page_id, (generate_subscripts(a, 1) - 1)::INTEGER AS "row", unnest(a) AS href, unnest(b) AS label FROM m""",
    "new_links": f"""WITH {LINKS}, r AS (SELECT url AS base, unnest(l) AS h FROM lk), f AS (SELECT {encoded(absolute('base', 'h'))} AS url FROM r), k AS (SELECT md5({LOWER})[1:16] AS url_key, url FROM f)
        SELECT url_key, min(url) AS url FROM k WHERE url_key NOT IN (SELECT md5({LOWER})[1:16] FROM pages) GROUP BY url_key""",
    "url_join": f"""WITH {LINKS}, r AS (SELECT page_id, url AS base, unnest(l) AS h FROM lk) SELECT page_id, {encoded(absolute('base', 'h'))} AS absolute FROM r""",
    "over_extract": rf"""WITH {LINKS}, r AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages WHERE page_id % 7 <> 0),
        c AS (SELECT page_id, count(DISTINCT {encoded(absolute('base', 'h'))}) AS children FROM r GROUP BY 1)
        SELECT page_id, 0::INTEGER AS "row", regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, children FROM pages LEFT JOIN c USING (page_id) WHERE regexp_matches(html, '<title>[^<]*</title>')""",
    "parent_chain": f"{CHAIN} SELECT id, max(depth)::INTEGER AS depth, min(ancestor) AS top FROM chain GROUP BY id",
    "parent_inherit": f"""{CHAIN}, rec AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN min(o_orderpriority) ELSE '' END AS p FROM orders GROUP BY 1),
        near AS (SELECT c.id, arg_min(r.p, c.depth) AS p FROM chain c JOIN nodes n ON n.id = c.ancestor JOIN rec r ON r.id = n.brother WHERE r.p <> '' GROUP BY 1)
        SELECT rec.id, coalesce(nullif(rec.p, ''), near.p) AS priority FROM rec LEFT JOIN near USING (id)""",
    "ancestor_for_node": f"{CHAIN} SELECT c.id, arg_min(n.parent, c.depth) AS parent FROM chain c JOIN nodes n ON n.id = c.ancestor WHERE n.nodeid = 3 AND n.parent IS NOT NULL GROUP BY 1",
    "record_merge": """WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS f1, o_orderpriority AS f2 FROM orders WHERE o_orderkey % 3 <> 0),
        n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'X' END AS f1, o_orderpriority || '!' AS f2 FROM orders WHERE o_orderkey % 2 = 0)
        SELECT coalesce(o.id, n.id) AS id, coalesce(nullif(n.f1, ''), o.f1) AS f1, coalesce(nullif(n.f2, ''), o.f2) AS f2 FROM o FULL JOIN n ON o.id = n.id""",
    "upsert_latest_by_crc": f"""WITH {CHANGES} SELECT coalesce(n.id, o.id) AS id,
        CASE WHEN n.id IS NULL THEN o.version ELSE n.version END AS version,
        CASE WHEN n.id IS NULL OR (o.id IS NOT NULL AND n.status < 0) THEN o.crc ELSE n.crc END AS crc,
        CASE WHEN n.id IS NULL THEN o.status ELSE n.status END AS status,
        CASE WHEN n.id IS NULL OR (o.id IS NOT NULL AND n.status < 0) THEN o.rank ELSE n.rank END AS rank,
        CASE WHEN n.id IS NULL OR (o.id IS NOT NULL AND (n.status < 0 OR o.crc = n.crc)) THEN o.body ELSE n.body END AS body
        FROM old o FULL JOIN new n ON o.id = n.id""",
    "upsert_action": f"""WITH {CHANGES} SELECT n.id, CASE WHEN n.status < 0 THEN 'disable' WHEN o.id IS NULL THEN 'insert' WHEN o.crc = n.crc THEN 'update' ELSE 'reindex' END AS action
        FROM new n LEFT JOIN old o ON o.id = n.id""",
    # The last change of each bit decides about it.
    "category_update_fold": f"""WITH {DOCS}, b AS (SELECT user_id AS id, event_id % 20 AS bit, arg_max(event_id % 3 <> 0, event_id) AS on_ FROM events GROUP BY 1, 2),
        m AS (SELECT id, coalesce(sum(CASE WHEN on_ THEN 1::BIGINT << bit ELSE 0 END), 0)::BIGINT AS s, sum(1::BIGINT << bit)::BIGINT AS k FROM b GROUP BY id)
        SELECT docs.id, CASE WHEN m.id IS NULL THEN category ELSE (category & ~k) | s END AS category FROM docs LEFT JOIN m USING (id)""",
    "numeric_update": f"""WITH {DOCS}, u AS (SELECT user_id AS id, arg_max(value, event_id) AS v FROM events GROUP BY 1)
        SELECT docs.id, round(coalesce(v, rank), 9) AS rank FROM docs LEFT JOIN u USING (id)""",
    "csv_base64_dump": "SELECT to_base64(encode(n_nationkey::VARCHAR)) AS n_nationkey, to_base64(encode(n_name)) AS n_name FROM nation",
    "dump_rows": """SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority ELSE ' ' END AS title, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey ELSE 0 END AS size,
        epoch(date_trunc('second', o_orderdate))::BIGINT AS "time", o_orderkey AS "key" FROM orders""",
    "record_flatten": """SELECT 'title ' || i AS title, (i + 1)::INTEGER AS crc, 1::BIGINT << (i % 62) AS category, (i // 3)::INTEGER AS int_0, (i // 9)::INTEGER AS int_1,
        i // 21 AS long_2, 'http://demo.com/' || i AS url FROM range(1000) t(i)""",
    "keyword_tops": rf"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '{W}'), lambda x: x <> '')) AS term FROM documents),
        s AS (SELECT term, count(*) AS times, ln((SELECT count(*) + 1 FROM documents)::DOUBLE / count(DISTINCT doc_id)) AS idf FROM t GROUP BY term)
        SELECT term, times, round(idf * times, 4) AS weight FROM s WHERE idf >= 0.2 AND term NOT IN ('about', 'all', 'and', 'are', 'for', 'from', 'of', 'on', 'the', 'this', 'to', 'us', 'was', 'with')
        ORDER BY weight DESC, term LIMIT 50""",
    "event_totals": "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, max(ts) AS last_ts FROM events GROUP BY 1",
    "work_queue_state": """WITH l AS (SELECT user_id AS task, event_id AS seq, (['push', 'pop', 'ack', 'requeue'])[event_id % 4 + 1] AS op, user_id % 10 = 0 AS head FROM events),
        g AS (SELECT task, arg_max(op, seq) AS op, max(seq) AS last_at, bool_or(head) AS head, min(seq) AS first_seq, sum((op = 'pop')::INTEGER)::BIGINT AS tries FROM l GROUP BY task)
        SELECT task, CASE WHEN op = 'ack' THEN 'done' WHEN op = 'pop' AND (SELECT max(seq) FROM l) - last_at <= 2000 THEN 'working' ELSE 'waiting' END AS state, head, tries, first_seq FROM g""",
    "stream_event_upsert": "SELECT user_id AS id, event_id AS version, event_type AS body FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "queue_next": """WITH st AS (WITH l AS (SELECT user_id AS task, event_id AS seq, (['push', 'pop', 'ack', 'requeue'])[event_id % 4 + 1] AS op, user_id % 10 = 0 AS head FROM events),
        g AS (SELECT task, arg_max(op, seq) AS op, max(seq) AS last_at, bool_or(head) AS head, min(seq) AS first_seq, sum((op = 'pop')::INTEGER)::BIGINT AS tries FROM l GROUP BY task)
        SELECT task, CASE WHEN op = 'ack' THEN 'done' WHEN op = 'pop' AND (SELECT max(seq) FROM l) - last_at <= 2000 THEN 'working' ELSE 'waiting' END AS state, head, tries, first_seq FROM g) SELECT task, head, first_seq FROM st WHERE state = 'waiting' ORDER BY head DESC, first_seq, task LIMIT 20""",
    "term_state_table": """WITH c AS (SELECT p_type AS term, 0 AS status, 0::BIGINT AS version FROM part UNION ALL SELECT p_type, p_size % 3, p_partkey FROM part)
        SELECT term, status::INTEGER AS status, version FROM c QUALIFY row_number() OVER (PARTITION BY term ORDER BY version DESC, status DESC) = 1""",
    "url_template_fill": f"SELECT page_id, 'http://' || {HOST} || '/list?id=' || page_id AS filled FROM pages",
    "mime_types": "SELECT p_partkey, (['text/html', 'image/jpeg', 'application/octet-stream', 'text/css'])[p_partkey % 4 + 1] AS mime FROM part",
    "http_times": "SELECT o_orderkey, epoch(date_trunc('second', o_orderdate))::BIGINT AS epoch FROM orders",
    "summary_fallback": "SELECT doc_id AS id, md5(text[1:128] || string_split(text[129:], chr(10))[1]) AS head FROM documents",
}
