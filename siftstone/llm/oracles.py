"""DuckDB SQL for those queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLES: dict[str, str] = {
    "op4_decontamination": f"""WITH dw AS (SELECT doc_id, {WORDS} AS w FROM documents),
      iw AS (SELECT item_id, {WORDS} AS w FROM benchmark),
      win AS (SELECT item_id, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM iw WHERE len(w) > 0)),
      sizes AS (SELECT DISTINCT n FROM win),
      places AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS k
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)),
      hits AS (SELECT DISTINCT p.doc_id, p.n, p.s, x.item_id FROM places p JOIN win x ON x.n = p.n AND x.k = p.k),
      words AS (SELECT doc_id, count(DISTINCT at_word) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS at_word FROM hits) GROUP BY doc_id),
      items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS names FROM hits GROUP BY doc_id),
      cnt AS (SELECT term, count(*) AS c FROM (SELECT unnest(w) AS term FROM dw) GROUP BY term),
      dist AS (SELECT DISTINCT item_id, string_split(k, ' ') AS ws FROM win),
      lists AS (SELECT item_id, ws, unnest(ws) AS term FROM dist),
      rare AS (SELECT item_id, ws, min({{'c': c, 't': term}}).t AS best FROM lists JOIN cnt USING (term) GROUP BY item_id, ws HAVING count(*) = len(ws)),
      tok AS (SELECT doc_id, w, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM dw),
      nearby AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM tok JOIN rare ON best = term
        WHERE list_has_all(w[greatest(pos - 14, 1) : pos + 14], ws) GROUP BY doc_id)
      SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
      FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN nearby USING (doc_id)""",
    "op8_ngram_jaccard": f"""WITH RECURSIVE dw AS (SELECT doc_id, {WORDS} AS w FROM documents),
      sh AS (SELECT DISTINCT doc_id, array_to_string(w[s : s + 4], ' ') AS s5
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM dw WHERE len(w) > 0)),
      n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
      pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s5 = y.s5 AND x.doc_id <> y.doc_id GROUP BY 1, 2),
      links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE k >= 0.8 * (na.n + nb.n - k) - 1e-9),
      reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
      SELECT id AS doc_id, min(other) AS class_id, (SELECT count(*) FROM links WHERE a = id) AS n_links FROM reach GROUP BY id""",
}
