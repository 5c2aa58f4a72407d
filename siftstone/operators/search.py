"""SearchQuery -> hits, facets, groups and totals."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import term_size
from ..plans.query import SearchQuery
from ..schema import MAX_GROUPS, MAX_SYNONYMS, PHRASE_FIELD_PAIR, PHRASE_PAIR
from . import filters, score, summary
from .index import Index, StoredIndex


def expand_synonyms(terms: tuple[str, ...], synonyms: DataFrame, most: int = MAX_SYNONYMS) -> tuple[str, ...]:
    """Query terms and the other members of their sets (synid, term); only sets of a query term leave Spark.

    More than ``most`` members are an error, not cut off. Sets with a null id or term do not count.
    """
    if not terms:
        return ()
    own = synonyms.filter(F.col("term").isin(*terms)).select("synid").distinct()
    found = synonyms.join(own, "synid").filter("term is not null").select("term").distinct().orderBy("term").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"the terms have more than {most} synonyms")
    return tuple(dict.fromkeys([*terms, *(r["term"] for r in found)]))


def facet_counts(docs: DataFrame, mask: int, column: str = "category") -> DataFrame:
    """bit, n: documents with each bit of mask. One pass with partial sums, however many bits."""
    bits = [b for b in range(64) if mask >> b & 1]
    if not bits:
        return docs.sparkSession.createDataFrame([], "bit int, n long")
    sums = docs.agg(*(F.coalesce(F.sum(F.shiftright(F.col(column).cast("long"), b).bitwiseAND(F.lit(1))), F.lit(0)).alias(f"b{b}") for b in bits))
    pairs = F.array(*(F.struct(F.lit(b).alias("bit"), F.col(f"b{b}").alias("n")) for b in bits))
    return sums.select(F.inline(pairs)).filter("n > 0")


def group_counts(docs: DataFrame, column: str, limit: int = MAX_GROUPS) -> DataFrame:
    """key, n by ascending key; doubles are grouped by their value times 10**8, cut off."""
    key = F.col(column)
    if dict(docs.dtypes)[column] in ("double", "float"):
        key = F.round(key * 100_000_000, 2).cast("long")
    return docs.filter(F.col(column).isNotNull()).groupBy(key.cast("long").alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy("key").limit(limit)


@dataclass
class Search:
    """One search over an index. ``blocked`` and ``down`` are term states of the collection."""

    index: Index | StoredIndex
    query: SearchQuery
    blocked: frozenset[str] = frozenset()
    down: frozenset[str] = frozenset()

    @cached_property
    def term_frame(self) -> DataFrame:
        """Query terms with df, idf and length: at most a few dozen rows."""
        q = self.query
        spark = self.index.docs.sparkSession
        rows = [(t, i, t in self.down) for i, t in enumerate(q.terms)]
        own = F.broadcast(spark.createDataFrame(rows, "term string, ord int, down boolean"))
        return (
            self.index.terms.filter(F.col("term").isin(*q.terms))
            .join(own, "term")
            .crossJoin(F.broadcast(self.index.stats))
            .select("term", "ord", "down", "df", "n_docs", "n_terms", score.idf(F.col("n_docs"), F.col("df")).alias("idf"), term_size(F.col("term")).alias("size"))
        )

    @cached_property
    def matched(self) -> DataFrame:
        """Documents that pass all predicates but the category filter, with their hit figures."""
        q = self.query
        docs = self.index.docs.filter(filters.document_filter(q, bool(self.blocked.intersection(q.terms))))
        for t in q.not_terms and [self.index.postings.filter(F.col("term").isin(*q.not_terms)).select("id")]:
            docs = docs.join(t, "id", "left_anti")
        for number, wanted, barred in q.field_terms:
            bit = 1 << number
            own = self.index.postings.filter(F.col("field_bits").bitwiseAND(F.lit(bit)) != 0)
            if wanted:
                hit = own.filter(F.col("term").isin(*wanted)).groupBy("id").agg(F.countDistinct("term").alias("k"))
                docs = docs.join(hit.filter(F.col("k") == len(wanted)).select("id"), "id", "left_semi")
            if barred:
                docs = docs.join(own.filter(F.col("term").isin(*barred)).select("id"), "id", "left_anti")
        if not q.terms:
            return docs
        hits = self.index.postings.filter(F.col("term").isin(*q.terms)).join(F.broadcast(self.term_frame), "term")
        hit_field = F.col("field_bits").bitwiseAND(F.lit(q.hit_fields)) != 0 if q.hit_fields else F.lit(False)
        counted = ~F.col("down") if q.weigh_terms else F.lit(True)
        sums = {
            "n_hits": F.count(F.lit(1)),
            "n_weighted": F.sum(counted.cast("long")),
            "n_field_hits": F.sum(F.when(hit_field, F.bit_count(F.col("field_bits").bitwiseAND(F.lit(q.hit_fields)))).otherwise(0)),
            "hit_bits": F.bit_or("field_bits"),
            "term_score": F.sum(F.col("size") * F.when(F.col("down"), 1).otherwise(2)),
            "parts": F.collect_list(F.struct("ord", "term", "tf", "idf", "field_bits", "n_docs", "n_terms")),
        }
        agg = hits.groupBy("id").agg(*(c.alias(n) for n, c in sums.items()))
        keep = F.lit(True)
        if q.bool_and:
            keep = F.col("n_hits") == len(q.terms)
        elif q.hit_scale:
            keep = (F.floor(F.col("n_weighted") * 100 / len(q.terms)) >= q.hit_scale) & (F.col("n_weighted") > 0)
        if q.field_mask:
            keep = keep & (F.col("hit_bits").bitwiseAND(F.lit(q.field_mask)) != 0)
        return agg.filter(keep).join(docs, "id")

    @cached_property
    def filtered(self) -> DataFrame:
        return self.matched.filter(filters.category_filter(self.query))

    def total(self) -> DataFrame:
        return self.filtered.agg(F.count(F.lit(1)).alias("total"))

    def facets(self) -> DataFrame:
        return facet_counts(self.matched, self.query.category_facets)

    def groups(self) -> DataFrame:
        return group_counts(self.filtered, self.query.group_by)

    def _phrase(self, docs: DataFrame) -> tuple[DataFrame, Column]:
        """Adjacent query terms that are adjacent in the document: each pair counts from both its ends."""
        q = self.query
        pairs = list(zip(q.terms, q.terms[1:], strict=False))
        if not (q.phrase and q.base_phrase and pairs):
            return docs, F.lit(0)
        spark = docs.sparkSession
        own = F.broadcast(spark.createDataFrame(pairs, "left string, right string"))
        near = self.index.bigrams.filter(F.col("left").isin(*(a for a, _ in pairs))).join(own, ["left", "right"])
        in_fields = F.bit_or("field_bit").bitwiseAND(F.lit(q.hit_fields)) != 0
        each = near.groupBy("id", "left", "right").agg(F.when(in_fields, PHRASE_PAIR + PHRASE_FIELD_PAIR).otherwise(PHRASE_PAIR).alias("each"))
        hit = each.groupBy("id").agg(F.sum("each").alias("pairs"))
        return docs.join(hit, "id", "left"), F.coalesce("pairs", F.lit(0)) * (2 * q.base_phrase)

    def scored(self) -> DataFrame:
        """filtered with rel (sum of term parts) and score (fixed point)."""
        q = self.query
        docs, phrase = self._phrase(self.filtered)
        base, rel = F.lit(0.0), F.lit(0.0)
        if q.terms and not q.ignore_rank:
            if q.relevance != "none":
                part = lambda p: score.relevance(q.relevance, p["idf"], p["tf"], F.col("terms_total"), p["n_docs"], p["n_terms"])
                rel = F.aggregate(F.array_sort("parts"), F.lit(0.0), lambda acc, p: acc + part(p))
            hits = (F.col("n_hits") + F.col("n_weighted")) * q.base_hits if q.hit_scale or q.bool_and or q.weigh_terms else F.lit(0)
            base = hits + F.col("n_field_hits") * q.base_field_hits + phrase + F.col("term_score") * q.base_term
        boosted, demoted = score.category_boost(q, base + rel)
        if q.ignore_rank:
            boosted, demoted = F.lit(0.0), F.lit(True)
        return docs.withColumns({"rel": rel, "score": score.with_rank(q, score.fixed_point(boosted), demoted)})

    def hits(self) -> DataFrame:
        """id, score, sort_value: one page of the top documents; ties go to smaller ids.

        Only narrow columns are ordered; texts are joined to the page afterwards (``page``).
        """
        q = self.query
        value = F.col(q.order_by) if q.order_by else F.col("score")
        narrow = self.scored().select("id", "score", value.alias("sort_value"))
        way = (lambda c: c.desc()) if q.descending else (lambda c: c.asc())
        order = [way(F.col("sort_value")), way(F.col("score")), F.col("id").asc()]
        return narrow.orderBy(*order).limit(q.top).orderBy(*order).offset(q.offset).limit(q.count)

    def page(self, columns: list[str] | None = None) -> DataFrame:
        """The page with display columns (those of the query if none are given): the few ids go to the documents."""
        columns = [c for c, _ in self.query.display] if columns is None else columns
        return self.index.docs.select("id", *dict.fromkeys(columns)).join(F.broadcast(self.hits()), "id")

    def response(self) -> DataFrame:
        """id, json of the page: the query's display columns, marked ones highlighted."""
        return summary.respond(self.page(), list(dict(self.query.display).items()), list(self.query.terms))

    def term_weights(self) -> list[tuple[str, float]]:
        """Query terms with the idf of the index (0 where it is not positive), for passages; a few dozen rows."""
        idf = score.idf_of(F.col("n_docs"), F.col("df"))
        return [(r["term"], r["w"]) for r in self.term_frame.select("term", "ord", F.greatest(F.round(idf, 6), F.lit(0.0)).alias("w")).orderBy("ord").collect()]

    def passages(self, column: str = "text") -> DataFrame:
        """Scored lines of the documents on the page, by tf x idf of the index."""
        return summary.passages(self.page([column]), self.term_weights(), column)
