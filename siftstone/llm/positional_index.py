"""Benchmark decontamination over a positional inverted index, with DataFrame functions only.

1. The terms of all benchmark (test) windows form the vocabulary; its postings in the (training) documents are
   counted exactly. A window with a term that no document has can't occur and is left out.
2. The index is stored: one row for each term, document and position, sorted by term and place. Its heads are the postings, in all documents, of
   each window's rarest and second rarest terms.
3. Each window's lists are intersected from the rarest term on. A position of the rarest term is an alignment; it
   stays if the next rarest term's list of the same document has the position that its offset asks for. For the few
   documents in which alignments are left, the postings of all terms are stored as well (no other document's lists
   can be reached any more), and an alignment is a match if these lists have their positions too.
4. Exact matches ask for one position of each list; proximity matches for any within ``window - 1 + slop`` words of
   the rarest term. Exact matches of a document are merged into covered word ranges and distinct items.

Item sides are broadcast only when their rows and bytes were counted to be small (``small_rows``); beyond
that the same joins shuffle, and the postings of the most frequent terms still meet their terms by broadcast, so that no
term's postings gather in one task.

Edge cases: null and empty texts (documents or items) have no words; items without words match
nothing; an item shorter than the window is one window; repeated item ids keep all their texts and
count once; documents are reported row by row, repeated doc_ids included; empty tables give no
matches; other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialise

# Runs of digits, a-z and non-ASCII characters of the lower-cased text.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SMALL_BYTES = 64 << 20


def pieces(text: Column) -> Column:
    """Words of a text in order, with an empty one in front (behind) if it begins (ends) with a separator. Only A-Z are lower-cased."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)  # all ASCII: lower() does the same and faster
    return F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), SEPARATORS)


def words(text: Column) -> Column:
    """Words of a text in order; an empty array for null."""
    return F.array_remove(pieces(text), "")


def n_words(text: Column) -> Column:
    """Size of words(), without making that array."""
    p = pieces(text)
    return F.aggregate(F.array(p), F.lit(0).cast("long"), lambda acc, w: acc + F.size(w) - (F.get(w, 0) == "").cast("int") - ((F.size(w) > 1) & (F.element_at(w, -1) == "")).cast("int"))


def small(df: DataFrame, rows: int, text: str | None = None) -> DataFrame:
    """df (a stored table) with a broadcast hint if it is counted to have few rows and, in its text column, few bytes."""
    size = F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) if text else F.lit(0)
    counted = df.agg(F.count(F.lit(1)).alias("n"), size.alias("bytes")).first()
    return F.broadcast(df) if counted["n"] <= rows and counted["bytes"] <= SMALL_BYTES else df


def is_small(df: DataFrame, rows: int, text: str) -> bool:
    return small(df, rows, text) is not df


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h (the text's hash, which tells rows with equal ids apart), at, term: every word of every document."""
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h")
    base = docs.select(F.col(id_col).alias("doc_id"), h, pieces(F.col(text_col)).alias("w"))
    led = base.select("doc_id", "h", (F.get("w", 0) == "").cast("int").alias("led"), F.posexplode("w").alias("at", "term"))
    return led.filter("term <> ''").select("doc_id", "h", (F.col("at") - F.col("led")).alias("at"), "term")


def same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["h"] == b["h"])


def at_terms(all_tokens: DataFrame, terms: DataFrame, small_rows: int) -> DataFrame:
    """The tokens that are one of the terms (term, count), with no term's tokens in one task."""
    own = terms.select("term", "count")
    if is_small(own, small_rows, "term"):
        return all_tokens.join(F.broadcast(own), "term")
    return hot_join(all_tokens, own, "term", "count")


@dataclass
class Windows:
    """Distinct windows by the hash of their words.

    lists: wid, place, term, count, off: the terms of each window that can occur, rarest first. items: wid, item.
    """

    lists: DataFrame
    items: DataFrame
    terms: DataFrame
    small_rows: int

    @staticmethod
    def of(docs: DataFrame, items: DataFrame, window: int, small_rows: int, id_col: str, item_col: str, text_col: str) -> Windows:
        item_words = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("iw")).filter(F.size("iw") > 0)
        starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("iw") - window, F.lit(0))))
        cut = item_words.select("item", "iw", starts.alias("start")).select("item", F.slice("iw", F.col("start") + 1, window).alias("w"))
        named = materialise(cut.select(F.sha2(F.concat_ws(" ", "w"), 256).alias("wid"), "item", "w").distinct(), "windows")
        distinct = named.select("wid", "w").dropDuplicates(["wid"])
        vocabulary = materialise(distinct.select(F.explode("w").alias("term")).distinct(), "vocabulary")
        found = tokens(docs, id_col, text_col).select("term")
        if is_small(vocabulary, small_rows, "term"):
            counted = found.join(F.broadcast(vocabulary), "term").groupBy("term").count()
        else:  # summed by term before terms move
            counted = found.groupBy("term").count().join(vocabulary, "term")
        counts = materialise(counted, "posting-counts")
        places = distinct.select("wid", F.size("w").alias("n"), F.posexplode("w").alias("off", "term")).join(small(counts, small_rows, "term"), "term")
        known = places.groupBy("wid", "n").agg(F.array_sort(F.collect_list(F.struct("count", "term", "off"))).alias("lists")).filter(F.size("lists") == F.col("n"))
        lists = materialise(known.select("wid", F.posexplode("lists").alias("place", "x")).select("wid", "place", "x.term", "x.count", "x.off"), "lists")
        return Windows(lists, named.select("wid", "item").join(lists.select("wid").distinct(), "wid", "left_semi"), counts, small_rows)


def postings(docs: DataFrame, terms: DataFrame, small_rows: int, id_col: str, text_col: str) -> DataFrame:
    """A stored part of the index: term, doc_id, h, at of the terms (term, count); the words move nowhere."""
    found = at_terms(tokens(docs, id_col, text_col), terms, small_rows).select("term", "doc_id", "h", "at")
    return materialise(found.sortWithinPartitions("term", "doc_id", "at"), "index")


@dataclass
class Search:
    """What a kind of match asks of the lists of each window.

    wanted: wid, place (from 1, rarest first), term, low, high: the list of the term has to hold a position from s + low
    to s + high, where s is a position of the rarest term less its offset (if shifted) in the window.
    """

    wanted: DataFrame
    shifted: bool

    @staticmethod
    def exact(windows: Windows) -> Search:
        lists = windows.lists.filter("place > 0").select("wid", "place", "term", F.col("off").alias("low"), F.col("off").alias("high"))
        return Search(materialise(lists, "exact-lists"), True)

    @staticmethod
    def near(windows: Windows, reach: int) -> Search:
        """Each term once, within reach on either side of the rarest."""
        terms = windows.lists.groupBy("wid", "term").agg(F.min("place").alias("p")).filter("p > 0")
        ranked = terms.groupBy("wid").agg(F.array_sort(F.collect_list(F.struct("p", "term"))).alias("x")).select("wid", F.posexplode("x").alias("place", "y"))
        lists = ranked.select("wid", (F.col("place") + 1).alias("place"), "y.term", F.lit(-reach).alias("low"), F.lit(reach).alias("high"))
        return Search(materialise(lists, "near-lists"), False)


KEY = ["doc_id", "h", "wid", "s"]


def meets(found: DataFrame, index: DataFrame, wanted: DataFrame, small_rows: int) -> DataFrame:
    """The alignments of found with each wanted list of their window that agrees to them."""
    asked = found.join(small(materialise(wanted, "wanted"), small_rows, "term"), "wid")
    held = index.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("term").alias("t"), "at")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")) & (F.col("term") == F.col("t"))
    return asked.join(held, same & F.col("at").between(F.col("s") + F.col("low"), F.col("s") + F.col("high"))).select(*KEY, "place").distinct()


def search(docs: DataFrame, windows: Windows, kinds: list[Search], id_col: str, text_col: str) -> list[DataFrame]:
    """For each kind the alignments (doc_id, h, wid, s) to which all lists of the window agree."""
    rows = windows.small_rows
    first = materialise(windows.lists.filter("place = 0").select("wid", "term", "off", "count"), "first")
    heads = first.select("term", "count")
    for kind in kinds:
        heads = heads.unionByName(kind.wanted.filter("place = 1").select("term").join(windows.terms, "term"))
    head_index = postings(docs, materialise(heads.distinct(), "heads"), rows, id_col, text_col)
    at_first = head_index.join(small(first.drop("count"), rows, "term"), "term").select("doc_id", "h", "wid", "at", "off")
    seconds, alone, sizes, reached = [], [], [], None
    for kind in kinds:
        found = at_first.select("doc_id", "h", "wid", (F.col("at") - F.col("off") if kind.shifted else F.col("at")).alias("s"))
        found = found.filter("s >= 0")
        lists = materialise(kind.wanted.groupBy("wid").agg(F.count(F.lit(1)).alias("lists")), "sizes")
        second = materialise(meets(found, head_index, kind.wanted.filter("place = 1"), rows).select(*KEY), "second")
        more = second.join(small(lists.filter("lists > 1"), rows), "wid", "left_semi").select("doc_id", "h")
        reached = more if reached is None else reached.unionByName(more)
        seconds.append(second)
        alone.append(found.join(small(lists, rows), "wid", "left_anti").select(*KEY))
        sizes.append(lists)
    some = small(materialise(reached.distinct(), "reached"), 10 * rows)
    rows_of = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    chosen = rows_of.join(some, same_document(rows_of, some), "left_semi")
    all_index = postings(chosen, windows.terms, rows, "doc_id", "text")
    out = []
    for kind, second, single, lists in zip(kinds, seconds, alone, sizes, strict=True):
        met = meets(second, all_index, kind.wanted.filter("place > 1"), rows).groupBy(*KEY).agg(F.count(F.lit(1)).alias("met"))
        rest = met.join(small(lists, rows), "wid").filter("met = lists - 1").select(*KEY)
        two = second.join(small(lists.filter("lists = 1"), rows), "wid", "left_semi").select(*KEY)
        out.append(materialise(single.unionByName(two).unionByName(rest), "matches"))
    return out


def places_of(matches: DataFrame, windows: Windows) -> DataFrame:
    """doc_id, h, first, end, wid of exact alignments."""
    sizes = materialise(windows.lists.groupBy("wid").agg(F.count(F.lit(1)).cast("int").alias("n")), "window-sizes")
    return matches.join(small(sizes, windows.small_rows), "wid").select("doc_id", "h", F.col("s").alias("first"), (F.col("s") + F.col("n")).alias("end"), "wid")


def named(matches: DataFrame, windows: Windows) -> DataFrame:
    """matches with the item of each of their windows."""
    return matches.join(small(materialise(windows.items, "window-items"), windows.small_rows, "item"), "wid")


def phrase_matches(
    docs: DataFrame, items: DataFrame, window: int = 10, small_rows: int = 20_000, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """Exact matches (doc_id, h, first, end, item): windows of items in documents, by word places."""
    windows = Windows.of(docs, items, window, small_rows, id_col, item_col, text_col)
    (found,) = search(docs, windows, [Search.exact(windows)], id_col, text_col)
    return named(places_of(found, windows), windows).drop("wid").distinct()


def near_matches(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    slop: int = 5,
    small_rows: int = 20_000,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """Proximity matches (doc_id, h, item, at): all words of a window, in any order, within window - 1 + slop
    words of a place of its rarest term."""
    windows = Windows.of(docs, items, window, small_rows, id_col, item_col, text_col)
    (found,) = search(docs, windows, [Search.near(windows, window - 1 + slop)], id_col, text_col)
    return named(found, windows).select("doc_id", "h", "item", F.col("s").alias("at")).distinct()


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    small_rows: int = 20_000,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
    slop: int | None = None,
) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items (sorted), items_sha256, contaminated; h is the text's hash.

    With slop also n_near, the number of items with a proximity match.
    """
    windows = Windows.of(docs, items, window, small_rows, id_col, item_col, text_col)
    kinds = [Search.exact(windows)] + ([Search.near(windows, window - 1 + slop)] if slop is not None else [])
    found = search(docs, windows, kinds, id_col, text_col)
    places = places_of(found[0], windows)
    ranges = places.groupBy("doc_id", "h").agg(F.collect_set(F.struct("first", "end")).alias("ranges"))
    items_of = named(places.select("doc_id", "h", "wid").distinct(), windows).groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item")).alias("found"))
    parts = [
        ranges.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), covered(F.col("ranges")).alias("hit")),
        items_of.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "found"),
    ]
    if slop is not None:
        close = named(found[1].select("doc_id", "h", "wid").distinct(), windows)
        parts.append(close.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.count_distinct("item").alias("n_near")))
    out = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), n_words(F.col(text_col)).alias("n_words"))
    # One row for each document with any match, so that one join brings all columns.
    kept = ["hit", "found", "n_near"][: len(parts)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = materialise(rows.groupBy("d", "g").agg(*(F.first(c, ignorenulls=True).alias(c) for c in kept)), "hits")
    out = out.join(rows, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    item_list = F.coalesce("found", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "h",
        "n_words",
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(item_list).cast("long").alias("n_items"),
        item_list.alias("items"),
        F.sha2(F.concat_ws(",", item_list), 256).alias("items_sha256"),
        (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"),
        *([F.coalesce("n_near", F.lit(0)).alias("n_near")] if slop is not None else []),
    )


def covered(ranges: Column) -> Column:
    """Number of positions in a union of [first, end) ranges."""
    start = F.struct(F.lit(0).cast("int").alias("total"), F.lit(0).cast("int").alias("end"))

    def step(acc: Column, r: Column) -> Column:
        return F.struct(
            (acc["total"] + F.greatest(r["end"] - F.greatest(r["first"], acc["end"]), F.lit(0))).alias("total"),
            F.greatest(acc["end"], r["end"]).alias("end"),
        )

    return F.aggregate(F.array_sort(ranges), start, step, lambda acc: acc["total"])
