"""Crawl tables: URL de-duplication, frontier, parent chains, template extraction."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import absolute_url, html_links, url_host, url_key
from ..storage import Workspace, materialise


def first_by_url(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The first page of each URL key."""
    firsts = pages.groupBy(url_key(F.col(url_col)).alias("url_key")).agg(F.min(F.struct(id_col, url_col)).alias("p"))
    return firsts.select("url_key", f"p.{id_col}", f"p.{url_col}")


def link_edges(pages: DataFrame) -> DataFrame:
    """from_host, link, n: links of pages by host."""
    links = pages.select(url_host(F.col("url")).alias("from_host"), F.explode(html_links(F.col("html"))).alias("link"))
    return links.groupBy("from_host", "link").agg(F.count(F.lit(1)).alias("n"))


def new_urls(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Distinct found URLs whose key is not among the seen ones."""
    keyed = found.select(url_key(F.col("url")).alias("url_key"), "url").groupBy("url_key").agg(F.min("url").alias("url"))
    return keyed.join(seen.select(url_key(F.col("url")).alias("url_key")), "url_key", "left_anti")


def frontier(urls: DataFrame, order: str, turns: int | None = None) -> DataFrame:
    """Round robin over hosts: turn is a URL's place within its host; with turns, only the first ones.

    A host may hold most URLs, so no host is one task: the first turns of a host are taken within salted parts
    first; without a limit the rows are ranged by (host, order, url) and each range is numbered on from the
    sizes of those before it. Null order values come first, a null url has a null host; equal rows get turns of
    their own in no fixed order.
    """
    hosted = urls.withColumn("host", url_host(F.col("url")))
    if turns:
        salted = hosted.withColumn("__salt", F.pmod(F.xxhash64("url", order), F.lit(64)))
        first = F.row_number().over(Window.partitionBy("host", "__salt").orderBy(order, "url"))
        few = salted.withColumn("__first", first).filter(F.col("__first") <= turns).drop("__salt", "__first")
        return few.withColumn("turn", F.row_number().over(Window.partitionBy("host").orderBy(order, "url"))).filter(F.col("turn") <= turns)
    ranged = materialise(hosted.repartitionByRange("host", order, "url").withColumn("__range", F.spark_partition_id()), "frontier")
    sizes = ranged.groupBy("host", "__range").agg(F.count(F.lit(1)).alias("__n"))  # hosts and ranges, not URLs
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("host").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("host").alias("__host"), F.col("__range").alias("__at"), before.alias("__before"))
    own = F.row_number().over(Window.partitionBy("host", "__range").orderBy(order, "url"))
    placed = ranged.withColumn("__own", own).join(starts, F.col("host").eqNullSafe(F.col("__host")) & (F.col("__range") == F.col("__at")))
    return placed.select(*hosted.columns, (F.col("__own") + F.col("__before")).cast("int").alias("turn"))


# --- parent chains: pointers that double their reach every round ------------------------------------


def parent_chains(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """id, ancestor, depth for every node and each of its ancestors (depth 1: the parent).

    Ancestors up to depth 2k follow from joining those at depth k with what is known so far, so rounds grow
    with the logarithm of the depth. Null parents end a chain, unknown parents are its last ancestor,
    repeated rows of a node repeat its pairs. A cycle needs a max_depth; without one it is an error.
    """
    ws = Workspace(nodes.sparkSession, "chains")
    parts = [ws.table(nodes.filter("parent is not null").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")), "pairs")]
    reach, most = 1, parts[0].count()
    while (max_depth is None or reach < max_depth) and (far := parts[-1].filter(F.col("depth") == reach)).limit(1).count():
        if max_depth is None and reach > most:
            raise ValueError("parents form a cycle; give a max_depth")
        known = reduce(DataFrame.unionByName, parts)
        above = known.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next"), F.col("depth").alias("more"))
        pairs = far.join(above, "ancestor").select("id", F.col("next").alias("ancestor"), (F.col("more") + reach).alias("depth"))
        reach *= 2
        parts.append(ws.table(pairs if max_depth is None else pairs.filter(F.col("depth") <= max_depth), "pairs"))
    return reduce(DataFrame.unionByName, parts)


# Rows of a table that one task of a chain join holds in memory.
CHAIN_ROWS = 250_000


def chain_ends(nodes: DataFrame) -> DataFrame:
    """id, depth (number of ancestors), top (the last one) of every node that has a parent; one row a node and round.

    Ids are taken to be distinct, null parents end chains, unknown parents are tops; a cycle is an error. A row is open
    while its pointer has a parent: rows that have reached their top, which may be one for all, are not joined again.
    Only the side with one row an id is held in memory, in as many parts as its rows ask for.
    """
    ws = Workspace(nodes.sparkSession, "ends")
    first = ws.table(nodes.filter("parent is not null").select("id", F.col("parent").alias("top"), F.lit(1).alias("depth")), "ends")
    most, reach = first.count(), 1
    parts = most // CHAIN_ROWS + 1

    def beside(rows: DataFrame, above: DataFrame) -> DataFrame:
        return rows.repartition(parts, "top").join(above.repartition(parts, "top").hint("shuffle_hash"), "top", "left")

    has = first.select(F.col("id").alias("top"), F.lit(True).alias("has"))
    state = ws.table(beside(first, has).select("id", "top", "depth", F.col("has").isNotNull().alias("open")), "ends")
    ws.drop(first)
    while state.filter("open").limit(1).count():
        if reach > 2 * most:
            raise ValueError("parents form a cycle")
        above = state.select(F.col("id").alias("top"), F.col("top").alias("further"), F.col("depth").alias("more"), F.col("open").alias("on"))
        moved = beside(state.filter("open"), above).select("id", F.col("further").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), F.col("on").alias("open"))
        last, state = state, ws.table(moved.unionByName(state.filter("not open")), "ends")
        ws.drop(last)
        reach *= 2
    return state.select("id", "depth", "top")


def nearest_above(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """id and, for each column of values (id, ...), its value at the nearest ancestor where it is not null.

    A row holds what is known of its ancestors up to a pointer; joining the pointer's row doubles the reach. Rows
    whose columns are all filled, or whose chain has ended, wait. Ids are taken to be distinct; cycles end,
    as a pointer need not reach further than there are nodes.
    """
    fields = [c for c in values.columns if c != "id"]
    ws = Workspace(nodes.sparkSession, "above")
    at_parent = values.select(F.col("id").alias("up"), *fields)
    state = ws.table(nodes.filter("parent is not null").select("id", F.col("parent").alias("up")).join(at_parent, "up", "left").select("id", "up", *fields), "state")
    most, reach = state.count(), 1
    wanting = F.col("up").isNotNull() & reduce(Column.__or__, (F.col(f).isNull() for f in fields))
    while reach <= most and state.filter(wanting).limit(1).count():
        beyond = state.select(F.col("id").alias("up"), F.col("up").alias("__up"), *(F.col(f).alias(f"__{f}") for f in fields))
        moved = state.filter(wanting).join(beyond, "up", "left").select("id", F.col("__up").alias("up"), *(F.coalesce(f, f"__{f}").alias(f) for f in fields))
        last, state = state, ws.table(moved.unionByName(state.filter(~wanting)), "state")
        ws.drop(last)
        reach *= 2
    return state.select("id", *fields)


def inherit(nodes: DataFrame, records: DataFrame, fields: list[str]) -> DataFrame:
    """Records of nodes whose empty fields come from the nearest ancestor's sibling record (``brother``).

    Null and "" are empty; a record without a node stays as it is; a field empty all the way up is null.
    """
    filled = [F.nullif(F.col(f), F.lit("")).alias(f) for f in fields]
    brothers = nodes.filter("brother is not null").select("id", F.col("brother").alias("rid"))
    values = brothers.join(records.select(F.col("id").alias("rid"), *filled), "rid").select("id", *fields)
    above = nearest_above(nodes, values).select("id", *(F.col(f).alias(f"__{f}") for f in fields))
    return records.join(above, "id", "left").select("id", *(F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"__{f}")).alias(f) for f in fields))


def ancestor_of_node(nodes: DataFrame, node_id: int) -> DataFrame:
    """For each URL the parent of its nearest ancestor with that template node (and a parent)."""
    values = nodes.filter((F.col("nodeid") == node_id) & F.col("parent").isNotNull()).select("id", F.col("parent").alias("found"))
    return nearest_above(nodes, values).filter("found is not null").select("id", F.col("found").alias("parent"))


@dataclass(frozen=True)
class Template:
    """Extraction pattern: group i fills fields[i - 1]. scope narrows the page first; all_rows takes every match."""

    pattern: str
    fields: tuple[str, ...]
    scope: str | None = None
    all_rows: bool = False
    ignore_case: bool = False


def extract(pages: DataFrame, template: Template, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, row, fields: matches of a template in each page, in Arrow batches."""
    flags = re.S | re.M | (re.I if template.ignore_case else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, scope = re.compile(template.pattern, flags), re.compile(template.scope, flags) if template.scope else None
        names = [id_col, "row", *template.fields]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for key, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = html or ""
                if scope:
                    m = scope.search(text)
                    text = m.group(m.re.groups and 1) if m else ""
                for n, m in enumerate(pattern.finditer(text)):
                    values = [m.group(i + 1) if i < pattern.groups else None for i in range(len(template.fields))]
                    for o, v in zip(out, [key, n, *values], strict=True):
                        o.append(v)
                    if not template.all_rows:
                        break
            kinds = [batch.column(0).type, pa.int32(), *[pa.string()] * len(template.fields)]
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names)

    kind = dict(pages.dtypes)[id_col]
    fields = "".join(f", `{f}` string" for f in template.fields)
    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, row int{fields}")


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, link: absolute links of the pages."""
    links = pages.select("page_id", "url", F.explode(html_links(F.col("html"))).alias("link"))
    return links.select("page_id", absolute_url(F.col("url"), F.col("link")).alias("link"))


def over_extract(pages: DataFrame, item: Template, link: Template, unique: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Records and child URLs of list pages.

    A page for which ``unique`` holds (a page of one item; null is no) gives its record only. Any other page gives its
    record and the absolute URLs of its links, one row a child, as nodes whose parent is the page.
    Pages without a match have no record, links that repeat on a page give one child.
    """
    lists = pages if unique is None else pages.filter(~F.coalesce(unique, F.lit(False)))
    found = extract(lists, link).join(lists.select("page_id", "url"), "page_id")
    children = found.select("page_id", absolute_url(F.col("url"), F.col(link.fields[0])).alias("child")).filter("child is not null")
    return extract(pages, item), children.dropDuplicates(["page_id", "child"])


def child_records(records: DataFrame, children: DataFrame, nodes: DataFrame, fields: list[str]) -> DataFrame:
    """Records of pages with empty fields filled from the pages that led to them.

    records have a page's id and fields, children its (page_id, child) links, nodes the (id, url) of the pages;
    the parent of a page is the least page that links to it, and inheritance runs along these parents (those
    with larger ids link back and are left out, so there is no cycle).
    """
    linked = children.join(nodes.select(F.col("id").alias("__id"), F.col("url").alias("child")), "child").filter("page_id < __id")
    parents = linked.groupBy(F.col("__id").alias("id")).agg(F.min("page_id").alias("parent"))
    tree = nodes.select("id", F.col("id").alias("brother")).join(parents, "id", "left")
    return inherit(tree, records, fields)
