"""Document predicates of a query as one Column, so that they reach the scan together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.query import Range, SearchQuery


def live(ignore: bool = False, forbidden: bool = False) -> Column:
    """status >= 0; a query with a blocked term sees status >= 1 only."""
    if forbidden:
        return F.col("status") >= 1
    return F.lit(True) if ignore else F.col("status") >= 0


def in_range(r: Range) -> Column:
    r, c = r.ordered(), F.col(r.column)
    low = F.lit(True) if r.low is None else c >= r.low
    return low if r.high is None else low & (c <= r.high)


def any_bit(column: str, mask: int) -> Column:
    return F.col(column).cast("long").bitwiseAND(F.lit(mask)) != 0


def all_bits(column: str, mask: int) -> Column:
    return F.col(column).cast("long").bitwiseAND(F.lit(mask)) == mask


def document_filter(q: SearchQuery, forbidden: bool = False) -> Column:
    """Everything but the term predicates and the category filter, which comes after the facets."""
    parts = [live(q.ignore_status, forbidden)]
    if q.blocked_levels:
        parts.append(~F.col("slevel").isin(*q.blocked_levels))
    if q.sections:
        parts.append(F.col("secid").isin(*q.sections))
    if q.no_sections:
        parts.append(~F.col("secid").isin(*q.no_sections))
    if q.database:
        parts.append(F.col("dbid") == q.database)
    if q.category_block:
        parts.append(~any_bit("category", q.category_block))
    if q.category_all:
        parts.append(all_bits("category", q.category_all))
    parts += [in_range(r) for r in q.ranges]
    parts += [F.col(c).isin(*values) for c, values in q.in_lists]
    parts += [any_bit(c, m) for c, m in q.any_bits]
    parts += [~any_bit(c, m) for c, m in q.no_bits]
    return reduce(lambda a, b: a & b, parts)


def category_filter(q: SearchQuery) -> Column:
    return any_bit("category", q.category_any) if q.category_any else F.lit(True)
