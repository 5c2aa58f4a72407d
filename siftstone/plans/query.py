"""SearchQuery, the logical form of a search, and the parser of its query strings."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field, replace
from urllib.parse import parse_qsl

from ..schema import DOCUMENTS, MAX_IN_FIELDS, MAX_IN_VALUES, MAX_TERMS, MAX_TOP, Collection

_WORD = re.compile(r"[^\W_]+")


def within(values: list | tuple, most: int, what: str) -> tuple:
    """The values, all of them: more than the limit is an error, never a shorter list."""
    if len(values) > most:
        raise ValueError(f"at most {most} {what}, not {len(values)}")
    return tuple(values)


def query_words(text: str, most: int = MAX_TERMS) -> tuple[str, ...]:
    """Distinct terms of a query text in order, tokenised like documents."""
    return within(list(dict.fromkeys(_WORD.findall(text.lower()))), most, "terms")


@dataclass(frozen=True)
class Range:
    """Closed range; None is open; swapped bounds are exchanged."""

    column: str
    low: float | None
    high: float | None

    def ordered(self) -> Range:
        if self.low is not None and self.high is not None and self.low > self.high:
            return replace(self, low=self.high, high=self.low)
        return self


@dataclass(frozen=True)
class SearchQuery:
    terms: tuple[str, ...] = ()
    not_terms: tuple[str, ...] = ()
    bool_and: bool = False
    hit_scale: int = 0  # percent of terms that have to hit
    field_mask: int = 0  # text fields of which one has to be hit
    field_terms: tuple[tuple[int, tuple[str, ...], tuple[str, ...]], ...] = ()  # field, terms, not-terms
    hit_fields: int = 0  # text fields that count for field-hit scores
    ranges: tuple[Range, ...] = ()
    in_lists: tuple[tuple[str, tuple[float, ...]], ...] = ()
    any_bits: tuple[tuple[str, int], ...] = ()
    no_bits: tuple[tuple[str, int], ...] = ()
    category_any: int = 0
    category_all: int = 0
    category_block: int = 0
    category_facets: int = 0
    blocked_levels: tuple[int, ...] = ()
    sections: tuple[int, ...] = ()
    no_sections: tuple[int, ...] = ()
    database: int = 0  # 0: all
    ignore_status: bool = False
    ignore_rank: bool = False
    relevance: str = "none"  # none, reference, bm25
    phrase: bool = False
    rank: bool = False
    weigh_terms: bool = False  # terms of status "down" don't count as hits
    base_hits: int = 0
    base_field_hits: int = 0
    base_phrase: int = 0
    base_term: int = 0
    base_category_up: int = 0
    base_category_down: int = 0
    base_rank: int = 0
    up: int = 0
    down: int = 0
    group_by: str | None = None
    order_by: str | None = None
    descending: bool = True
    top: int = MAX_TOP
    offset: int = 0
    count: int = 10
    display: tuple[tuple[str, bool], ...] = ()  # column, highlighted
    query_id: str = ""
    fetch: tuple[int, ...] = ()
    clear_cache: bool = False
    unused: dict = field(default_factory=dict, compare=False, hash=False)

    def page_key(self) -> str:
        """Query and page: what a page of results is known by."""
        return f"{self.cache_key()}:{self.offset}-{self.count}"

    def cache_key(self) -> str:
        """Equal for queries that differ only in paging and display."""
        return hashlib.md5(repr(replace(self, offset=0, count=0, display=(), query_id="", unused={})).encode()).hexdigest()


def text_key(query: str) -> str:
    """Id of a query text: md5 of it in lower case."""
    return hashlib.md5(query.lower().encode()).hexdigest()


def bits(text: str) -> int:
    """Mask of a list of bit numbers such as 1,5;9."""
    return sum({1 << int(x) for x in re.findall(r"\d+", text) if int(x) < 64})


def _number(text: str) -> float | None:
    text = text.strip()
    if not text:
        return None
    return float(text) if re.search(r"[.eE]", text) else int(text)


def parse_ranges(text: str, collection: Collection) -> tuple[Range, ...]:
    """9:[from,to],10:[a,] with open ends."""
    found = re.findall(r"(\d+)\s*:\s*\[([^,\]]*),([^\]]*)\]", text)
    return tuple(Range(collection.name(int(f)), _number(a), _number(b)).ordered() for f, a, b in found)


def parse_in(text: str, collection: Collection) -> tuple[tuple[str, tuple[float, ...]], ...]:
    """fid:[v1,v2],..."""
    found = within(re.findall(r"(\d+)\s*:\s*\[([^\]]*)\]", text), MAX_IN_FIELDS, "fields with value lists")
    numbers = lambda values: [n for v in values.split(",") if (n := _number(v)) is not None]
    return tuple((collection.name(int(f)), within(numbers(values), MAX_IN_VALUES, "values in a list")) for f, values in found)


def parse_bit_fields(text: str, collection: Collection) -> tuple[tuple, tuple]:
    """fid[b,b] any of the bits; fid{b,b} none of them."""
    any_of = tuple((collection.name(int(f)), bits(b)) for f, b in re.findall(r"(\d+)\s*\[([^\]]*)\]", text))
    none_of = tuple((collection.name(int(f)), bits(b)) for f, b in re.findall(r"(\d+)\s*\{([^}]*)\}", text))
    return any_of, none_of


def parse_keys(text: str) -> tuple[tuple[int, tuple[str, ...], tuple[str, ...]], ...]:
    """fid:terms|not-terms,..."""
    out = []
    for part in text.split(","):
        number, _, rest = part.partition(":")
        if number.strip().isdigit():
            terms, _, barred = rest.partition("|")
            out.append((int(number), query_words(terms), query_words(barred)))
    return tuple(out)


def parse_display(text: str, collection: Collection) -> tuple[tuple[str, bool], ...]:
    """0,1#,2: one of # | $ @ } marks a highlighted field."""
    return tuple((collection.name(int(n)), bool(mark)) for n, mark in re.findall(r"(\d+)\s*([#|$@}]?)", text))


def parse_params(query: str, collection: Collection = DOCUMENTS) -> SearchQuery:
    """Read a k=v&k=v query string. Parameters without effect here (geofilter, bmap, qhash) are kept in ``unused``."""
    args = dict(parse_qsl(query.lstrip("?"), keep_blank_values=True))
    take = args.pop
    num = lambda k, d=0: int(re.match(r"\s*[-+]?\d+", v).group()) if (v := take(k, "")) and re.match(r"\s*[-+]?\d+", v) else d
    mask = lambda k: bits(take(k, ""))
    any_bits, no_bits = parse_bit_fields(take("bitfields", ""), collection)
    order, order_by = num("order"), take("orderby", "")
    op, keys = num("op"), take("key", "")
    group, top = take("groupby", ""), num("ntop")
    found = SearchQuery(
        terms=query_words(take("query", "")),
        not_terms=query_words(take("not", "")),
        bool_and=bool(num("booland")),
        hit_scale=min(100, max(0, num("hitscale"))),
        field_mask=mask("fieldsfilter"),
        field_terms=parse_keys(take("keys", "")),
        hit_fields=mask("qfhits"),
        ranges=parse_ranges(take("rangefilter", ""), collection),
        in_lists=parse_in(take("in", ""), collection),
        any_bits=any_bits,
        no_bits=no_bits,
        category_any=0,
        category_block=mask("catblock"),
        category_facets=mask("catgroup"),
        blocked_levels=tuple(int(x) for x in re.findall(r"\d+", take("slevel", ""))),
        sections=(*(int(x) for x in re.findall(r"\d+", take("secid", ""))),),
        no_sections=(*(int(x) for x in re.findall(r"\d+", take("nosecs", ""))),),
        database=max(0, num("dbid")),
        ignore_status=bool(num("ignstatus")),
        ignore_rank=bool(num("ignrank")),
        relevance="reference" if num("rel") else "none",
        phrase=bool(num("phrase")),
        rank=bool(num("rank")),
        weigh_terms=bool(num("qweight")),
        base_hits=num("bhits"),
        base_field_hits=num("bfhits"),
        base_phrase=num("bphrase"),
        base_term=num("bnterm"),
        base_category_up=num("bxcatup"),
        base_category_down=num("bxcatdown"),
        base_rank=num("brank"),
        up=mask("xup"),
        down=mask("xdown"),
        group_by=collection.name(int(group)) if group.isdigit() else None,
        order_by=collection.name(int(order_by)) if order_by.isdigit() else None,
        descending=order < 0,
        top=top if 0 < top <= MAX_TOP else MAX_TOP,
        offset=max(0, num("from")),
        count=num("count", 10),
        display=parse_display(take("display", ""), collection),
        query_id=take("qid", ""),
        fetch=tuple(int(x) for x in re.findall(r"\d+", keys)) if op == 2 else (),
        clear_cache=op == 1,
    )
    wanted = mask("catfilter")
    found = replace(found, category_all=wanted) if num("multicat") else replace(found, category_any=wanted)
    return replace(found, unused=args)
