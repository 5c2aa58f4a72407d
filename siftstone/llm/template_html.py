"""Main text of web pages by deducing each host's page template from equivalence classes.

A page becomes, once, a sequence of tokens: tags with their place (names and classes of the block elements
around them) and, outside the article, texts. The occurrence vector of a token on a
host says how often it occurs on each page; it is aggregated as commutative sums over all
pages, so no page has to meet another. Tokens of a host with equal vectors and enough
support form an equivalence class. A class is valid if its tokens stand in the same order on every page that has
it, as often as they occur there; one page that contradicts this makes it invalid. A text also needs distinct pages:
every page has a sketch of its texts that copies and most near copies share, its two bits are or-ed per
token, and a text belongs to a class only if it has 5 bits and half of its host's.

The valid classes nest by the places of their tags: the template is a tree. From its root the main slot is found by
going down to the part that holds most of the host's text (not counting links, menus and the template's own) as long
as that is 60 % of what the parent has; the slot is widened to hold the host's headline. What is extracted of a page are the
slots inside it that are neither template texts nor, where the template has links, mostly links. An article
or main element that overlaps the main slot takes its place (a tie-break: it may be wider or narrower); one that lies
elsewhere is a teaser. Menus, headers, footers, sidebars, notices, adverts, forms, scripts and comments go by their
element names and class words, also inside the slot. A class name or id tells such an
element only as a whole ("site-footer", not "has-sidebar" or "related-work"), never on html, body, main or headings; on
an article only if it is a comment.

A host's template needs few pages; on hosts with a single page, or none valid, and on pages without the main slot's tag,
the article element or else all slots but those named above are kept. Templates are joined to pages by host: broadcast
where their bytes were counted to be few, else by a shuffle in which the largest hosts still stay where they are.

Edge cases: null or empty html gives ''; a null url is a host of its own; repeated rows count twice in
both sums and stay two rows; broken or unclosed markup is read to the end of the page; texts of any length can be
template texts; nothing inside an article is dropped, repeated passages included; other columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_texts, hot_join, materialise

# Element names and class words of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
SKIPPED = set("head title script style noscript template iframe object svg math select option textarea button canvas audio video".split())
OUTSIDE = set("nav header footer aside form menu dialog fieldset".split())
OUTSIDE_WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo cookie cookies consent notice notices "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments reply replies discussion share "
    "sharing social related newsletter subscribe popup modal toolbar pagination pager login signup".split()
)
# Inside the article: where its own title stands.
TITLE_WORDS = set("header masthead banner".split())
COMMENT_WORDS = set("comment comments reply replies".split())
# Sections of an article may be about these.
SUBJECT_WORDS = OUTSIDE_WORDS - COMMENT_WORDS - set("sidebar footer ads advert adverts advertisement advertisements".split())
# What may stand beside outside words in one class name or id, as in "site-footer".
NEUTRAL_WORDS = set(
    "area bar block body bottom box btn button buttons container form global inner item items left link links list main modal "
    "outer page panel post posts primary right row secondary section site slot text title top unit widget widgets wrap wrapper".split()
)
# Articles in these are teasers or comments, in other outside elements (forms, adverts) the page's own.
ASIDE = set("nav footer aside menu dialog".split())
ASIDE_WORDS = COMMENT_WORDS | set("discussion sidebar related nav navbar navigation menu footer".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
MAIN = set("article main".split())
CLOSED_BY = {  # start tags that end an open element of these names
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"},
}
ENDS_P = set(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<[!?][^>]*>?|([^<]+|<)",
    re.S | re.I,
)
MARKS = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
LONG_TEXT = 60
ARTICLE = re.compile(r"<(?:article|main)\b|=\s*[\"']?main\b", re.I)


class Piece:
    """A tag or text of a page: its template token, whether it is text, and the state around it."""

    __slots__ = ("text", "token", "outside", "main", "block", "link")

    def __init__(self, token: str, text: str | None, outside: int, main: bool, block: bool, link: bool):
        self.token, self.text, self.outside, self.main, self.block, self.link = token, text, outside, main, block, link


@lru_cache(20_000)
def outside_words(mark: str) -> frozenset[str]:
    """The outside words of one class name, id or role that consists of nothing else but neutral words."""
    found = WORD.findall(mark)
    own = OUTSIDE_WORDS.intersection(found)
    return frozenset(own) if own and all(w in own or w in NEUTRAL_WORDS for w in found) else frozenset()


@lru_cache(20_000)
def outside_level(name: str, marks: tuple[tuple[str, str], ...], main: bool) -> int:
    """0 if an element does not lie outside the main text by its name or marks, 2 if articles in it do too, else 1."""
    if name in HEADINGS or name in ("html", "body", "main") or ("role", "main") in marks:
        return 0
    level = 0
    if name in (("nav", "footer", "aside", "form") if main else OUTSIDE):
        level = 2 if name in ASIDE else 1
    section = name == "section" or any(kind == "class" and "section" in value.split() for kind, value in marks)
    for kind, value in marks:
        for mark in value.split():
            own = outside_words(mark)
            if name == "article":
                own = own & COMMENT_WORDS
            if main:
                own = own - TITLE_WORDS
            if section and (main or kind == "id"):
                own = own - SUBJECT_WORDS
            if own:
                level = max(level, 1 if ASIDE_WORDS.isdisjoint(own) else 2)
    return level


def pieces(html: str, enclosed: bool = False) -> Iterator[Piece]:
    """Tags and texts in page order, with the element state that decides about a slot.

    An article that is no comment starts inside whatever form or advert encloses it; with enclosed also in menus,
    sidebars and comments.
    """
    # Open elements: name, path, outside, main, skipped, link.
    stack: list[tuple[str, str, int, bool, bool, bool]] = [("", "", 0, False, False, False)]
    for m in TOKEN.finditer(html):
        text = m.group(5)
        if text is not None:
            _, path, outside, main, skipped, link = stack[-1]
            if not skipped:
                yield Piece(path, unescape(text), outside, main, False, link)
            continue
        name = m.group(3)
        if not name:
            continue  # comments, scripts, styles, declarations
        name = name.lower()
        if m.group(2):
            at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
            if at:
                _, path, outside, main, _, link = stack[at]
                del stack[at:]
                yield Piece("/" + path, None, outside, main, name not in INLINE, link)
            continue
        ends = CLOSED_BY.get(name, set()) | ({"p"} if name in ENDS_P else set())
        if ends:
            k = len(stack) - 1
            while k and stack[k][0] in INLINE:
                k -= 1
            if k and stack[k][0] in ends:
                del stack[k:]
        found = tuple((kind.lower(), (a or b or c).lower()) for kind, a, b, c in MARKS.findall(m.group(4))) if m.group(4) else ()
        marks = " ".join(value for _, value in found)
        _, path, outside, main, skipped, link = stack[-1]
        if name not in INLINE:
            path = f"{path}/{name}" + (f"[{marks}]" if marks else "")
        own = outside_level(name, found, main)
        if not own and (name in MAIN or found and name not in OUTSIDE and name not in ("html", "body") and "main" in marks.split()):
            if outside < 2 or enclosed or name == "main" or ("role", "main") in found:
                outside = 0
            main = main or not outside
        state = (name, path, max(outside, own), main, skipped or name in SKIPPED, link or name == "a")
        yield Piece(path if name not in INLINE else f"{path}/{name}", None, state[2], main, name not in INLINE, state[5])
        if name not in VOID and not m.group(0).endswith("/>"):
            stack.append(state)


def squeeze(text: str) -> str:
    return " ".join(text.split())


TEXT_TOKEN = re.compile(r"#[0-9a-f]{8}([0-9]+)$")


def text_token(path: str, text: str) -> str:
    return f"{path}#{zlib.crc32(text.encode('utf-8', 'replace')):08x}{len(text)}"


def tokens(html: str) -> list[str]:
    """Template tokens of a page in order: block tags, and texts outside the article."""
    return tokens_and_sketch(html)[0]


def tokens_and_sketch(html: str) -> tuple[list[str], int]:
    """Template tokens, and a mask of one or two bits that copies share: of the two least hashes of the long texts (one of
    them may be the same on every page), or of a hash of all texts if none is long."""
    out = []
    long: set[int] = set()
    short = 0
    for p in pieces(html):
        if p.text is None:
            if p.block:
                out.append(p.token)
        elif t := squeeze(p.text):
            if len(t) >= LONG_TEXT:
                long.add(zlib.crc32(t.encode("utf-8", "replace")))
                if len(long) > 2:
                    long.remove(max(long))
            elif not long:
                short = zlib.crc32(t.encode("utf-8", "replace"), short)
            if not p.main:
                out.append(text_token(p.token, t))
    mask = 0
    for x in long or {short}:
        mask |= 1 << (zlib.crc32(b"%d" % x) & 63)
    return out, mask - ((mask >> 63) << 64)


def text_inside(html: str) -> Counter[str]:
    """Characters of plain text (no links, nothing outside) in the block elements of a page by their places."""
    own: Counter[str] = Counter()
    for p in pieces(html):
        if p.text is not None and not p.link and not p.outside:
            own[p.token] += len(squeeze(p.text))
    out: Counter[str] = Counter()
    for path, n in own.items():
        while n and path:
            out[path] += n
            path = path[: cut_of(path)]
    return out


def cut_of(path: str) -> int:
    """Where the last element of a place begins; class words in brackets may hold slashes."""
    depth = 0
    for i in range(len(path) - 1, -1, -1):
        c = path[i]
        depth += (c == "]") - (c == "[")
        if c == "/" and depth <= 0:
            return i
    return 0


def main_slot(tags: dict[str, int], whole: int, headline: str | None = None, share: float = 0.6) -> str:
    """The place in the template tree that holds most text: down from the root to the largest child while it
    has enough of its parent's text; then up until the headline is inside. '' if the root itself or nothing has."""
    children: dict[str, list[str]] = {}
    for path in tags:
        up = path[: cut_of(path)]
        while up and up not in tags:
            up = up[: cut_of(up)]
        children.setdefault(up, []).append(path)
    at, held = "", whole
    while children.get(at) and held:
        best = max(children[at], key=lambda c: (tags[c], c))
        if tags[best] < share * held:
            break
        at, held = best, tags[best]
    while at and headline and not headline.startswith(at + "/"):
        at = at[: cut_of(at)]
    return "" if at.rsplit("/", 1)[-1].split("[")[0] in ("", "html", "body") else at


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def template_text(html: str, template: set[str], slot: str = "") -> str:
    """The remaining slots of a page, inside its template's main slot if it has that, as blocks joined by blank lines."""
    seen = list(pieces(html))
    if slot and (there := [p for p in seen if p.token == slot or p.token.startswith(slot + "/")]):
        if not any(p.main and not p.outside and p.text and not p.text.isspace() for p in there):
            # No article, or teasers elsewhere on the page: the slot is the main text.
            for p in seen:
                p.main = p.token == slot or p.token.startswith(slot + "/")
            return slots_text(seen, template, True)
    text = slots_text(seen, template)
    if not any(p.main and not p.outside and p.text and not p.text.isspace() for p in seen) and ARTICLE.search(html):
        # An unclosed menu or sidebar may hold the page's article: the longer text is the page's.
        text = max(text, slots_text(list(pieces(html, enclosed=True)), template), key=len)
    return text


def slots_text(seen: list[Piece], template: set[str], in_slot: bool = False) -> str:
    """in_slot: the main pieces are those of the template's main slot, not of an article."""
    has_main = any(p.main for p in seen)
    judged = in_slot or not has_main  # by the template's texts
    # Places where the template holds the text of a link.
    menus = {p.token for p in seen if p.link and p.text and text_token(p.token, squeeze(p.text)) in template} if template and judged else set()
    slots: list[tuple[list[str], bool, bool]] = []  # blocks, wanted, linked
    blocks: list[str] = []
    run: list[str] = []
    chars = linked = 0
    wanted = False

    def end_block() -> None:
        nonlocal run
        if run:
            if t := squeeze("".join(run)):
                blocks.append(t)
            run = []

    def end_slot() -> None:
        nonlocal blocks, chars, linked
        end_block()
        if blocks:
            slots.append((blocks, wanted, judged and linked * 2 > chars))
        blocks, chars, linked = [], 0, 0

    for p in seen:
        keep = not p.outside and (p.main or not has_main)
        if keep != wanted:
            end_slot()
            wanted = keep
        if p.text is None:
            if p.block:
                end_block()
                if p.token in template:
                    end_slot()
            elif p.token.endswith("/br"):
                run.append(" ")
        elif wanted:
            t = p.text
            if judged and template:
                s = squeeze(t)
                if s and text_token(p.token, s) in template:
                    continue
            run.append(t)
            chars += len(t)
            linked += len(t) if p.link and p.token in menus else 0
    end_slot()
    return "\n\n".join(b for own, good, links in slots if good and not links for b in own)


def _page_hash(page: str, count: int, seed: int) -> int:
    return zlib.crc32(f"{seed}:{count}:{page}".encode("utf-8", "replace")) & 0x7FFFFFFF


def host_column(url: Column) -> Column:
    """host_of in Arrow batches: the one parser of hosts."""

    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([host_of(v) for v in x.to_pylist()], pa.string())

    return run(url)


def tokenised(pages: DataFrame) -> DataFrame:
    """host, key, sketch, tokens, places and the text inside them: each page (host, key, html) is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                read = [tokens_and_sketch(x) for x in as_texts(part.column(2))]
                inside = [text_inside(x) for x in as_texts(part.column(2))]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([k for _, k in read], pa.int64()),
                        pa.array([t for t, _ in read], pa.list_(pa.string())),
                        pa.array([list(x) for x in inside], pa.list_(pa.string())),
                        pa.array([list(x.values()) for x in inside], pa.list_(pa.int64())),
                    ],
                    ["host", "key", "sketch", "tokens", "places", "chars"],
                )

    return pages.select("host", "key", "html").mapInArrow(run, "host string, key string, sketch long, tokens array<string>, places array<string>, chars array<bigint>")


def occurrence_vectors(pages: DataFrame) -> DataFrame:
    """host, token, pages, total, the two sums that stand for the token's occurrence vector, the bits of its pages'
    sketches, and the text inside; of tokenised pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], list[int]] = {}

        def rows() -> pa.RecordBatch:
            keys, values = list(sums), list(sums.values())
            columns = [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys])]
            columns += [pa.array([v[j] for v in values], pa.int64()) for j in range(6)]
            return pa.RecordBatch.from_arrays(columns, ["host", "token", "pages", "total", "s1", "s2", "bits", "inside"])

        for batch in batches:
            for host, key, mask, found, places, chars in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                inside = dict(zip(places, chars, strict=True))
                inside["#page"] = sum(n for path, n in inside.items() if not cut_of(path))
                for token, n in [("#page", 1), *Counter(found).items()]:
                    v = sums.setdefault((host, token), [0, 0, 0, 0, 0, 0])
                    v[0] += 1
                    v[1] += n
                    v[2] += _page_hash(str(key), n, 1)
                    v[3] += _page_hash(str(key), n, 2)
                    v[4] |= mask
                    v[5] += inside.get(token, 0)
            if len(sums) > 100_000:
                yield rows()
                sums.clear()
        if sums:
            yield rows()

    schema = "host string, token string, pages long, total long, s1 long, s2 long, bits long, inside long"
    return (
        pages.mapInArrow(run, schema)
        .groupBy("host", "token")
        .agg(*(F.sum(c).alias(c) for c in ("pages", "total", "s1", "s2", "inside")), F.bit_or("bits").alias("bits"))
    )


def classes(vectors: DataFrame, support: float = 0.5, least_pages: int = 2, least_distinct: int = 5) -> DataFrame:
    """host, classes (arrays of tokens): tokens with equal vectors on at least a share of a host's pages, texts also of its distinct pages."""
    size = vectors.filter("token = '#page'").select("host", F.col("pages").alias("host_pages"), F.bit_count("bits").alias("host_bits"))
    distinct = F.bit_count("bits") >= F.greatest(F.lit(least_distinct), F.ceil(F.col("host_bits") * support))
    is_text = F.col("token").rlike("#[0-9a-f]{8}[0-9]+$")
    return (
        vectors.join(size, "host")
        .filter((F.col("pages") >= F.greatest(F.lit(least_pages), F.ceil(F.col("host_pages") * support))) & (F.col("token") != "#page"))
        .filter(~is_text | distinct)
        .groupBy("host", "pages", "total", "s1", "s2")
        .agg(F.array_sort(F.collect_list("token")).alias("tokens"))
        .filter(F.size("tokens") >= 2)
        .groupBy("host")
        .agg(F.array_sort(F.collect_list("tokens")).alias("classes"))
    )


SMALL_BYTES = 32 << 20


def with_host_rows(pages: DataFrame, by_host: DataFrame, tokens: Column) -> DataFrame:
    """pages (a stored table or a scan) joined to the one row of each host (with its number of pages); all of them are
    broadcast if their tokens are counted to have few bytes, else those of the largest hosts."""
    size = F.aggregate(tokens, F.lit(0).cast("long"), lambda acc, t: acc + F.length(t) + 16)
    counted = by_host.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    if counted["bytes"] + 64 * counted["n"] <= SMALL_BYTES:
        return pages.join(F.broadcast(by_host), "host")
    return hot_join(pages, by_host, "host", "pages", most=200)


def in_order(own: list[str], size: int) -> int:
    """Digest of the order of a class's tokens on a page: the same as often as they occur, else -1."""
    first = own[:size]
    if len(set(first)) != size or len(own) % size or own != first * (len(own) // size):
        return -1
    digest = 0
    for t in first:
        digest = zlib.crc32(t.encode("utf-8", "replace"), digest)
    return digest


def templates(read: DataFrame, vectors: DataFrame, support: float) -> DataFrame:
    """host, pages, template (tokens of the valid classes), slot (place of the main slot or '') of every host; of tokenised pages."""
    sizes = vectors.filter("token = '#page'").select("host", "pages")
    found = materialise(classes(vectors, support).join(sizes, "host"), "classes")

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int, int]] = set()
        for batch in batches:
            for host, own_tokens, many in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                where = {t: k for k, c in enumerate(many) for t in c}
                own: dict[int, list[str]] = {}
                for t in own_tokens:
                    if (k := where.get(t)) is not None:
                        own.setdefault(k, []).append(t)
                # Pages without the class say nothing.
                seen.update((host, k, in_order(x, len(many[k]))) for k, x in own.items())
        rows = sorted(seen)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())],
                ["host", "class", "digest"],
            )

    valid = (
        with_host_rows(read.select("host", "tokens"), found, F.flatten("classes"))
        .select("host", "tokens", "classes")
        .mapInArrow(orders, "host string, class int, digest long")
        .groupBy("host", "class")
        .agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
        .filter("low = high and low >= 0")
        .select("host", "class")
    )
    chosen = valid.join(found.select("host", F.posexplode("classes").alias("class", "own")), ["host", "class"]).select("host", F.explode("own").alias("token"))
    known = vectors.select("host", "token", "inside", "pages", "total")

    def nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, own, inside, total, seen, pages, whole in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                held = {t: n for t, n in zip(own, inside, strict=True) if not TEXT_TOKEN.search(t) and t[:1] == "/" and t[:2] != "//"}
                on = dict(zip(own, seen, strict=True))
                left = dict(held)
                for t, n in zip(own, total, strict=True):
                    if (m := TEXT_TOKEN.search(t)) and (n := n * int(m.group(1))) <= held.get(t[: m.start()], 0):
                        # The template's own text, which is no part of what fills the slots.
                        whole = (whole or 0) - n
                        path = t[: m.start()]
                        while path:
                            if path in left:
                                left[path] -= n
                            path = path[: cut_of(path)]
                tags = {t: max(0, left[t]) for t, n in zip(own, total, strict=True) if t in left and n == on[t]}
                headlines = [t for t in tags if t.rsplit("/", 1)[-1].split("[")[0] == "h1"]
                slot = main_slot(tags, max(0, whole or 0), headlines[0] if len(headlines) == 1 else None)
                columns = [[host], [pages], [own], [slot]]
                kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "pages", "template", "slot"])

    tokens_of = chosen.join(known, ["host", "token"]).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("token", "inside", "total", F.col("pages").alias("seen")))).alias("x"))
    rows = (
        vectors.filter("token = '#page'")
        .select("host", "pages", F.col("inside").alias("whole"))
        .join(tokens_of, "host", "left")
        .select("host", *(F.coalesce(F.col(f"x.{c}"), F.array().cast(f"array<{k}>")).alias(c) for c, k in (("token", "string"), ("inside", "bigint"), ("total", "bigint"), ("seen", "bigint"))), "pages", "whole")
    )
    return rows.mapInArrow(nest, "host string, pages long, template array<string>, slot string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars, and n_template (tokens of the host's template)."""
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_column(F.col(url_col)).alias("host"))
    read = materialise(tokenised(base.withColumn("key", F.concat_ws("|", F.col("page_id").cast("string"), "url"))), "tokens", compression="zstd")
    vectors = materialise(occurrence_vectors(read), "vectors")
    found = materialise(templates(read, vectors, support), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes = [], []
            for html, tokens_, slot in zip(as_texts(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                out.append(template_text(html, set(tokens_ or ()), slot or ""))
                sizes.append(len(tokens_ or ()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(out, pa.string()),
                    pa.array([len(t) for t in out], pa.int64()),
                    pa.array(sizes, pa.int32()),
                ],
                ["page_id", "url", "text", "n_chars", "n_template"],
            )

    kind = base.schema["page_id"].dataType.simpleString()
    return (
        with_host_rows(base, found, F.col("template"))
        .select("page_id", "url", "html", "template", "slot")
        .mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_template int")
    )
