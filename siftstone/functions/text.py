"""Text, URL, HTML, hash and time functions as Column expressions."""

from __future__ import annotations

import re
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAK = r"[^\p{L}\p{N}]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased words of a text, in order; empty for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def term_size(term: Column) -> Column:
    """Characters of a term, multibyte ones counted twice."""
    return (F.length(term) + F.length(F.regexp_replace(term, r"[\x00-\x7F]", ""))).cast("long")


def leading_number(text: Column, kind: str) -> Column:
    """Number at the start of a text as in C: 0 if there is none."""
    pattern = r"^\s*[-+]?\d+" if kind in ("int", "bigint", "long") else r"^\s*[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?"
    return F.coalesce(F.trim(F.regexp_extract(text, pattern, 0)).try_cast(kind), F.lit(0).cast(kind))


# --- HTML -----------------------------------------------------------------------------------

# Code points of the named entities; a no-break space becomes a blank.
ENTITIES = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'", "nbsp": " "}
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def decode_entities(text: Column) -> Column:
    """Named and numeric character references, each decoded once; unknown ones stay, impossible numbers become U+FFFD."""
    table = F.create_map(*(F.lit(x) for kv in ENTITIES.items() for x in kv))

    def char(name: Column) -> Column:
        hexadecimal = F.conv(F.substring(name, 3, 6), 16, 10).cast("int")
        code = F.when(F.lower(F.substring(name, 2, 1)) == "x", hexadecimal).otherwise(F.substring(name, 2, 7).try_cast("int"))
        real = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        number = F.when(real, F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")).otherwise("\ufffd")
        return F.when(F.substring(name, 1, 1) == "#", number).otherwise(F.try_element_at(table, name))

    def piece(part: Column) -> Column:
        name = F.regexp_extract(part, REFERENCE, 1)
        return F.coalesce(F.concat(char(F.nullif(name, F.lit(""))), F.substring(part, F.length(name) + 2, F.lit(1 << 30))), F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), piece)
    return F.when(F.instr(text, "&") == 0, text).otherwise(F.concat(F.get(parts, 0), F.array_join(rest, "")))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def html_title(html: Column) -> Column:
    return squeeze(decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def html_strip(html: Column) -> Column:
    """Visible text: without comments, scripts, styles and tags; entities decoded, blanks squeezed."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?is)<script[^>]*>.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style[^>]*>.*?</style>", " ")
    return squeeze(decode_entities(F.regexp_replace(text, r"<[^>]*>", " ")))


def html_trim(text: Column) -> Column:
    """Entities and blanks only."""
    return squeeze(decode_entities(text))


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))


# --- URLs -----------------------------------------------------------------------------------


def url_host(url: Column) -> Column:
    return F.regexp_extract(ascii_lower(url), r"^[a-z]+://([^/?#:]+)", 1)


def url_key(url: Column) -> Column:
    """First 8 bytes of the md5 of the ASCII-lower-cased URL, in hex."""
    return F.substring(F.md5(ascii_lower(url)), 1, 16)


def url_template(pattern: str, *groups: Column) -> Column:
    """Fill <1>, <2>, ... of a URL pattern; blanks and non-ASCII characters are percent-encoded."""
    out = F.lit(pattern)
    for i, g in enumerate(groups, 1):
        safe = F.replace(F.url_encode(g), F.lit("+"), F.lit("%20"))
        for code, char in (("%2F", "/"), ("%3A", ":"), ("%3F", "?"), ("%3D", "="), ("%26", "&"), ("%23", "#"), ("%25", "%")):
            safe = F.replace(safe, F.lit(code), F.lit(char))
        out = F.replace(out, F.lit(f"<{i}>"), F.coalesce(safe, F.lit("")))
    return out


# Characters that stay as they are in an absolute link.
LINK_SAFE = "/:?#[]@!$&'()*+,;=~%"


def percent_encoded(text: Column) -> Column:
    """Blanks and non-ASCII characters as %XX; characters with a meaning in URLs, and % itself, stay."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for c in LINK_SAFE:  # the percent sign comes last
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def without_dots(path: Column) -> Column:
    """A path without . and .. segments."""

    def step(acc: Column, seg: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        return F.when(seg == ".", acc).when(seg == "..", up).otherwise(F.concat(acc, F.array(seg)))

    segments = F.split(path, "/")
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    ended = F.element_at(segments, -1).isin(".", "..")
    joined = F.array_join(kept, "/")
    return F.when(F.contains(path, F.lit("/.")), F.when(ended, F.concat(joined, F.lit("/"))).otherwise(joined)).otherwise(path)


def absolute_url(base: Column, link: Column) -> Column:
    """A link of a page as an absolute URL: with a scheme, //host, /path, ?query, #part or beside the page; . and ..
    segments resolved, blanks and non-ASCII characters percent-encoded; null if either is null."""
    link = F.trim(F.regexp_replace(link, r"[\r\n\t]", ""))
    origin = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    rest = F.substring(base, F.length(origin) + 1, F.lit(1 << 30))
    path = F.regexp_extract(rest, r"^[^?#]*", 0)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"^/(.*/)?", 1))
    own_path = F.regexp_extract(link, r"^[^?#]*", 0)
    tail = F.substring(link, F.length(own_path) + 1, F.lit(1 << 30))
    beside = F.concat(origin, without_dots(F.when(F.startswith(link, F.lit("/")), own_path).otherwise(F.concat(folder, own_path))), tail)
    joined = (
        F.when(link == "", base)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*:", 0), link))
        .when(F.startswith(link, F.lit("?")), F.concat(origin, path, link))
        .when(F.startswith(link, F.lit("#")), F.concat(F.regexp_extract(base, r"^[^#]*", 0), link))
        .otherwise(beside)
    )
    return F.when(base.isNotNull() & link.isNotNull(), percent_encoded(joined))


def query_args(query: Column) -> Column:
    """Map of decoded arguments of k=v&k=v; control characters become _."""
    pairs = F.str_to_map(query, F.lit("&"), F.lit("="))
    clean = lambda x: F.regexp_replace(F.try_url_decode(x), r"[\x00-\x1F]", "_")
    return F.transform_values(pairs, lambda _, v: clean(F.coalesce(v, F.lit(""))))


# Media types by extension.
MIME_TYPES = (
    ("text/html", "html htm shtml"),
    ("text/css", "css"),
    ("text/xml", "xml"),
    ("image/gif", "gif"),
    ("image/jpeg", "jpeg jpg"),
    ("application/x-javascript", "js"),
    ("application/atom+xml", "atom"),
    ("application/rss+xml", "rss"),
    ("text/mathml", "mml"),
    ("text/plain", "txt php am in cpp c h m4 sh guess sub awk"),
    ("text/vnd.sun.j2me.app-descriptor", "jad"),
    ("text/vnd.wap.wml", "wml"),
    ("text/x-component", "htc"),
    ("image/png", "png"),
    ("image/tiff", "tif tiff"),
    ("image/vnd.wap.wbmp", "wbmp"),
    ("image/x-icon", "ico"),
    ("image/x-jng", "jng"),
    ("image/x-ms-bmp", "bmp"),
    ("image/svg+xml", "svg"),
    ("application/java-archive", "jar war ear"),
    ("application/mac-binhex40", "hqx"),
    ("application/msterm", "doc"),
    ("application/pdf", "pdf"),
    ("application/postscript", "ps eps ai"),
    ("application/rtf", "rtf"),
    ("application/vnd.ms-excel", "xls"),
    ("application/vnd.ms-powerpoint", "ppt"),
    ("application/vnd.wap.wmlc", "wmlc"),
    ("application/vnd.wap.xhtml+xml", "xhtml"),
    ("application/vnd.google-earth.kml+xml", "kml"),
    ("application/vnd.google-earth.kmz", "kmz"),
    ("application/x-cocoa", "cco"),
    ("application/x-java-archive-diff", "jardiff"),
    ("application/x-java-jnlp-file", "jnlp"),
    ("application/x-makeself", "run"),
    ("application/x-perl", "pl pm"),
    ("application/x-pilot", "prc pdb"),
    ("application/x-rar-compressed", "rar"),
    ("application/x-redhat-package-manager", "rpm"),
    ("application/x-sea", "sea"),
    ("application/x-shockwave-flash", "swf"),
    ("application/x-stuffit", "sit"),
    ("application/x-tcl", "tcl tk"),
    ("application/x-x509-ca-cert", "der pem crt"),
    ("application/x-xpinstall", "xpi"),
    ("application/zip", "zip"),
    ("application/octet-stream", "bin exe dll deb dmg eot img iso msi msp msm"),
    ("audio/midi", "mid midi kar"),
    ("audio/mpeg", "mp3"),
    ("audio/x-realaudio", "ra"),
    ("video/3gpp", "3gpp 3gp"),
    ("video/mpeg", "mpeg mpg"),
    ("video/quicktime", "mov"),
    ("video/x-flv", "flv"),
    ("video/x-mng", "mng"),
    ("video/x-ms-asf", "asx asf"),
    ("video/x-ms-wmv", "wmv"),
    ("video/x-msvideo", "avi"),
)
MIME = {name: kind for kind, names in MIME_TYPES for name in names.split()}


def mime_type(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv))
    return F.coalesce(
        F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))), F.lit("application/octet-stream")
    )


# --- time -----------------------------------------------------------------------------------


def http_time(text: Column) -> Column:
    """Epoch seconds of an HTTP date, an ISO date or a date and time; null if it is none."""
    plain = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},?\s+|\s+(GMT|UTC)$", "")
    kinds = ("dd MMM yyyy HH:mm:ss", "dd-MMM-yy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*(F.unix_timestamp(F.try_to_timestamp(plain, F.lit(k))) for k in kinds))


def http_date(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


# --- presentation ---------------------------------------------------------------------------


def json_text(text: Column) -> Column:
    """Drop CR, LF, NUL and TAB; escape quotes and backslashes."""
    text = F.regexp_replace(text, r"[\r\n\x00\t]", "")
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("'"), F.lit("&#39;")), F.lit('"'), F.lit("&#34;"))


def highlight(text: Column, terms: list[str], open_tag: str = "<b>", close_tag: str = "</b>") -> Column:
    """Wrap whole words that are one of the terms, which are taken literally."""
    if not terms:
        return text
    longest_first = sorted((t for t in terms if t), key=len, reverse=True)
    plain = "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in longest_first)
    whole = rf"(?i)(?<!\w)({plain})(?!\w)"
    replacement = "".join(re.sub(r"([\\$])", r"\\\1", x) if i != 1 else x for i, x in enumerate((open_tag, "$1", close_tag)))
    return F.regexp_replace(text, whole, replacement)
