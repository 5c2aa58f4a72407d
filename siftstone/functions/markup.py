"""Python functions for what Columns can't express: charsets, block filtering, sentences."""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Callable
from html import unescape
from urllib.parse import quote, urljoin

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


# Byte order marks, longest first.
MARKS = (
    (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"),
)
DECLARED = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)
PROMOTED = {"gbk": "gb18030", "gb2312": "gb18030"}


def detect_charset(data: bytes | None) -> str | None:
    """Charset of bytes: byte order mark, valid UTF-8, escape sequences, a declaration, then likelihood."""
    if data is None:
        return None
    for mark, name in MARKS:
        if data.startswith(mark):
            return name
    if b"\x1b$" in data or b"\x1b(J" in data:
        return "iso-2022-jp"
    if data.isascii():
        return "ascii"
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        pass
    if (m := DECLARED.search(data[:4096])) and (name := m.group(1).decode("ascii").lower()):
        try:
            codecs.lookup(name)
            return PROMOTED.get(name, name)
        except LookupError:
            pass
    best, least = "windows-1252", None
    for name in ("gb18030", "big5", "shift_jis", "euc-jp", "euc-kr"):
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        # Frequent blocks of each script speak for a charset; rare and private characters against it.
        odd = sum(not ("一" <= c <= "鿿" or "぀" <= c <= "ヿ" or "가" <= c <= "힣" or c < "Ā" or "　" <= c <= "〿" or "＀" <= c <= "￯") for c in text)
        if least is None or (odd, len(text)) < least:
            best, least = name, (odd, len(text))
    high = sum(b > 127 for b in data)
    return best if least is not None and least[0] * 20 <= high and high * 3 > len(data) else "windows-1252"


def to_utf8(data: bytes | None, header_charset: str | None = None) -> str | None:
    """Text of bytes: by detection, else by the header's charset, bad bytes replaced."""
    if data is None:
        return None
    for name in (detect_charset(data), header_charset):
        try:
            return data.decode(PROMOTED.get((name or "").lower(), name or "utf-8")).removeprefix("﻿")
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("utf-8", "replace")


def inflate(data: bytes | None) -> bytes | None:
    """Content of gzip, zlib or raw deflate data; other bytes as they are."""
    if not data:
        return data
    for bits in (47, 15, -15):
        try:
            return zlib.decompress(data, bits)
        except zlib.error:
            continue
    return data


BLOCK = re.compile(r"(?i)</?(?:p|div|td|tr|table|ul|ol|li|h[1-6]|br|section|article|nav|header|footer|aside|form)\b[^>]*>")
DROPPED = re.compile(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<title\b.*?</title\s*>")
LINK = re.compile(r"(?is)<a\b[^>]*>(.*?)</a>")
TAG = re.compile(r"<[^>]*>")
SENTENCE = re.compile(r"(?<=[?!.。？！])\s*")


def content_blocks(html: str | None, least: int = 96, link_share: float = 0.5) -> list[str]:
    """Blocks of a page that are long enough and not mostly links."""
    kept = []
    for block in BLOCK.split(DROPPED.sub(" ", html or "")):
        text = " ".join(unescape(TAG.sub(" ", block)).split())
        linked = sum(len(" ".join(unescape(TAG.sub(" ", x)).split())) for x in LINK.findall(block))
        if len(text.encode()) >= least and linked <= link_share * len(text):
            kept.append(text)
    return kept


def sentences(text: str | None) -> list[str]:
    return [s for s in (x.strip() for x in SENTENCE.split(text or "")) if s]


def strip_html(html: str | None) -> str | None:
    """Visible text of a page, as html_strip."""
    if html is None:
        return None
    html = re.sub(r"(?s)<!--.*?-->", " ", html)
    html = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>", " ", html)
    return " ".join(unescape(TAG.sub(" ", html)).split())


def join_url(base: str | None, link: str | None) -> str | None:
    """Absolute form of a link, as absolute_url; null where there is none."""
    if base is None or link is None:
        return None
    try:
        return quote(urljoin(base, link.strip()), safe="%/:?#[]@!$&'()*+,;=~-._")
    except ValueError:
        return None


def mark_terms(text: str | None, terms: list[str] | None) -> str | None:
    """Whole words of a text that are one of the terms in <b> and </b>."""
    plain = sorted({t for t in terms or () if t}, key=len, reverse=True)
    if text is None or not plain:
        return text
    return re.sub(rf"(?i)(?<!\w)({'|'.join(map(re.escape, plain))})(?!\w)", r"<b>\1</b>", text)


def _pairs(fn: Callable):
    """An Arrow-batched string function of two columns."""

    @F.arrow_udf("string")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([fn(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.string())

    return run


def _udf(fn: Callable, kind: str):
    """An Arrow-batched function of one column; made on the driver, as it needs a session."""

    @F.arrow_udf(kind)
    def run(x: pa.Array) -> pa.Array:
        return pa.array([fn(v) for v in x.to_pylist()], pa.list_(pa.string()) if kind.startswith("array") else pa.string())

    return run


def charset_of(data: Column) -> Column:
    return _udf(detect_charset, "string")(data)


def utf8_of(data: Column) -> Column:
    return _udf(to_utf8, "string")(data)


def inflated(data: Column) -> Column:
    @F.arrow_udf("binary")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([inflate(v) for v in x.to_pylist()], pa.binary())

    return run(data)


def blocks_of(html: Column) -> Column:
    return _udf(content_blocks, "array<string>")(html)


def sentences_of(text: Column) -> Column:
    return _udf(sentences, "array<string>")(text)


def register(spark: SparkSession, dictionary=None) -> None:
    """Make the functions callable from SQL: charset_of, utf8_of, html_blocks, text_sentences, html_text, url_join,
    highlight and, with a dictionary (of operators.segment), segment.

    They are Arrow-batched; DataFrame code has html_strip, absolute_url and highlight of functions.text as Columns.
    """
    for name, fn, kind in (
        ("charset_of", detect_charset, "string"),
        ("utf8_of", to_utf8, "string"),
        ("html_blocks", content_blocks, "array<string>"),
        ("text_sentences", sentences, "array<string>"),
    ):
        spark.udf.register(name, _udf(fn, kind))

    spark.udf.register("html_text", _udf(strip_html, "string"))
    spark.udf.register("url_join", _pairs(join_url))
    spark.udf.register("highlight", _pairs(mark_terms))
    if dictionary is not None:
        from ..operators.segment import segment

        shared = spark.sparkContext.broadcast(dictionary)

        @F.arrow_udf("array<struct<word:string,off:int,idf:double,attr:string>>")
        def run(x: pa.Array) -> pa.Array:
            kind = pa.list_(pa.struct([("word", pa.string()), ("off", pa.int32()), ("idf", pa.float64()), ("attr", pa.string())]))
            return pa.array([segment(v, shared.value) for v in x.to_pylist()], kind)

        spark.udf.register("segment", run)
