"""Document dumps, record files, generators and the CSV and JSON sinks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import http_time
from ..schema import MAX_FETCH

DUMP_SCHEMA = "globalid long, rank double, category long, title string, content string, author string, time int, gid long, val double, url string"
RECORD_SCHEMA = (
    "id long, property struct<status:int,crc:int,slevel:int,category:bigint,rank:double>, "
    "text_index struct<title:string,content:string,comment:string>, int_index map<string,int>, long_index map<string,bigint>, "
    "double_index map<string,double>, display struct<url:string,img:string>"
)


def generate(spark: SparkSession, n: int, first: int = 100_000_000, seed: int = 1) -> DataFrame:
    """Synthetic documents of seven fields."""
    i = F.col("id").cast("string")
    return spark.range(n).select(
        (F.col("id") + first).alias("globalid"), F.lit(1.0).alias("rank"), F.lit(1).cast("long").alias("category"),
        F.concat(F.lit("title:"), i).alias("title"), F.concat(F.lit("content:"), i).alias("content"), F.concat(F.lit("author:"), i).alias("author"),
        (F.lit(1_700_000_000) + F.col("id")).cast("int").alias("time"), (F.col("id") + first).alias("gid"), F.rand(seed).alias("val"),
        F.concat(F.lit("http://demo.com/"), i, F.lit(".html")).alias("url"),
    )


def generate_records(spark: SparkSession, n: int) -> DataFrame:
    """Synthetic nested records: three text, int, long and double fields, two for display."""
    i, s = F.col("id"), F.col("id").cast("string")
    numbers = lambda kind, a, b, c: F.create_map(*(x for k, d in enumerate((a, b, c)) for x in (F.lit(str(k)), (i / d).cast(kind))))
    url = F.concat(F.lit("http://demo.com/"), s)
    return spark.range(n).select(
        F.conv(F.substring(F.md5(url), 2, 15), 16, 10).cast("long").alias("id"),
        F.struct(F.lit(1).alias("status"), (i + 1).cast("int").alias("crc"), F.lit(0).alias("slevel"), F.expr("shiftleft(1L, cast(id % 62 as int))").alias("category"), F.lit(1.0).alias("rank")).alias("property"),
        F.struct(*(F.concat(F.lit(f"{f} "), s).alias(f) for f in ("title", "content", "comment"))).alias("text_index"),
        numbers("int", 3, 9, 31).alias("int_index"), numbers("long", 2, 7, 21).alias("long_index"), numbers("double", 33, 53, 73).alias("double_index"),
        F.struct(url.alias("url"), F.concat(url, F.lit(".png")).alias("img")).alias("display"),
    )


def read_dumps(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """JSON dumps: one or more files, globs or folders (a chain of dump files is a folder)."""
    return spark.read.schema(DUMP_SCHEMA).json(paths)


def read_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Nested record files, flattened to one row of columns; records without a crc are left out."""
    raw = spark.read.schema(RECORD_SCHEMA).json(paths)
    return flatten_records(raw)


def flatten_records(raw: DataFrame) -> DataFrame:
    numbered = [F.try_element_at(f"{kind}_index", F.lit(str(k))).alias(f"{kind}_{k}") for kind in ("int", "long", "double") for k in range(3)]
    return raw.filter("property.crc <> 0").select("id", "property.*", "text_index.*", *numbered, "display.*")


def write_dumps(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Dump files that roll over after so many rows."""
    df.write.option("maxRecordsPerFile", rows_per_file).json(path)


# --- binary dumps: records of a fixed header, field descriptors and content ---------------------

HEAD = struct.Struct("<qqdhhhh")  # globalid, category, rank, status, slevel, fields, reserved
FIELD = struct.Struct("<iii")  # flag, offset, length
TEXT_FLAG, INT_FLAG, LONG_FLAG, DOUBLE_FLAG = 8, 1, 2, 4


def encode_binary(globalid: int, category: int, rank: float, status: int, slevel: int, fields: list[tuple[int, str]]) -> bytes:
    content, table, at = b"", b"", 0
    for flag, value in fields:
        data = value.encode()
        table += FIELD.pack(flag, at, len(data))
        content += data
        at += len(data)
    body = HEAD.pack(globalid, category, rank, status, slevel, len(fields), 0) + table + content
    return struct.pack("<i", len(body)) + body


def decode_binary(data: bytes) -> Iterator[tuple]:
    """globalid, category, rank, status, slevel, flags, values of each record; a cut-off last record ends it."""
    at = 0
    while at + 4 <= len(data):
        (size,) = struct.unpack_from("<i", data, at)
        if size < HEAD.size or at + 4 + size > len(data):
            return
        start = at + 4
        globalid, category, rank, status, slevel, n, _ = HEAD.unpack_from(data, start)
        fields = [FIELD.unpack_from(data, start + HEAD.size + k * FIELD.size) for k in range(n)]
        base = start + HEAD.size + n * FIELD.size
        values = [data[base + o : base + o + k].decode("utf-8", "replace") for _, o, k in fields]
        yield globalid, category, rank, status, slevel, [f for f, _, _ in fields], values
        at = start + size


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Binary dump files, decoded file by file in Arrow batches; files roll over, which bounds a task."""
    schema = "globalid long, category long, rank double, status int, slevel int, flags array<int>, `values` array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = list(decode_binary(data))
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string())]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                    ["globalid", "category", "rank", "status", "slevel", "flags", "values"],
                )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


# --- projections and sinks ----------------------------------------------------------------------


def dump_projection(records: DataFrame, texts: list[str], numbers: list[str], times: list[str], display: list[str]) -> DataFrame:
    """Crawl record -> dump row: empty texts become a blank, missing numbers 0, dates epochs; crc32 of the texts."""
    text = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(" ")) for c in texts}
    return records.select(
        *(v.alias(c) for c, v in text.items()),
        *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in numbers),
        *(F.coalesce(http_time(F.col(c)), F.lit(0)).alias(c) for c in times),
        *(F.col(c) for c in display),
        F.crc32(F.concat(*text.values())).alias("crc"),
    )


def base64_columns(df: DataFrame) -> DataFrame:
    """Every value as text in base64, as the CSV sink writes it."""
    return df.select(*(F.base64(F.encode(F.coalesce(F.col(c).cast("string"), F.lit("")), "UTF-8")).alias(c) for c in df.columns))


def write_csv(df: DataFrame, path: str) -> None:
    base64_columns(df).write.option("header", True).csv(path)


def fetch(docs: DataFrame, ids: list[int] | DataFrame, columns: list[str], most: int = MAX_FETCH) -> DataFrame:
    """id, json of the given ids; unknown ones are skipped. A list of more than ``most`` ids is an error (a
    DataFrame of ids has no limit)."""
    if isinstance(ids, list):
        if len(ids) > most:
            raise ValueError(f"at most {most} ids in a list, not {len(ids)}")
        ids = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "id long"))
    quoted: list[Column] = [F.col(c).cast("string").alias(c) for c in columns]
    return docs.join(ids, "id", "left_semi").select("id", F.to_json(F.struct(*quoted)).alias("json"))
