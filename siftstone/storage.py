"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir.

    Where the session names none, a temporary folder serves a local master; on a cluster that would be another
    folder on each machine, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="shared-"))
        base = "file://" + _LOCAL[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back."""
    path = shared_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system layer."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, through Hadoop's file system layer."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Changes with the files of some folders: their names, sizes and times."""
    out = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
            out.append(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.md5("|".join(sorted(out)).encode()).hexdigest()


class Workspace:
    """Intermediate tables of one run. A table is dropped once nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, shared_dir(spark, name), 0
        self.held: dict[int, tuple[DataFrame, str]] = {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{self.n}-{name}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if held := self.held.pop(id(t), None):
                drop_dir(self.spark, held[1])

    def drop_others(self, *kept: DataFrame) -> None:
        """Drop all tables but these."""
        self.drop(*(t for t, _ in list(self.held.values()) if all(t is not k for k in kept)))
