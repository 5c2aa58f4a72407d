"""Incremental flows over file streams. Offsets live in checkpoints; every flow is at least once and idempotent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import latest, upsert


def tail(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    """New files of a folder, a few in each batch."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def start_upserts(changes: DataFrame, table_path: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Fold change batches (key, version, crc, status, ...) into versions of a table.

    A batch reads the last version and writes the next; a replayed batch writes the same one again, so
    a restart after a lost driver gives the same table.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, key, "version")
        if number:
            new = upsert(spark.read.parquet(f"{table_path}/v={number - 1}"), batch, key)
        new.write.mode("overwrite").parquet(f"{table_path}/v={number}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_fan_out(changes: DataFrame, sinks: dict[str, Callable[[DataFrame], DataFrame]], path: str, checkpoint: str) -> StreamingQuery:
    """Each batch goes to every node's folder through that node's filter; overwriting by batch makes it idempotent."""

    def apply(batch: DataFrame, number: int) -> None:
        for name, choose in sinks.items():
            choose(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_totals(events: DataFrame) -> DataFrame:
    """Running count and sum of values by user: an update-mode aggregate."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("ts").alias("last_ts"))


def queue_state(log: DataFrame, timeout: int) -> DataFrame:
    """Work-queue tasks from a log of (task, seq, at, op, head): push, pop, ack, requeue.

    A task is waiting after a push or requeue, done after an ack, and waiting again when a pop was
    not acknowledged within the timeout: delivery is at least once. Head tasks come before others.
    """
    last = log.groupBy("task").agg(
        F.max_by(F.struct("op", "at"), "seq").alias("last"),
        F.bool_or(F.coalesce("head", F.lit(False))).alias("head"),
        F.min("seq").alias("first_seq"),
        F.sum((F.col("op") == "pop").cast("int")).alias("tries"),
    )
    now = log.agg(F.max("at").alias("now"))  # one row
    late = F.col("now") - F.col("last.at") > timeout
    state = F.when(F.col("last.op") == "ack", "done").when((F.col("last.op") == "pop") & ~late, "working").otherwise("waiting")
    return last.crossJoin(F.broadcast(now)).select("task", state.alias("state"), "head", "tries", "first_seq")


def next_tasks(state: DataFrame, n: int) -> DataFrame:
    return state.filter("state = 'waiting'").orderBy(F.desc("head"), "first_seq", "task").limit(n)
