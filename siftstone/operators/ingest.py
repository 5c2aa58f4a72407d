"""Upserts, header and field updates, record merges, term maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(changes: DataFrame, key: str, version: str) -> DataFrame:
    """The last change of each key; equal versions are told apart by all columns, so the result is fixed."""
    rest = [F.col(c).desc_nulls_last() for c in changes.columns if c not in (key, version)]
    order = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last(), *rest)
    return changes.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def upsert_actions(current: DataFrame, changes: DataFrame, key: str = "id", crc: str = "crc", version: str = "version") -> DataFrame:
    """key, action: insert, update (same crc: headers only), reindex (other crc), disable (status < 0) or
    ignore (older than the row), as upsert does them."""
    new = latest(changes, key, version).select(key, F.col(crc).alias("new_crc"), F.col("status").alias("new_status"), F.col(version).alias("new_version"))
    old = current.select(F.col(key).alias("__key"), F.col(crc).alias("old_crc"), F.col(version).alias("old_version"))
    return new.join(old, new[key] == old["__key"], "left").select(
        key,
        F.when(F.col("new_version") < F.col("old_version"), "ignore")
        .when(F.col("new_status") < 0, "disable")
        .when(F.col("__key").isNull(), "insert")
        .when(F.col("old_crc") == F.col("new_crc"), "update")
        .otherwise("reindex")
        .alias("action"),
    )


def upsert(current: DataFrame, changes: DataFrame, key: str = "id", crc: str = "crc", version: str = "version") -> DataFrame:
    """The collection after the last change of each key: an unchanged crc keeps the text columns,
    a negative status only disables, and a change older than the row is ignored (batches may come late)."""
    new = latest(changes, key, version)
    columns = current.columns
    headers = {"status", "rank", "category", "slevel", version}
    joined = current.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    same = F.col(f"o.{crc}") == F.col(f"n.{crc}")

    def pick(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == key:
            return F.coalesce(n, o)
        stale = F.coalesce(F.col(f"n.{version}") < F.col(f"o.{version}"), F.lit(False))
        missing_new, missing_old = F.col(f"n.{key}").isNull() | stale, F.col(f"o.{key}").isNull()
        disabled = F.col("n.status") < 0
        value = F.when(missing_new, o).when(missing_old, n).when(disabled, n if c in ("status", version) else o)
        return value.when(F.coalesce(same, F.lit(False)), n if c in headers else o).otherwise(n)

    return joined.select(*(pick(c).alias(c) for c in columns))


def category_updates(docs: DataFrame, updates: DataFrame) -> DataFrame:
    """docs with the category after (id, seq, op, bits) changes: set adds bits, any other op removes them.

    The last change of each bit decides about it (of equal seq the removal), so an id's changes are partial
    maxima and never meet as a list. Changes with a null id or bits, or of unknown ids, have no effect; seq is
    below 2**62; a null category stays null unless bits are changed, then it counts as 0.
    """
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("getbit", F.col("bits"), b) == 1))
    each = updates.filter("id is not null and seq is not null").select("id", (F.col("seq") * 2 + F.when(F.col("op") == "set", 0).otherwise(1)).alias("at"), bit.alias("bit"))
    last = each.groupBy("id", "bit").agg(F.max("at").alias("at"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    changed = last.groupBy("id").agg(F.bit_or(mask).alias("__bits"), F.bit_or(F.when(F.col("at") % 2 == 0, mask).otherwise(F.lit(0).cast("long"))).alias("__set"))
    old = F.coalesce(F.col("category").cast("long"), F.lit(0).cast("long"))
    value = old.bitwiseAND(F.bitwise_not(F.col("__bits"))).bitwiseOR(F.col("__set"))
    folded = F.when(F.col("__bits").isNull(), F.col("category").cast("long")).otherwise(value)
    return docs.join(changed, "id", "left").withColumn("category", folded).drop("__bits", "__set")


def field_updates(docs: DataFrame, updates: DataFrame, column: str, version: str = "version") -> DataFrame:
    """Set one numeric column from the last (id, value, version) of each id."""
    new = latest(updates, "id", version).select("id", F.col("value").alias("__value"))
    return docs.join(new, "id", "left").withColumn(column, F.coalesce("__value", column)).drop("__value")


def merge_records(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Field by field: a new non-empty value wins, else the old one stays."""
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(
        F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key),
        *(F.coalesce(F.nullif(F.col(f"n.{f}"), F.lit("")), F.col(f"o.{f}")).alias(f) for f in fields),
    )


def term_states(current: DataFrame, changes: DataFrame) -> DataFrame:
    """term, status, version after block-term maintenance: ok (0), block (1), down (2)."""
    return latest(current.unionByName(changes), "term", "version")
