"""Passages, highlighting and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import highlight, json_text, words
from ..schema import SUMMARY_ADJACENT, SUMMARY_CHARS, SUMMARY_SCALE


def passages(docs: DataFrame, weights: list[tuple[str, float]], column: str = "text") -> DataFrame:
    """id, line, at, hits, score: lines that hold a query term.

    A line's score is the sum of tf x weight of its terms, ten for each pair of neighbouring hits and one for
    each distinct term, in millionths as a long: 215 pairs exceed an int. All of it is computed inside a row.
    """
    names = [t for t, _ in weights]
    weight = F.create_map(*(F.lit(x) for kv in weights for x in kv))
    lines = docs.select("id", F.posexplode(F.split(F.col(column), "\n")).alias("at", "line")).withColumn("w", words(F.col("line")))
    own = F.filter("w", lambda x: x.isin(*names))
    pairs = F.size(
        F.filter(
            F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))),
            lambda i: (i < F.size("w")) & F.get("w", i - 1).isin(*names) & F.coalesce(F.get("w", i), F.lit("")).isin(*names),
        )
    )
    scored = lines.withColumn("own", own).filter(F.size("own") > 0)
    total = F.aggregate("own", F.lit(0.0), lambda a, t: a + F.element_at(weight, t))
    return scored.select(
        "id",
        "at",
        "line",
        F.size("own").alias("hits"),
        (F.round(total * SUMMARY_SCALE, 2).cast("long") + (pairs * SUMMARY_ADJACENT + F.size(F.array_distinct("own"))).cast("long") * SUMMARY_SCALE).alias("score"),
    )


def best_passages(found: DataFrame, budget: int = SUMMARY_CHARS) -> DataFrame:
    """id, summary: best lines first until the budget of characters is used up; the first line always."""
    best = Window.partitionBy("id").orderBy(F.desc("score"), "at")
    before = F.coalesce(F.sum(F.length("line")).over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = found.withColumns({"before": before, "n": F.row_number().over(best)}).filter(F.col("before") < budget)
    return kept.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]), " ... ").alias("summary"))


def fallback(text: Column, budget: int = SUMMARY_CHARS) -> Column:
    """Text up to the first line end after the budget."""
    return F.concat(F.substring(text, 1, budget), F.substring_index(F.substring(text, budget + 1, 1 << 30), "\n", 1))


def respond(page: DataFrame, columns: list[tuple[str, bool]], terms: list[str]) -> DataFrame:
    """id, json: a quoted object per row; marked columns are highlighted."""
    fields = []
    for c, marked in columns:
        value = json_text(F.col(c).cast("string"))
        fields.append((highlight(value, terms) if marked else value).alias(c))
    return page.select("id", F.to_json(F.struct(F.col("id").cast("string").alias("id"), *fields)).alias("json"))
