"""Scores as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.query import SearchQuery
from ..schema import FIXED_POINT, LENGTH_WEIGHT, TF_GAIN, TF_SHIFT


def idf_of(n_docs: Column, df: Column) -> Column:
    """ln((N - n + 0.5) / (n + 0.5))."""
    return F.ln((n_docs - df + 0.5) / (df + 0.5))


def idf(n_docs: Column, df: Column) -> Column:
    """idf_of; 1 where that is negative."""
    value = idf_of(n_docs, df)
    return F.when(value < 0, F.lit(1.0)).otherwise(value)


def relevance(kind: str, weight: Column, tf: Column, terms_total: Column, n_docs: Column, n_terms: Column) -> Column:
    """One term's part. "reference" divides by the inverse of the mean length; "bm25" by the mean length."""
    ratio = F.when(n_terms == 0, F.lit(1.0)).otherwise(n_docs / n_terms)
    if kind == "reference":
        f, norm = tf / terms_total, terms_total / ratio
    else:
        f, norm = tf.cast("double"), terms_total * ratio
    return weight * f * TF_GAIN / (f + TF_SHIFT + LENGTH_WEIGHT * norm)


def category_boost(q: SearchQuery, base: Column) -> tuple[Column, Column]:
    """Boosted score and whether the document is demoted (its static rank is then ignored)."""
    hit = lambda m: F.col("category").cast("long").bitwiseAND(F.lit(m)) != 0 if m else F.lit(False)
    demoted = ~hit(q.up) & hit(q.down)
    score = (
        F.when(hit(q.up), base + q.base_category_up)
        .when(demoted, F.greatest(base - q.base_category_down, F.lit(0.0)))
        .otherwise(base)
    )
    return score, demoted


def fixed_point(score: Column) -> Column:
    """Score times 10**8, cut off towards zero; rounded first, as sums of doubles have no fixed last digit."""
    return F.round(score * FIXED_POINT, 2).cast("long")


def with_rank(q: SearchQuery, fixed: Column, demoted: Column) -> Column:
    if not q.rank:
        return fixed
    return fixed + F.when(demoted, F.lit(0)).otherwise((F.col("rank") * q.base_rank).cast("long"))
