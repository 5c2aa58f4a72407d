"""Sharding by histogram sort.

Rows get a 64-bit sort key: the upper 40 bits come from a hash of the text, the lower 24
from a hash of the id. Equal texts are therefore neighbours in the order, while a text that
a third of all rows share can still be cut at any of 2**24 places. Splitters between
shards are found by exact counting: every round counts the bytes below a set of candidate
keys over all partitions, keeps for every splitter the tightest pair of candidates around
its target and probes between them, until each splitter is within the tolerance. The rows
then move once, straight to their partition, and are sorted there.

Edge cases: a null text counts as empty; a null id is hashed as null; repeated rows have
equal keys and stay in one shard (rows that are alike in id and text can't be told apart by any key); other rows
of one text stand side by side in the order of keys, so they fill a run of places that is cut only where a
splitter falls among them; rows with equal keys are ordered by id, then text; an
empty table gives no rows. With fewer rows than shards some shards stay empty. Other
columns are carried along; the columns this operator adds (size, shard, slot, sort_key)
replace columns of the same name.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

LOW_BITS = 24
KEY_MIN, KEY_END = -(2**63), 2**63
ROW_OVERHEAD = 16
MOST_PROBES = 200_000  # candidate keys in a round: the driver holds one pair of sums for each


@dataclass
class Splitters:
    """keys[i] is the first key of partition i + 1; before[i] the rows in front of partition i."""

    keys: list[int]
    before: list[int]
    rounds: int
    total_bytes: int
    parts_per_shard: int
    widths: list[int] = field(default_factory=list)


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_OVERHEAD)).cast("long")


def sort_key(text: Column, row_id: Column) -> Column:
    low = (1 << LOW_BITS) - 1
    return F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(~low)).bitwiseOR(
        F.xxhash64(row_id).bitwiseAND(F.lit(low))
    )


def rank_among(bounds: list[int], key: Column) -> Column:
    """How many of the sorted bounds are <= key: a binary search inside one expression."""
    n = len(bounds)
    if not n:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(n.bit_length()))]
    array = F.lit(bounds) if n > 1 else F.array(F.lit(bounds[0]))
    return F.aggregate(
        F.lit(steps) if len(steps) > 1 else F.array(F.lit(steps[0])),
        F.lit(0),
        lambda i, s: F.when(
            (i + s <= n) & (F.element_at(array.cast("array<bigint>"), F.least(i + s, F.lit(n))) <= key), i + s
        ).otherwise(i),
    )


def counts_below(keys: DataFrame, probes: list[int]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows with a key below each probe."""
    found = keys.groupBy(rank_among(probes, F.col("sort_key")).alias("bin")).agg(
        F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")
    )
    by_bin = {r["bin"]: (r["b"], r["n"]) for r in found.collect()}  # one row per probe at most
    bytes_below, rows_below, b, n = [], [], 0, 0
    for i in range(len(probes)):
        x = by_bin.get(i, (0, 0))
        b, n = b + x[0], n + x[1]
        bytes_below.append(b)
        rows_below.append(n)
    return bytes_below, rows_below


def find_splitters(
    keys: DataFrame,
    parts: int,
    parts_per_shard: int,
    total: int,
    rows: int,
    tolerance: float = 0.002,
    probes_each: int = 12,
) -> Splitters:
    """Refine candidate keys until each boundary is within tolerance of one partition's bytes.

    A boundary with a single row left between its two candidates can't get any closer and is done too.
    """
    probes_each = max(2, min(probes_each, MOST_PROBES // parts))
    goals = [total * i // parts for i in range(1, parts)]
    slack = max(1, int(total / parts * tolerance))
    low = [(KEY_MIN, 0, 0)] * len(goals)
    high = [(KEY_END, total, rows)] * len(goals)
    chosen: list[tuple[int, int] | None] = [None] * len(goals)
    rounds = 0
    while any(c is None for c in chosen):
        probes: set[int] = set()
        for i, goal in enumerate(goals):
            if chosen[i] is None:
                (a, below_a, _), (b, below_b, _) = low[i], high[i]
                width = b - a
                guess = a + (goal - below_a) * width // max(1, below_b - below_a)
                near = max(1, width // (4 * probes_each))
                candidates = [a + width * j // (probes_each + 1) for j in range(1, probes_each + 1)]
                candidates += [guess - near, guess, guess + near]
                probes.update(p for p in candidates if a < p < b)
        if probes:
            ordered = sorted(probes)
            rounds += 1
            bytes_below, rows_below = counts_below(keys, ordered)
            for i, goal in enumerate(goals):
                if chosen[i] is None:  # counts rise with the key: the goal lies between two neighbours
                    j = bisect_right(bytes_below, goal)
                    if j and ordered[j - 1] > low[i][0]:
                        low[i] = (ordered[j - 1], bytes_below[j - 1], rows_below[j - 1])
                    if j < len(ordered) and ordered[j] < high[i][0]:
                        high[i] = (ordered[j], bytes_below[j], rows_below[j])
        for i, goal in enumerate(goals):
            if chosen[i] is None:
                options = [x for x in (low[i], high[i]) if KEY_MIN < x[0] < KEY_END]
                best = min(options, key=lambda x: abs(x[1] - goal), default=None)
                if best and abs(best[1] - goal) <= slack:
                    chosen[i] = (best[0], best[2])
                elif high[i][0] - low[i][0] <= 1 or high[i][2] - low[i][2] <= 1 and best:
                    chosen[i] = (best[0], best[2]) if best else (KEY_MIN, 0)
    return Splitters([c[0] for c in chosen], [0, *(c[1] for c in chosen)], rounds, total, parts_per_shard)


def shard(
    docs: DataFrame,
    shards: int = 40,
    tolerance: float = 0.002,
    part_bytes: int = 512 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All columns of docs with size, sort_key, shard and slot, one exchange, sorted within shards.

    A shard is a run of parts_per_shard partitions, so that no task has to hold more than
    about part_bytes, however large the table; slots run through those partitions because the
    counting also gives the exact number of rows in front of each splitter.
    """
    keyed = docs.withColumns(
        {"size": size_of(F.col(text_col)), "sort_key": sort_key(F.col(text_col), F.col(id_col))}
    )
    keys = materialise(keyed.select("sort_key", "size"), "shard-keys")
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    each = max(1, -(-total // (shards * part_bytes)))
    found = find_splitters(keys, shards * each, each, total, rows, tolerance)
    shard_base = [found.before[i - i % each] for i in range(shards * each)]
    offset = [b - s for b, s in zip(found.before, shard_base, strict=True)]
    part = "part"
    while part.lower() in {c.lower() for c in keyed.columns}:
        part = f"_{part}"
    moved = (
        keyed.withColumn(part, rank_among(found.keys, F.col("sort_key")))
        .repartitionById(shards * each, F.col(part))
        .sortWithinPartitions("sort_key", id_col, text_col)
    )
    here = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return moved.withColumns(
        {
            "shard": F.expr(f"cast(`{part}` div {each} as int)"),
            "slot": here + F.element_at(F.lit(offset).cast("array<bigint>"), F.col(part) + 1)
            if len(offset) > 1
            else here,
        }
    ).drop(part)
