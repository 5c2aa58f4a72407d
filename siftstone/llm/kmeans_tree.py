"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample of the vectors (``sample_rows``); every vector is then
dropped down to its leaf. A query walks the tree best bin first: a priority queue holds the nodes met so far, the
one with the largest key (inner product with the centre plus the spread in one direction times the query's length) is
opened next and only then are its children's keys computed; leaves come out in that order. How many leaves a query
visits is calibrated on rows that the tree was not fitted on: their exact neighbours over all vectors are
found in blocks, and the number of visits is widened until the wanted recall is reached on them.

Leaves that follow one another in the tree form groups of a bounded number of rows. A query goes to the groups in
which it visits leaves, blocks of queries meet a group, only the visited leaves are scored (in double
precision), and of all leaves of a group the best k + 1 of a query leave together.
Of equal vectors only the k + 1 with the smallest ids are indexed (no result can need more, as ties go to
smaller ids), and equal query vectors are searched once, so a vector that a third of all rows
share costs no more than another.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, rows with a
null id and vectors of another length than the most frequent one take no part; repeated rows (equal
id and vector) count once, rows of one id with different vectors are rows of their own; with fewer
candidates than k all are returned; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, materialise

GROUP_ROWS = QUERY_ROWS = 16_384


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 1))


class Tree:
    """Nodes in arrays; node 0 is the root. leaf[i] is the leaf number of node i or -1."""

    def __init__(self, branches: int = 16, leaf_rows: int = 32, seed: int = 11):
        self.branches, self.leaf_rows, self.rng = branches, leaf_rows, np.random.default_rng(seed)
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        centres: list[np.ndarray] = []
        self.spreads: list[float] = []
        self._centres, self.leaves = centres, 0

    def fit(self, x: np.ndarray) -> Tree:
        self._add(x)
        self.centres = np.array(self._centres)
        self.spread = np.array(self.spreads)
        self.wide = self.spread / np.sqrt(x.shape[1])
        leaf = np.array(self.leaf)
        # Children of each node: centres and spreads, the leaf numbers of those that are leaves, the nodes of the others.
        self.kids = []
        for own in self.children:
            c = np.array(own, np.int64)
            ends = leaf[c] >= 0
            c = np.concatenate([c[ends], c[~ends]])
            self.kids.append((self.centres[c], self.wide[c], leaf[c[: ends.sum()]], c[ends.sum() :].tolist()))
        del self._centres, self.spreads, self.rng
        return self

    def _add(self, x: np.ndarray) -> int:
        node = len(self.children)
        centre = x.mean(0)
        self._centres.append(centre)
        self.spreads.append(float(np.sqrt(((x - centre) ** 2).sum(1).mean())))
        self.children.append([])
        self.leaf.append(-1)
        parts = self._split(x) if len(x) > self.leaf_rows else []
        if len(parts) < 2:
            self.leaf[node] = self.leaves
            self.leaves += 1
        else:
            self.children[node] = [self._add(p) for p in parts]
        return node

    def _split(self, x: np.ndarray) -> list[np.ndarray]:
        k = min(self.branches, max(2, len(x) // self.leaf_rows))
        centres = x[self.rng.choice(len(x), k, replace=False)]
        for _ in range(12):
            near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
            new = np.array([x[near == j].mean(0) if (near == j).any() else centres[j] for j in range(k)])
            if np.allclose(new, centres):
                break
            centres = new
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        return [x[near == j] for j in range(k) if (near == j).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest child at every level."""
        out = np.full(len(x), -1, np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[self.children[node]]
            near = np.argmin((c**2).sum(1) - 2 * x[rows] @ c.T, axis=1)
            for j, child in enumerate(self.children[node]):
                if len(own := rows[near == j]):
                    todo.append((child, own))
        return out

    def visits(self, q: np.ndarray, most: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first leaves of a best-bin-first walk, and those after them until leaves of these sizes give the least number of rows."""
        if self.leaf[0] >= 0:
            return [0]
        length = float(np.linalg.norm(q))
        heap: list[tuple[float, int]] = [(-np.inf, 0)]
        keys, leaves, held, opened = [np.zeros(0)], [np.zeros(0, np.int64)], 0, 0
        while heap:
            top, node = heap[0]
            opened += 1
            if held >= most and opened % 16 == 0:
                # Leaves whose key no unopened node exceeds are visited before all that is still to come.
                key, leaf = np.concatenate(keys), np.concatenate(leaves)
                keys, leaves = [key], [leaf]
                settled = leaf[key >= -top]
                if len(settled) >= most and (sizes is None or sizes[settled].sum() >= least):
                    break
            heapq.heappop(heap)
            centres, wide, ends, inner = self.kids[node]
            key = centres @ q + length * wide
            keys.append(key[: len(ends)])
            leaves.append(ends)
            held += len(ends)
            for k, child in zip((-key[len(ends) :]).tolist(), inner, strict=True):
                heapq.heappush(heap, (k, child))
        key, leaf = np.concatenate(keys), np.concatenate(leaves)
        leaf = leaf[np.lexsort((leaf, -key))]
        if sizes is not None and most < len(leaf):
            most = max(most, int(np.searchsorted(np.cumsum(sizes[leaf]), least)) + 1)
        return leaf[:most].tolist()


def best(ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int, rough: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the places and exact scores of its k best rows, ties to smaller ids; rows with a rough score of
    minus infinity are left out."""
    rough = q @ x.T if rough is None else rough
    cuts = np.partition(rough, rough.shape[1] - k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(q), -np.inf)
    for j, cut in enumerate(cuts.tolist()):
        s = rough[j]
        rows = np.flatnonzero((s >= cut - 1e-9 * max(1.0, abs(cut))) if cut > -np.inf else s > -np.inf)
        # Products are summed row by row: equal vectors get equal scores wherever they stand.
        exact = (x[rows] * q[j]).sum(axis=1)
        order = np.lexsort((ids[rows], -exact))[:k]
        yield rows[order], exact[order]


class Index:
    """Every usable vector in its leaf, and a calibrated number of leaf visits.

    sizes: rows of each leaf; recall: of the calibration queries at so many visits.
    """

    def __init__(self, tree: Tree, rows: DataFrame, sizes: dict[int, int], visits: int, recall: float):
        self.tree, self.rows, self.sizes, self.visits, self.recall = tree, rows, sizes, visits, recall


def build(
    vectors: DataFrame,
    k: int = 20,
    recall: float = 0.94,
    sample_rows: int = 20_000,
    leaf_size: int = 16,
    calibration: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> Index | None:
    """Fit the tree, index all vectors, calibrate. None if there is no usable vector.

    The calibration queries are rows of the table (a vector that many rows hold counts as often); they are kept out
    of the fit if there are at least 8 times as many vectors; of fewer vectors an eighth, and of fewer than 64 none.
    """
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter(
        F.col("vec_id").isNotNull() & usable(F.col("v"))
    )
    common = plain.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return None
    plain = plain.filter(F.size("v") == common["d"])
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    kept = materialise(
        plain.withColumn("place", place).filter(F.col("place") <= k + 1).drop("place").dropDuplicates(["v", "vec_id"]), "vectors"
    )
    total = kept.count()
    asked = min(calibration, total // 8) if total >= 64 else 0
    by_hash = [F.xxhash64("vec_id", "v"), F.col("vec_id")]
    sample = kept.orderBy(*by_hash).limit(sample_rows + asked).toArrow()
    tests = plain.orderBy(*by_hash).limit(asked or calibration).toArrow()
    ids, q, x = tests.column("vec_id").to_numpy(), matrix(tests.column("v")), matrix(sample.column("v"))
    fresh = ~np.isin(sample.column("vec_id").to_numpy(), ids)
    if asked and fresh.any():
        x = x[fresh]
    tree = Tree(leaf_rows=max(8, leaf_size * len(x) // total)).fit(x)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.assign(matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], ["leaf", "vec_id", "v"])

    rows = materialise(kept.mapInArrow(assign, f"leaf long, vec_id long, v {kept.schema['v'].dataType.simpleString()}"), "leaves")
    sizes = {r["leaf"]: r["count"] for r in rows.groupBy("leaf").count().collect()}  # one row per leaf of the tree

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1).to_numpy()
            if not len(own):
                continue
            leaf = batch.column(0).to_numpy()
            for n, (at, score) in enumerate(best(own, matrix(batch.column(2)), q, k + 1)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), n)), pa.array(own[at]), pa.array(score), pa.array(leaf[at])], ["q", "vec_id", "score", "leaf"]
                )

    top = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    named = F.element_at(F.lit(ids.tolist()) if len(ids) > 1 else F.array(F.lit(int(ids[0]))), F.col("q").cast("int") + 1)
    truth = (
        rows.mapInArrow(exact, "q long, vec_id long, score double, leaf long")
        .filter(named != F.col("vec_id"))
        .withColumn("rank", F.row_number().over(top))
        .filter(F.col("rank") <= k)
        .select("q", "leaf")
        .collect()  # k rows for each of the calibration queries
    )
    order = []
    for v in q:
        place_of = np.empty(tree.leaves, np.int64)
        place_of[tree.visits(v, tree.leaves)] = np.arange(tree.leaves)
        order.append(place_of)
    needed = np.sort(np.array([order[r["q"]][r["leaf"]] for r in truth], np.int64))
    # The smallest number of visits that meets the wanted share of true neighbours.
    visits = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1 if len(needed) else 1
    return Index(tree, rows, sizes, visits, float((needed < visits).mean()) if len(needed) else 1.0)


def units(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First unit and number of units of each leaf: neighbouring leaves share a unit of up to ``most`` rows, larger leaves have several."""
    first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    unit, held = 0, 0
    for leaf, n in enumerate(sizes.tolist()):
        if n > most:
            unit, held = unit + (held > 0), 0
            first[leaf], parts[leaf] = unit, -(-n // most)
            unit += int(parts[leaf])
            continue
        if held + n > most:
            unit, held = unit + 1, 0
        first[leaf] = unit
        held += n
    return first, parts


def search(index: Index, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: up to k nearest of each usable query but itself."""
    tree, visits, dim = index.tree, index.visits, index.tree.centres.shape[1]
    sizes = np.array([index.sizes.get(leaf, 0) for leaf in range(tree.leaves)], np.int64)
    own = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("v")).filter(
        F.col("query_id").isNotNull() & usable(F.col("v")) & (F.size("v") == dim)
    ).dropDuplicates()
    own = materialise(own, "queries")
    spark = own.sparkSession
    # A number for each distinct vector, fixed by being stored.
    distinct = materialise(own.groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("qid", F.monotonically_increasing_id()), "asked")
    kind = own.schema["v"].dataType.simpleString()
    blocks = max(1, -(-distinct.count() // QUERY_ROWS))
    most = min(GROUP_ROWS, max(1024, int(sizes.sum()) // (4 * spark.sparkContext.defaultParallelism)))
    first, parts = units(sizes, most)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query in each unit it visits, with the leaves it visits there."""
        for batch in batches:
            at: list[int] = []
            unit: list[int] = []
            seen: list[np.ndarray] = []
            for n, v in enumerate(matrix(batch.column(0)) if batch.num_rows else ()):
                # k + 1, as the query's own row is one of them.
                leaves = np.sort(np.array(tree.visits(v, visits, sizes, k + 1), np.int64))
                leaves = leaves[sizes[leaves] > 0]
                cuts = np.flatnonzero(np.diff(first[leaves])) + 1
                for some in np.split(leaves, cuts) if len(leaves) else ():
                    for part in range(int(parts[some[0]])):
                        at.append(n)
                        unit.append(int(first[some[0]]) + part)
                        seen.append(some)
            some = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(1), some.column(0), pa.array(unit, pa.int64()), pa.array(seen, pa.list_(pa.int64()))], ["qid", "v", "unit", "leaves"])

    # The work is in the walks and scores, not in the bytes: all tasks there are, however small the tables.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    walked = distinct.select("v", "qid").repartition(tasks, "qid").mapInArrow(walk, f"qid long, v {kind}, unit long, leaves array<bigint>")
    asking = materialise(walked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")), "walks")
    places = F.broadcast(  # one row per leaf of the tree, which the sample bounds
        spark.createDataFrame(list(zip(range(len(sizes)), first.tolist(), parts.tolist(), strict=True)), "leaf long, first long, parts long")
    )
    stored = (
        index.rows.join(places, "leaf")
        .withColumn("unit", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .select("unit", "block", "leaf", "vec_id", "v")
    )
    found_type = "qid long, vec_id long, score double, same boolean"

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k + 1 best rows of the leaves that each query visits in a unit."""
        names = ["qid", "vec_id", "score", "same"]
        empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.bool_())], names)
        if not left.num_rows or not right.num_rows:
            return empty
        left = left.sort_by("leaf")
        ids, x, leaf = left.column("vec_id").to_numpy(), matrix(left.column("v")), left.column("leaf").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
        ends = np.append(starts[1:], len(leaf))
        out: list[list[np.ndarray]] = [[] for _ in names]
        for a in range(0, right.num_rows, 512):  # bounds the scores held at once
            some = right.slice(a, 512)
            qids, q, lists = some.column("qid").to_numpy(), matrix(some.column("v")), some.column("leaves").combine_chunks()
            asks, wanted = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
            by_leaf = np.argsort(wanted, kind="stable")
            wanted, asks = wanted[by_leaf], asks[by_leaf]
            rough = np.full((len(q), len(x)), -np.inf)
            for c, d in zip(starts.tolist(), ends.tolist(), strict=True):
                low, high = np.searchsorted(wanted, [leaf[c], leaf[c] + 1])
                rough[asks[low:high], c:d] = q[asks[low:high]] @ x[c:d].T
            for j, (at, exact) in enumerate(best(ids, x, q, k + 1, rough)):
                same = np.zeros(len(at), bool)
                same[:] = (x[at] == q[j]).all(axis=1)
                for o, v in zip(out, (np.full(len(at), qids[j]), ids[at], exact, same), strict=True):
                    o.append(v)
        return pa.table([pa.array(np.concatenate(o)) for o in out], names)

    stored, asking = (t.repartition(tasks, "unit", "block") for t in (stored, asking))
    near = stored.groupBy("unit", "block").cogroup(asking.groupBy("unit", "block")).applyInArrow(score, found_type)
    top = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    lists = (
        near.withColumn("place", F.row_number().over(top))
        .filter(F.col("place") <= k + 1)
        .groupBy("qid")
        .agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score", "same"))).alias("found"))
    )
    answered = distinct.join(lists, "qid").select("v", "n", "found")
    other = lambda r: ~(r["same"] & (r["vec_id"] == F.col("query_id")))
    return (
        hot_join(own, answered, "v", "n")
        .select("query_id", F.slice(F.filter("found", other), 1, k).alias("found"))
        .select("query_id", F.posexplode("found").alias("at", "r"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "r.vec_id", "r.score")
    )
