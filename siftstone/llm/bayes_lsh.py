"""N-gram Jaccard join with Bayesian candidate pruning.

A document is the set of its five-word shingles (64-bit hashes; a shorter text is one
shingle of all its words). Documents with equal sets form one node; nodes get 96 MinHash values.
Candidates share one of 24 bands of four values (a pair with similarity 0.8 is missed
with probability (1 - 0.8**4)**24 < 4e-6). Candidates of a bucket are compared incrementally,
16 values at a time: with m of n values equal and a uniform prior, the posterior
probability that the similarity reaches the threshold t is P(Bin(n + 1, t) <= m); pairs where it falls below
the tolerance are dropped. The rest is verified exactly on the shingle sets.

A pair is taken in its first common band only. Buckets are counted first, from their numbers alone; only keys in
buckets with company move on, and their signatures join them last. Large buckets are dealt in chunks where their
rows lie: every pair of chunks is a task of its own, of bounded rows and bytes, so no bucket has to fit into
one task. Shingle sets are made from the texts again, in the scan, for the nodes that have candidates: a fixed
bit map of their ids tells which rows may be theirs, so texts are never shuffled. Tables are deleted once used.
Pairs never become rows: a candidate row is a node with the places of its partners in the chunk pair, and
verification returns, per node, the number of links and a neighbour towards its component.

Edge cases: documents without words have no shingles and no links and are classes of their own; rows with a null
id can't be named and get a null class and no links; rows with equal ids are told apart by their
sets; copies count as links of each other; an empty table gives no rows; other columns do
not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, as_bytes, hot_join, tidy, words_of
from .components import connected_components

BANDS, ROWS, STEP = 24, 4, 16
HASHES = BANDS * ROWS
CHUNK_NODES, CHUNK_SHINGLES = 2048, 2_000_000
_rng = np.random.default_rng(20240229)
FACTORS = (_rng.integers(1, 2**63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
SHIFTS = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text."""

    def __init__(self, size: int = 5, cache: int = 300_000):
        self.size, self.cache = size, cache
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(known) > self.cache:
            known.clear()
        n = max(1, len(h) - self.size + 1)
        x = np.zeros(n, np.uint64)
        for k in range(min(self.size, len(h))):
            x = (x ^ h[k : k + n]) * MIX
            x ^= x >> np.uint64(29)
        return np.unique(x)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """96 MinHash values, cut to 16 bits."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        x = shingles[i : i + 4096, None] * FACTORS + SHIFTS
        least = np.minimum(least, x.min(axis=0))
    return ((least ^ (least >> np.uint64(31))) & np.uint64(0xFFFF)).astype("<u2")


def buckets(signature: Column) -> Column:
    """A 64-bit bucket for each band of a stored signature."""
    size = 2 * ROWS
    return F.array(*(F.xxhash64(F.substring(signature, 1 + size * i, size), F.lit(i)) for i in range(BANDS)))


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For 16, 32, ... compared values the fewest matches that keep a pair."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def text_hash(text_col: str) -> Column:
    """Tells texts under one id apart; null is as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h")


def signatures(docs: DataFrame, shingle: int, id_col: str, text_col: str, hashed: bool = False) -> DataFrame:
    """id, key (digest of the shingle set), n (shingles), signature and with hashed h (hash of the text) of each document with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(shingle)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys, sizes, sigs = [], [], []
                texts = as_bytes(part.column(1))
                # As text_hash.
                hashes = np.fromiter((xxhash.xxh64_intdigest(t, seed=42) for t in texts), np.uint64, len(texts)) if hashed else None
                for t in texts:
                    s = shingles(t)
                    keys.append(hashlib.md5(s.tobytes()).digest())
                    sizes.append(len(s))
                    sig = minhash(s) if len(s) else None
                    sigs.append(None if sig is None else sig.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(keys, pa.binary()),
                        pa.array(sizes, pa.int64()),
                        pa.array(sigs, pa.binary()),
                        *([pa.array(hashes.view(np.int64))] if hashed else []),
                    ],
                    ["id", "key", "n", "signature", *(["h"] if hashed else [])],
                )

    return (
        docs.filter(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(tidy(run), "id long, key binary, n long, signature binary" + (", h long" if hashed else ""))
    )


def whole_groups(batches: Iterator[pa.RecordBatch], most_rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by their first column."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most_rows:
            continue
        table = pa.Table.from_batches(held)
        group = table.column(0).to_numpy()
        start = int(np.searchsorted(group, group[-1]))  # the last group may go on
        if start:
            yield table.slice(0, start)
        held, rows = table.slice(start).combine_chunks().to_batches(), len(group) - start
    if rows:
        yield pa.Table.from_batches(held)


def pairs_by_group(sizes: np.ndarray, starts: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All places i < j within each group, in bounded arrays."""
    for s in np.unique(sizes).tolist():
        if s < 2:
            continue
        own = starts[sizes == s]
        if s <= 64:
            i, j = np.triu_indices(s, 1)
            for k in range(0, len(own), max(1, most // len(i))):
                base = own[k : k + max(1, most // len(i)), None]
                yield (base + i).ravel(), (base + j).ravel()
        else:
            rows = max(1, most // s)
            for base in own.tolist():
                for a in range(0, s - 1, rows):
                    i = np.repeat(np.arange(a, min(a + rows, s - 1)), s)
                    j = np.tile(np.arange(s), len(i) // s)
                    below = i < j
                    yield base + i[below], base + j[below]


def candidates(nodes: DataFrame, threshold: float, tolerance: float, ws: Workspace) -> DataFrame:
    """gid, at, key, copies, partners: nodes with surviving partners (their at) in a chunk pair."""
    crowded = ws.table(
        nodes.select(F.explode(buckets(F.col("signature"))).alias("bucket"), "n")
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"))
        .filter("m > 1")
        .select(
            "bucket",
            "m",
            F.greatest(F.ceil(F.col("m") / CHUNK_NODES), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int").alias("chunks"),
        ),
        "crowded",
    )
    cells = nodes.select("key", F.posexplode(buckets(F.col("signature"))).alias("band", "bucket"))
    placed = ws.table(hot_join(cells, crowded, "bucket", "m").select("key", "band", "bucket", "chunks"), "cells")
    dealt = (
        placed.join(nodes.select("key", "copies", "signature"), "key")
        .withColumn("chunk", F.pmod(F.xxhash64("key", "band"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            F.xxhash64("bucket", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("gid"),
            "band", "chunk", (F.col("chunk") == F.col("other")).alias("own"), "key", "copies", "signature",
        )
    )
    fewest = least_matches(threshold, tolerance)

    def compare(sig: np.ndarray, band: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that survive, in the group of their first common band."""
        matches = np.zeros(len(i), np.int64)
        for step, least in enumerate(fewest):
            same = sig[i, step * STEP : (step + 1) * STEP] == sig[j, step * STEP : (step + 1) * STEP]
            matches += same.sum(axis=1)
            whole = same.reshape(len(i), -1, ROWS).all(axis=2)
            first = step * (STEP // ROWS)
            earlier = whole & (first + np.arange(STEP // ROWS) < band[i][:, None])
            keep = (matches >= least) & ~earlier.any(axis=1)
            i, j, matches = i[keep], j[keep], matches[keep]
            if not len(i):
                break
        return i, j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            gid = table.column("gid").to_numpy()
            band = table.column("band").to_numpy()
            chunk = table.column("chunk").to_numpy()
            own = table.column("own").to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u2").reshape(-1, HASHES)
            starts = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(gid)]]))
            left, right = [], []
            for i, j in pairs_by_group(sizes, starts):
                cross = own[i] | (chunk[i] != chunk[j])
                i, j = compare(sig, band, i[cross], j[cross])
                left.append(i)
                right.append(j)
            if not left:
                continue
            i, j = np.concatenate(left), np.concatenate(right)
            if not len(i):
                continue
            order = np.lexsort((j, i))
            i, j = i[order], j[order]
            rows = np.unique(np.concatenate([i, j]))
            place = np.arange(len(gid)) - np.repeat(starts, sizes)
            offsets = np.searchsorted(i, np.concatenate([rows, [len(gid)]]))
            some = table.take(pa.array(rows))
            out = pa.table(
                [
                    some.column("gid"),
                    pa.array(place[rows].astype(np.int32)),
                    some.column("key"),
                    some.column("copies"),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(place[j].astype(np.int32))),
                ],
                ["gid", "at", "key", "copies", "partners"],
            )
            yield from out.combine_chunks().to_batches(max_chunksize=4096)

    return (
        dealt.repartition("gid")
        .sortWithinPartitions("gid")
        .mapInArrow(tidy(run), "gid long, at int, key binary, copies long, partners array<int>")
    )


def shared_counts(sets: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of all intersections of some sets; values that only one set has are left out first."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count[back] > 1
    owner, back = owner[common], back[common]
    _, back = np.unique(back, return_inverse=True)
    total = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(back, kind="stable")
    owner, back = owner[order], back[order]
    for a in range(0, int(back[-1]) + 1 if len(back) else 0, columns):
        low, high = np.searchsorted(back, [a, a + columns])
        dense = np.zeros((len(sets), min(columns, int(back[-1]) + 1 - a)), np.float32)
        dense[owner[low:high], back[low:high] - a] = 1
        total += dense @ dense.T
    return total


def reaches(both: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    return both >= threshold * (a + b - both) - 1e-9


def verify(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """key, links, root: exact links of each node in each chunk pair, and a node of its local component."""

    def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The smallest place of each place's component."""
        label = np.arange(n)
        while True:
            new = label.copy()
            np.minimum.at(new, i, label[j])
            np.minimum.at(new, j, label[i])
            new = new[new]
            if (new == label).all():
                return label
            label = new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 2000):
            gid = table.column("gid").to_numpy()
            keys = table.column("key").to_pylist()
            copies = table.column("copies").to_numpy()
            at = table.column("at").to_numpy()
            partners = table.column("partners").combine_chunks()
            sets = [np.frombuffer(s, "<u8") for s in table.column("shingles").to_pylist()]
            size = np.array([len(s) for s in sets], np.int64)
            starts = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]]))
            out_key, out_links, out_root = [], [], []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(gid)], strict=True):
                spot = {p: k for k, p in enumerate(at[a:b].tolist())}
                pairs = [(k, spot[q]) for k, row in enumerate(partners[a:b].to_pylist()) for q in row]
                i, j = np.array(pairs, np.int64).reshape(-1, 2).T
                if len(pairs) <= 16:
                    both = np.array([len(np.intersect1d(sets[a + x], sets[a + y], True)) for x, y in pairs])
                else:
                    both = shared_counts(sets[a:b])[i, j]
                good = reaches(both.astype(np.float64), size[a + i], size[a + j], threshold)
                i, j = i[good], j[good]
                if not len(i):
                    continue
                links = np.bincount(i, copies[a + j], b - a) + np.bincount(j, copies[a + i], b - a)
                root = roots(b - a, i, j)
                for k in np.flatnonzero(links).tolist():
                    out_key.append(keys[a + k])
                    out_links.append(int(links[k]))
                    out_root.append(keys[a + int(root[k])])
            if out_key:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_key, pa.binary()), pa.array(out_links, pa.int64()), pa.array(out_root, pa.binary())],
                    ["key", "links", "root"],
                )

    return (
        rows.join(sets, "key")
        .select("gid", "at", "key", "copies", "partners", "shingles")
        .repartition("gid")
        .sortWithinPartitions("gid")
        .mapInArrow(tidy(run), "key binary, links long, root binary")
    )


MAP_BITS = 24  # of the bit map of wanted ids: 2 MB, however many there are


def id_map(ids: DataFrame) -> np.ndarray:
    """A bit for the hash of every id (column rep): 64-bit words, or-ed over all tasks; 2**18 rows at most reach the driver."""
    spot = F.pmod(F.xxhash64("rep"), F.lit(1 << MAP_BITS))
    words = ids.groupBy(F.shiftright(spot, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int"))).alias("b"))
    found = words.toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return out


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """key, shingles of the wanted nodes (key, rep), from the texts of their representatives.

    Other nodes whose id falls on a bit of a wanted one come along; joining by key drops them.
    """
    bits = docs.sparkSession.sparkContext.broadcast(id_map(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(shingle)
        for batch in batches:
            spot = batch.column(1).to_numpy()
            batch = batch.filter(pa.array((bits.value[spot >> 6] >> (spot & 63)) & 1 == 1))
            for at in range(0, batch.num_rows, 512):
                sets = [shingles(t).tobytes() for t in as_bytes(batch.slice(at, 512).column(0))]
                keys = [hashlib.md5(x).digest() for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "shingles"])

    spot = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1 << MAP_BITS))
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(text_col).alias("text"), spot.alias("spot"))
    made = texts.mapInArrow(tidy(run), "key binary, shingles binary")
    return made.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def similar_documents(
    docs: DataFrame,
    threshold: float = 0.8,
    shingle: int = 5,
    tolerance: float = 1e-6,
    id_col: str = "doc_id",
    text_col: str = "text",
    hashed: bool = False,
) -> DataFrame:
    """doc_id, class_id (smallest id of its connected class), n_links (other documents within the threshold).

    With hashed also h (text_hash) and class_key, which tells classes with equal smallest ids apart.
    """
    ws = Workspace(docs.sparkSession, "jaccard")
    signed = ws.table(signatures(docs, shingle, id_col, text_col, hashed), "signatures")
    nodes = ws.table(
        signed.groupBy("key").agg(
            F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("signature").alias("signature")
        ),
        "nodes",
    )
    rows = ws.table(candidates(nodes.filter("n > 0"), threshold, tolerance, ws), "candidates")
    known = ws.table(nodes.select("key", "rep", "copies", "n"), "known")
    named = ws.table(signed.drop("n", "signature"), "named")
    ws.drop_others(rows, known, named)
    wanted = known.select("key", "rep").join(rows.select("key").distinct(), "key", "left_semi")
    sets = shingle_sets(docs, ws.table(wanted, "wanted"), shingle, id_col, text_col)
    linked = ws.table(verify(rows, sets, threshold), "links")
    ws.drop_others(linked, known, named)
    labels = connected_components(linked.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = linked.groupBy("key").agg(F.sum("links").alias("links"))
    best = known.join(labels, known["key"] == labels["node"]).groupBy("label").agg(F.min("rep").alias("class_id"))
    result = ws.table(
        known.join(labels.select(F.col("node").alias("key"), "label"), "key", "left")
        .join(best, "label", "left")
        .join(links, "key", "left")
        .select(
            "key",
            F.coalesce("class_id", "rep").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            (F.col("n") == 0).alias("bare"),
            F.coalesce("label", "key").alias("class_key"),
            "copies",
        ),
        "result",
    )
    ws.drop_others(named, result)
    more = ["h", "class_key"] if hashed else []
    found = hot_join(named, result, "key", "copies")
    bare = F.col("bare")
    all_named = found.select(
        F.col("id").alias("doc_id"),
        F.when(bare, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(bare, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        *more,
    )
    unnamed = docs.filter(F.col(id_col).isNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links")
    )
    return all_named.unionByName(unnamed, allowMissingColumns=hashed)
