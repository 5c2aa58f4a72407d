"""Toxicity: a convolutional text classifier trained in numpy.

Words are hashed into embedding rows; a word's vector is the sum of a row for the whole word
and one for its first four bytes, so that inflected forms share evidence. Filters of widths 1, 2 and 3 slide
over the words, a text's strongest response of each filter over the windows that begin at its words is kept (max pooling), and a
logistic layer turns these into one logit. Training is by Adam over mini-batches of whole
texts; of the convolution only the winning windows have a gradient. Thresholds are
calibrated by language on rows kept from training: for each language (recognised by its
function words in the text, never from a column) the logit is scaled and shifted so that
the best threshold of that language lies at 0.7.

Every labelled row outside the held-out fold takes part, with its whole text: of the hashes of id and text three
quarters teach the filters (each row at least once), one quarter sets the thresholds; where a class would have
under 8 rows on a side, all rows do both. The rows are dealt by hash into shards of about SHARD_BYTES of text; a copy
of the model learns on each shard, and the copies are averaged after each round (an embedding row over the copies
that moved it). Toxic rows go to several shards where a shard would see too few of them. Thresholds are searched
over counts of all kept rows in steps of 1 / GRID. Only a caller's max_train (and max_bytes of text) makes it learn
from a sample: of the rows in the order of a hash of id and text, those that still fit. Scores read every text whole.

Edge cases: null and empty texts have no words and get the score of the bias alone; a null label is no label; of
repeated labels of an id the largest counts; without both classes every score is the
smoothed share of toxic rows; other columns are ignored; texts of any length are scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from copy import deepcopy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, as_bytes, extended, tidy, words_of
from .gam import bounded_labels, fold_of

WIDTHS = (1, 2, 3)
# Zero rows behind each text, so that no window reaches from one text into the next.
PAD = max(WIDTHS)
WORD_ROWS, STEM_ROWS = 1 << 16, 1 << 13
# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for with as was on are this".split(),
    "fr": "le la les des et que qui dans une du pour par sur est pas".split(),
    "de": "der die das und nicht den von mit sich dem ein eine zu für auf".split(),
    "es": "el los las del que en y un una por con para se su al".split(),
}
LANGUAGES = [*FUNCTION_WORDS, ""]
CACHE_WORDS = 30_000
SHARD_BYTES = 24 << 20
# Bytes of toxic texts that a shard should hold at least, where there are that many.
TOXIC_BYTES = 3 << 20
ROUNDS = 6
# Windows whose responses are held at a time in training.
SLICE = 1 << 15
GRID = 1024


def hashed(word: bytes) -> tuple[int, int]:
    """Rows of the word and of its stem; row 0 of each table stays zero."""
    return 1 + zlib.crc32(word) % (WORD_ROWS - 1), 1 + zlib.crc32(word[:4], 7) % (STEM_ROWS - 1)


def _votes() -> dict[bytes, int]:
    seen: dict[bytes, set[int]] = {}
    for k, words in enumerate(FUNCTION_WORDS.values()):
        for w in words:
            seen.setdefault(w.encode(), set()).add(k)
    return {w: next(iter(k)) for w, k in seen.items() if len(k) == 1}


VOTES = _votes()


def language(words: list[bytes]) -> int:
    """Index of the language with most function words; the last index where there are none."""
    n = [0] * len(FUNCTION_WORDS)
    for w, k in VOTES.items():
        n[k] += words.count(w) if len(words) < 64 else 0
    if len(words) >= 64:
        for w in words:
            k = VOTES.get(w)
            if k is not None:
                n[k] += 1
    best = max(range(len(n)), key=lambda k: (n[k], -k))
    return best if n[best] else len(FUNCTION_WORDS)


def _dealt(rng: np.random.Generator, rows: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """k rows at a time, in one shuffled pass over all rows after another; none of none."""
    left = rows[:0]
    while True:
        while len(left) < k and len(rows):
            left = np.concatenate([left, rng.permutation(rows)])
        yield left[:k]
        left = left[k:]


def _flat(texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One batch: word rows, stem rows, places and numbers of words of the texts."""
    count = np.array([len(t[0]) for t in texts])
    words, stems = (np.concatenate([*(np.pad(t[j], (0, PAD)) for t in texts), np.zeros(PAD, texts[0][j].dtype)]) for j in (0, 1))
    return words, stems, np.concatenate([[0], np.cumsum(count + PAD)[:-1]]), count


class Cnn:
    def __init__(self, dim: int = 12, filters: int = 12, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.dim, self.filters = dim, filters
        self.word = rng.normal(0, 0.05, (WORD_ROWS, dim)).astype(np.float32)
        self.stem = rng.normal(0, 0.05, (STEM_ROWS, dim)).astype(np.float32)
        self.word[0] = self.stem[0] = 0
        self.taps = {w: rng.normal(0, 0.6 / np.sqrt(dim * w), (w, dim, filters)).astype(np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.3, (len(WIDTHS) * filters,)).astype(np.float32)
        self.shift = np.zeros(len(WIDTHS) * filters, np.float32)
        self.bias = 0.0
        self.scale = np.ones(len(LANGUAGES))
        self.centre = np.zeros(len(LANGUAGES))
        self.constant: float | None = None

    # A batch is a flat array of word rows: each text followed by PAD zero rows; starts are its texts' places.

    def pooled(self, projected: np.ndarray, rows: np.ndarray, starts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Strongest response of each filter over each text's windows (words: how many there are; none gives 0);
        projected: for each row all taps of all widths."""
        cuts = np.stack([starts, starts + np.maximum(words, 1)], axis=1).ravel()
        n, f = len(rows) - PAD, self.filters
        parts, k = [], 0
        for w in WIDTHS:
            total = projected[rows[:n], k * f : (k + 1) * f].copy()
            for t in range(1, w):
                total += projected[rows[t : n + t], (k + t) * f : (k + t + 1) * f]
            k += w
            parts.append(np.maximum.reduceat(total, cuts, axis=0)[::2])
        return np.concatenate(parts, axis=1)

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([vectors @ self.taps[w][t] for w in WIDTHS for t in range(w)], axis=1)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.shift, 0) @ self.out + self.bias

    def strongest(self, words: np.ndarray, stems: np.ndarray, starts: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the strongest response of each filter and the first window that has it, a slice at a time;
        windows begin at words, an empty text has one of zeros."""
        n = len(words) - PAD
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        beyond = np.arange(n) - starts[owner] >= np.maximum(count, 1)[owner]
        top = np.full((len(starts), len(WIDTHS) * self.filters), -np.inf, np.float32)
        where = np.zeros(top.shape, np.int64)
        for a in range(0, n, SLICE):
            b = min(n, a + SLICE)
            vectors = self.word[words[a : b + PAD]] + self.stem[stems[a : b + PAD]]
            own = slice(owner[a], owner[b - 1] + 1)
            cuts = np.maximum(starts[own] - a, 0)
            for j, w in enumerate(WIDTHS):
                cols = slice(j * self.filters, (j + 1) * self.filters)
                total = vectors[: b - a] @ self.taps[w][0]
                for t in range(1, w):
                    total += vectors[t : b - a + t] @ self.taps[w][t]
                total[beyond[a:b]] = -np.inf
                best = np.maximum.reduceat(total, cuts, axis=0)
                hit = np.where(total == best[owner[a:b] - owner[a]], np.arange(a, b)[:, None], n)
                first = np.minimum.reduceat(hit, cuts, axis=0)
                better = best > top[own, cols]
                where[own, cols] = np.where(better, first, where[own, cols])
                top[own, cols] = np.where(better, best, top[own, cols])
        return top, where

    def dense(self) -> dict[str, np.ndarray]:
        return {"out": self.out, "shift": self.shift} | {f"tap{w}": self.taps[w] for w in WIDTHS}

    def fresh(self) -> dict[str, np.ndarray]:
        """What training remembers from step to step: both moments of Adam, the squares of the embedding rows."""
        state = {f"{m}-{k}": np.zeros_like(v) for k, v in self.dense().items() for m in "mv"}
        return state | {"word": np.zeros(WORD_ROWS, np.float32), "stem": np.zeros(STEM_ROWS, np.float32)}

    def fit(
        self,
        texts: list[tuple[np.ndarray, np.ndarray]],
        y: np.ndarray,
        steps: int = 900,
        batch: int = 48,
        seed: int = 5,
        part: tuple[int, int] = (0, 1),
        state: dict[str, np.ndarray] | None = None,
    ) -> None:
        """texts: word and stem rows of each text. Rows are dealt in shuffled passes, with more steps where that many
        wouldn't reach all of them. part (i, n): only the i-th of n parts of the steps, on state."""
        rng = np.random.default_rng(seed)
        pos, neg = np.flatnonzero(y > 0), np.flatnonzero(y <= 0)
        if not len(y):
            return
        k = max(1, batch // 3)
        steps = max(steps, -(-len(pos) // k), -(-len(neg) // (batch - k)))
        begin, end = steps * part[0] // part[1], steps * (part[0] + 1) // part[1]
        toxic, clean = _dealt(rng, pos, k), _dealt(rng, neg, batch - k)
        f, rate, b1, b2 = self.filters, 0.01, 0.9, 0.999
        dense, state = self.dense(), self.fresh() if state is None else state
        for step in range(1, end + 1):
            pick = np.concatenate([next(toxic), next(clean)])
            if step <= begin:
                continue
            words, stems, starts, count = _flat([texts[i] for i in pick])
            target = y[pick]
            pooled, where = self.strongest(words, stems, starts, count)
            a = pooled + self.shift
            r = np.maximum(a, 0)
            p = 1 / (1 + np.exp(-(r @ self.out + self.bias)))
            # Toxic rows are drawn more often than they occur; the calibration sets the level.
            d = ((p - target) / len(pick)).astype(np.float32)
            grad = {"out": r.T @ d + 1e-4 * self.out}
            da = np.where(a > 0, d[:, None] * self.out, 0)
            grad["shift"] = da.sum(0)
            self.bias -= 0.05 * float(d.sum())
            at, moves = [], []
            for j, w in enumerate(WIDTHS):
                dw, own = da[:, j * f : (j + 1) * f], where[:, j * f : (j + 1) * f]
                g = np.empty_like(self.taps[w])
                for t in range(w):
                    v = self.word[words[own + t]] + self.stem[stems[own + t]]  # texts x filters x dim
                    g[t] = np.einsum("bf,bfd->df", dw, v)
                    at.append((own + t).ravel())
                    moves.append((dw[:, :, None] * self.taps[w][t].T[None]).reshape(-1, self.dim))
                grad[f"tap{w}"] = g + 1e-4 * self.taps[w]
            for name, g in grad.items():
                m, v = state[f"m-{name}"], state[f"v-{name}"]
                m += (1 - b1) * (g - m)
                v += (1 - b2) * (g * g - v)
                dense[name] -= rate * (m / (1 - b1**step)) / (np.sqrt(v / (1 - b2**step)) + 1e-7)
            place, move = np.concatenate(at), np.concatenate(moves)
            for name, table, rows in (("word", self.word, words), ("stem", self.stem, stems)):
                own, back = np.unique(rows[place], return_inverse=True)
                g = np.zeros((len(own), self.dim), np.float32)
                np.add.at(g, back, move)
                state[name][own] += (g * g).mean(1)
                table[own] -= 0.05 * g / (np.sqrt(state[name][own])[:, None] + 1e-6)
                table[0] = 0

    def calibrate(self, z: np.ndarray, lang: np.ndarray, y: np.ndarray, clean: float = 1.0, n: np.ndarray | None = None) -> None:
        """For each language the threshold with the fewest weighted errors goes to 0.7.

        n says how many rows each entry counts for (1 by default). A clean row stands for ``clean`` rows of its kind;
        taking one for toxic counts twice.
        """
        n = np.ones(len(z), np.int64) if n is None else n

        def median(z: np.ndarray, n: np.ndarray) -> float:
            below = np.cumsum(n)
            return float(z[np.searchsorted(below, [(below[-1] - 1) // 2, below[-1] // 2], "right")].mean())

        def centre(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
            z, at = np.unique(z, return_inverse=True)
            toxic, fine = (np.bincount(at, n * c, len(z)).astype(np.int64) for c in (y > 0, y <= 0))
            wrong = np.concatenate([[0], np.cumsum(toxic)]) + 2 * clean * (fine.sum() - np.concatenate([[0], np.cumsum(fine)]))
            best = np.flatnonzero(wrong == wrong.min())
            k = int(best[len(best) // 2])
            low, high = z[max(0, k - 1)], z[min(k, len(z) - 1)]
            return float((low + high) / 2), 8 / max(1e-3, median(z, toxic) - median(z, fine))

        whole = centre(z, y, n)
        for k in range(len(LANGUAGES)):
            own = lang == k
            enough = n[own & (y > 0)].sum() >= 8 and n[own & (y <= 0)].sum() >= 8
            self.centre[k], self.scale[k] = centre(z[own], y[own], n[own]) if enough else whole

    def probability(self, z: np.ndarray, lang: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(z), self.constant)
        x = np.clip(self.scale[lang] * (z - self.centre[lang]) + np.log(0.7 / 0.3), -40, 40)
        return 1 / (1 + np.exp(-x))


class Scorer:
    """Scores whole texts; a word's projections are computed when it is first met."""

    def __init__(self, model: Cnn):
        self.model = model
        self.width = sum(WIDTHS) * model.filters
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((4096, self.width), np.float32)
        self.size = 1

    def add(self, words: list[bytes]) -> None:
        rows = np.array([hashed(w) for w in words])
        new = self.model.project(self.model.word[rows[:, 0]] + self.model.stem[rows[:, 1]])
        end = self.size + len(words)
        while end > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.size : end] = new
        self.known.update(zip(words, range(self.size, end), strict=True))
        self.size = end

    def logits(self, texts: list[list[bytes]]) -> np.ndarray:
        if self.size > CACHE_WORDS:
            self.reset()
        flat: list[bytes] = []
        lengths = []
        for t in texts:
            flat += t
            lengths.append(len(t))
        get = self.known.get
        if new := {w for w in set(flat) if get(w) is None}:
            self.add(sorted(new))
        ids = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        n = np.array(lengths)
        starts = np.concatenate([[0], np.cumsum(n + PAD)[:-1]])
        rows = np.zeros(int((n + PAD).sum()) + PAD, np.int64)
        shift = np.repeat(np.arange(len(n)) * PAD, n)
        rows[np.arange(len(flat)) + shift] = ids
        return self.model.logits(self.model.pooled(self.table, rows, starts, n))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word and stem rows, in two bytes each; equal rows under one id leave a task once."""
    seen: set[int] = set()
    for batch in batches:
        fresh = []
        for i, k in enumerate(batch.column(0).to_pylist()):
            if k not in seen:
                seen.add(k)
                fresh.append(i)
        if len(fresh) < batch.num_rows:
            batch = batch.take(pa.array(fresh, pa.int64()))
        words, stems, langs = [], [], []
        memory: dict[bytes, tuple[int, int]] = {}
        for t in as_bytes(batch.column(2)):
            own = words_of(t)
            memory.update((w, hashed(w)) for w in set(own).difference(memory))
            rows = np.array([memory[w] for w in own], np.uint16).reshape(-1, 2)
            words.append(rows[:, 0].tobytes())
            stems.append(rows[:, 1].tobytes())
            langs.append(language(own))
            if len(memory) > CACHE_WORDS:
                memory.clear()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(langs, pa.int32()), pa.array(words, pa.binary()), pa.array(stems, pa.binary())],
            ["k", "y", "lang", "words", "stems"],
        )


SHARD = "shard int, k binary, y binary, lang binary, home binary, size binary, words binary, stems binary"


def _pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """A shard as one row, in the order of k."""
    k, at = np.unique(rows["k"].to_numpy(), return_index=True)
    rows = rows.take(pa.array(at))
    words, stems = rows["words"].to_pylist(), rows["stems"].to_pylist()
    parts = [
        k.astype(np.int64).tobytes(),
        (rows["y"].to_numpy() > 0).astype(np.uint8).tobytes(),
        rows["lang"].to_numpy().astype(np.uint8).tobytes(),
        (rows["copy"].to_numpy() == 0).astype(np.uint8).tobytes(),
        np.array([len(w) // 2 for w in words], np.int64).tobytes(),
        b"".join(words),
        b"".join(stems),
    ]
    return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)], names=["shard", "k", "y", "lang", "home", "size", "words", "stems"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Shard number, texts, k, y, lang and home of each shard."""
    for batch in batches:
        for i in range(batch.num_rows):
            raw = [batch.column(j)[i].as_buffer() for j in range(1, 8)]
            k, y, lang, home, size, words, stems = (
                np.frombuffer(r, t) for r, t in zip(raw, (np.int64, np.uint8, np.uint8, np.uint8, np.int64, np.uint16, np.uint16), strict=True)
            )
            cuts = np.cumsum(size)[:-1]
            yield batch.column(0)[i].as_py(), list(zip(np.split(words, cuts), np.split(stems, cuts), strict=True)), k, y, lang, home


def _kept(k: np.ndarray) -> np.ndarray:
    """The quarter of the rows that sets thresholds: by bits that do not choose the shard."""
    return (k.astype(np.uint64) >> np.uint64(60)) % np.uint64(4) == 1


def _moved(new: Cnn, old: Cnn, state: dict[str, np.ndarray], before: dict[str, np.ndarray], blocks: int) -> Iterator[tuple[int, bytes, bytes]]:
    """What a copy has changed: block, rows and their changes (vector, squares) of the tables; at last all else."""
    base = 0
    for name, a, b in (("word", new.word, old.word), ("stem", new.stem, old.stem)):
        change = np.concatenate([a - b, (state[name] - before[name])[:, None]], axis=1)
        rows = np.flatnonzero(change.any(axis=1))
        for block in range(blocks):
            own = rows[(base + rows) % blocks == block]
            if len(own):
                yield block, (base + own).astype(np.int32).tobytes(), change[own].tobytes()
        base += len(a)
    rest = [new.dense()[k] - v for k, v in old.dense().items()] + [state[k] - v for k, v in before.items() if k not in ("word", "stem")]
    rest.append(np.array([new.bias - old.bias]))
    yield -1, b"", np.concatenate([r.ravel() for r in rest]).astype(np.float32).tobytes()


def _mean(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Mean changes of a block, in the order of the shards: of a row over the copies that moved it."""
    block = key[0].as_py()
    # The words' and the stems' changes of one shard concern different rows, so their order does not matter.
    rows = rows.take(pa.array(np.argsort(rows["shard"].to_numpy(), kind="stable")))
    if block < 0:
        own, changes = b"", [np.frombuffer(c, np.float32) for c in rows["change"].to_pylist()]
        total = sum(c.astype(np.float64) for c in changes) / len(changes)
    else:
        ids = [np.frombuffer(r, np.int32) for r in rows["rows"].to_pylist()]
        every, at = np.unique(np.concatenate(ids), return_inverse=True)
        changes = np.concatenate([np.frombuffer(c, np.float32).reshape(len(r), -1) for r, c in zip(ids, rows["change"].to_pylist(), strict=True)])
        total = np.zeros((len(every), changes.shape[1]))
        np.add.at(total, at, changes)
        total /= np.bincount(at)[:, None]
        own = every.tobytes()
    return pa.table([pa.array([block], pa.int32()), pa.array([own], pa.binary()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["block", "rows", "change"])


def _learn(shards: DataFrame, model: Cnn, blocks: int, all_rows: bool, rounds: int) -> None:
    """Train model in rounds: a copy on each shard, then their mean."""
    state = model.fresh()
    for turn in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            for shard, texts, k, y, *_ in _shards(batches):
                own, mine = deepcopy((model, state))
                learn = np.flatnonzero(all_rows | ~_kept(k))
                own.fit([texts[i] for i in learn], y[learn].astype(float), seed=5 + shard, part=(turn, rounds), state=mine)
                for block, rows, change in _moved(own, model, mine, state, blocks):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int32()), pa.array([shard], pa.int32()), pa.array([rows], pa.binary()), pa.array([change], pa.binary())],
                        ["block", "shard", "rows", "change"],
                    )

        moved = shards.mapInArrow(tidy(run), "block int, shard int, rows binary, change binary")
        means = moved.groupBy("block").applyInArrow(_mean, "block int, rows binary, change binary").collect()
        for r in means:
            change = np.frombuffer(r["change"], np.float32)
            if r["block"] < 0:
                places = [*model.dense().values(), *(v for k, v in state.items() if k not in ("word", "stem"))]
                for v, c in zip(places, np.split(change[:-1], np.cumsum([v.size for v in places])[:-1]), strict=True):
                    v += c.reshape(v.shape)
                model.bias += float(change[-1])
                continue
            rows, change = np.frombuffer(r["rows"], np.int32), change.reshape(-1, model.dim + 1)
            for name, table, base in (("word", model.word, 0), ("stem", model.stem, WORD_ROWS)):
                own = (rows >= base) & (rows < base + len(table))
                table[rows[own] - base] += change[own, :-1]
                state[name][rows[own] - base] += change[own, -1]


def _counts(shards: DataFrame, model: Cnn, all_rows: bool) -> pa.Table:
    """How many of the rows that set thresholds have a language, label and logit (in steps of 1 / GRID)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, k, y, lang, home in _shards(batches):
            own = np.flatnonzero((home > 0) & (all_rows | _kept(k)))
            z = [model.logits(model.strongest(*_flat([texts[i] for i in own[a : a + 64]]))[0]) for a in range(0, len(own), 64)]
            step = np.rint(np.concatenate([*z, np.zeros(0)]) * GRID).astype(np.int64)
            found, n = np.unique(np.stack([lang[own].astype(np.int64), y[own].astype(np.int64), step]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(f) for f in found), pa.array(n.astype(np.int64))], ["lang", "y", "z", "n"])

    counted = shards.mapInArrow(tidy(run), "lang long, y long, z long, n long")
    return counted.groupBy("lang", "y", "z").agg(F.sum("n").alias("n")).toArrow()


def _labelled(own: DataFrame, known: DataFrame) -> DataFrame:
    """Inner join of own (__doc) with known (__id, distinct) by a shuffle. First a broadcast bitmap of hashes, of 2 bytes
    an id, drops nearly all rows without a label, so that their texts do not travel."""
    on = F.col("__doc") == F.col("__id")
    if own.schema["__doc"].dataType == known.schema["__id"].dataType:  # else equal ids may have different hashes
        bits = 16 * max(1, known.count())

        def spot(c: str) -> Column:
            return F.pmod(F.xxhash64(c), F.lit(bits)) + 1

        maps = known.groupBy(F.bitmap_bucket_number(spot("__id")).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot("__id"))).alias("__bits"))
        place = F.bitmap_bit_position(spot("__doc"))
        byte = F.conv(F.hex(F.substring("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        there = (F.bitmap_bucket_number(spot("__doc")) == F.col("__bucket")) & (byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) > 0)
        own = own.join(F.broadcast(maps), there, "left_semi")
    return own.join(known.hint("merge"), on)


def train(
    docs: DataFrame,
    labels: DataFrame,
    target: str = "toxic",
    folds: int = 3,
    held_out: int = 1,
    max_train: int | None = None,
    max_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_bytes: int = SHARD_BYTES,
) -> Cnn:
    spark = docs.sparkSession
    usable = labels.filter(F.col(target).isNotNull() & F.col(id_col).isNotNull() & (fold_of(F.col(id_col), folds) != held_out))
    by_id = usable.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(target).cast("int")).alias("__y"))
    space = Workspace(spark, "cnn")
    # Toxic rows are rare: up to a third of a bounded sample is kept for them.
    known = space.table(by_id if max_train is None else bounded_labels(labels, target, folds, held_out, max_train, id_col, positives=1 / 3), "labels")
    own = docs.filter(fold_of(F.col(id_col), folds) != held_out).select(
        F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"), F.xxhash64(id_col, text_col).alias("__k"), F.octet_length(text_col).alias("__n")
    )
    # Narrow rows first. Equal rows under one id are taken once.
    narrow = _labelled(own.drop("__text"), known).groupBy("__k").agg(F.max("__y").alias("y"), F.max("__n").alias("n"))
    if max_train is not None:
        chosen, left = [], float("inf") if max_bytes is None else max_bytes
        offered = narrow.orderBy("__k").limit(2 * max_train).collect()
        for want in (1, 0):  # rare rows first
            for r in offered:
                if (r["y"] > 0) == bool(want) and (r["n"] or 0) <= left and len(chosen) < max_train:
                    chosen.append((r["__k"],))
                    left -= r["n"] or 0
        keys = F.broadcast(spark.createDataFrame(chosen, "__k long"))
        own, narrow = own.join(keys, "__k"), narrow.join(keys, "__k")
    elif max_bytes is not None:
        raise ValueError("max_bytes bounds the sample that max_train asks for")
    kept = F.pmod(F.shiftrightunsigned("__k", 60), F.lit(4)) == 1  # as in _kept
    sizes = {
        (r["toxic"], r["kept"]): (r["rows"], r["bytes"] or 0)
        for r in narrow.groupBy((F.col("y") > 0).alias("toxic"), kept.alias("kept")).agg(F.count("*").alias("rows"), F.sum("n").alias("bytes")).collect()
    }
    rows = {(a, b): sizes.get((a, b), (0, 0))[0] for a in (True, False) for b in (True, False)}
    toxic_bytes = sum(b for (toxic, _), (_, b) in sizes.items() if toxic)
    model = Cnn()
    positives, n = rows[True, True] + rows[True, False], sum(rows.values())
    if positives < 2 or n - positives < 2:
        model.constant = float((positives + 1) / (n + 2))
        space.drop(known)
        return model
    all_rows = n < 200 or min(rows.values()) < 8
    parts = max(1, -(-sum(b for _, b in sizes.values()) // shard_bytes))
    copies = min(parts, max(1, -(-TOXIC_BYTES * parts // max(1, toxic_bytes))))
    copy = F.explode(F.when(F.col("y") > 0, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0))))
    shards = space.table(
        _labelled(own, known)
        .select("__k", F.col("__y").alias("y"), "__text")
        .mapInArrow(tidy(_tokens), "k long, y int, lang int, words binary, stems binary")
        .withColumn("copy", copy)
        .withColumn("shard", F.pmod(F.pmod("k", F.lit(parts)) + F.col("copy"), F.lit(parts)).cast("int"))
        .groupBy("shard")
        .applyInArrow(_pack, SHARD),
        "shards",
    )
    _learn(shards, model, min(parts, 64), all_rows, ROUNDS if parts > 1 else 1)
    counts = _counts(shards, model, all_rows)
    space.drop(shards, known)
    clean = 1.0
    if max_train is not None:
        toxic, fine = by_id.agg(F.sum((F.col("__y") > 0).cast("int")), F.sum((F.col("__y") <= 0).cast("int"))).first()
        clean = max(1.0, (fine or 1) / (toxic or 1) * positives / (n - positives))
    lang, y, z, count = (counts[c].to_numpy() for c in ("lang", "y", "z", "n"))
    model.calibrate(z / GRID, lang, y, clean, count)
    return model


def score(
    docs: DataFrame,
    model: Cnn,
    threshold: float = 0.7,
    keep: list[str] | None = None,
    text_col: str = "text",
    score_col: str = "score",
    predicted_col: str = "predicted",
    batch_bytes: int = 1 << 20,
) -> DataFrame:
    """The kept columns (all by default) with score_col and predicted_col, which replace columns of these names."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (score_col, predicted_col)]
    kept = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.col(text_col).alias("__text"))
    schema = extended(docs, keep, f"`{score_col}` double, `{predicted_col}` int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = as_bytes(batch.column(len(keep)))
            scores: list[np.ndarray] = []
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (size < batch_bytes or stop == start):
                    size += len(texts[stop])
                    stop += 1
                own = [words_of(t) for t in texts[start:stop]]
                scores.append(model.probability(scorer.logits(own), np.array([language(w) for w in own])))
                start = stop
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                schema.names,
            )

    return kept.mapInArrow(tidy(run), schema)
