"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs: the pair whose joined piece has the
highest score (the leftmost on ties) is merged first, its two new neighbour pairs enter, until
no pair forms a piece. For the short runs between blanks the agendas of a whole Arrow batch
advance together, as rows of numpy arrays (one merge per row and round); longer runs use a
heap. No piece of such a vocabulary has a blank mark after another character (checked when the
model is loaded; otherwise whole texts are runs), so runs encode on their own and are looked up
when they come again. Every run that is encoded is checked against the sentencepiece library,
in the same Arrow batch; a difference raises an error.

Edge cases: a null or empty text has the begin and end ids alone and decodes to ''; other
columns and their names do not matter; rows are independent, so repeated ids or texts are kept.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LASTING, as_texts, extended, tidy

MARK = "▁"
NONE = np.int64(1 << 60)
CACHE_ENTRIES = 60_000
BATCH_CHARS = 1 << 20
WIDTHS = (5, 7, 9, 12, 16, 32, 64)
TABLE_BITS = 19


class Agenda:
    """Merge-type encoder over the pieces and scores of a model."""

    def __init__(self, model_file: str):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        self.piece = {sp.id_to_piece(i): i for i in range(size) if not special(i)}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.split_runs = not any(MARK in p.lstrip(MARK) for p in self.piece)
        chars = {c for p in self.piece for c in p}
        # Characters that only occur inside pieces get symbols behind the vocabulary.
        self.symbol = {c: self.piece.get(c, size + k) for k, c in enumerate(sorted(chars))}
        self.size, self.base = size, size + len(chars) + 1
        self.unknown = self.base - 1
        self.by_code = np.full(0x110000, self.unknown, np.int32)
        self.by_code[[ord(c) for c in self.symbol]] = list(self.symbol.values())
        ranks = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in self.piece.values()}, reverse=True))}
        pairs: dict[int, tuple[int, int]] = {}
        for p, i in self.piece.items():
            rank = ranks[sp.get_score(i)]
            for k in range(1, len(p)):
                left, right = (self.piece.get(x, self.symbol.get(x)) for x in (p[:k], p[k:]))
                if left is not None and right is not None:
                    pairs[left * self.base + right] = (rank, i)
        # Hash tables of key -> rank << 20 | id; what doesn't fit into one goes to the next.
        keys = np.array(sorted(pairs), np.int64)
        values = np.array([pairs[k][0] << 20 | pairs[k][1] for k in keys.tolist()], np.int64)
        self.tables: list[tuple[np.int64, np.ndarray, np.ndarray]] = []
        while len(keys):
            factor = np.int64(0x1E3779B97F4A7C15 + 2 * len(self.tables))
            slots = self.slot(keys, factor)
            _, first = np.unique(slots, return_index=True)
            table_keys, table_values = np.full(1 << TABLE_BITS, -1, np.int64), np.full(1 << TABLE_BITS, NONE)
            table_keys[slots[first]], table_values[slots[first]] = keys[first], values[first]
            self.tables.append((factor, table_keys, table_values))
            keys, values = np.delete(keys, first), np.delete(values, first)
        self.pairs = {k: v[0] << 20 | v[1] for k, v in pairs.items()}

    @staticmethod
    def slot(key: np.ndarray, factor: np.int64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key * factor).view(np.uint64) >> np.uint64(64 - TABLE_BITS)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * np.int64(self.base) + right
        out = None
        for factor, keys, values in self.tables:
            at = self.slot(key, factor)
            found = np.where(keys[at] == key, values[at], NONE)
            out = found if out is None else np.minimum(out, found)
        return np.full(len(key), NONE) if out is None else out

    def together(self, runs: list[str], width: int) -> list[bytes]:
        """Ids (u32 bytes) of runs of at most width characters; one row of each array is one agenda."""
        n = len(runs)
        lengths = np.fromiter(map(len, runs), np.int64, n)
        sym = np.full((n, width + 2), self.unknown, np.int64)  # column 0 and the last are walls
        codes = np.frombuffer("".join(runs).encode("utf-32-le"), "<u4")
        sym[:, 1:-1][np.arange(width) < lengths[:, None]] = self.by_code[codes]
        nxt = np.tile(np.arange(1, width + 3), (n, 1))
        prv = np.tile(np.arange(-1, width + 1), (n, 1))
        agenda = np.full((n, width + 2), NONE)
        agenda[:, :-1] = self.lookup(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, -1)
        alive = np.ones((n, width + 2), bool)
        rows = np.arange(n)
        while len(rows):
            # The rank alone decides; argmin takes the leftmost of equal ranks.
            at = np.argmin(agenda[rows] >> 20, axis=1)
            top = agenda[rows, at]
            go = top < NONE
            rows, at, top = rows[go], at[go], top[go]
            right = nxt[rows, at]
            after = nxt[rows, right]
            before = prv[rows, at]
            merged = top & 0xFFFFF
            sym[rows, at] = merged
            alive[rows, right] = False
            agenda[rows, right] = NONE
            nxt[rows, at] = after
            prv[rows, after] = at
            agenda[rows, at] = self.lookup(merged, sym[rows, after])
            agenda[rows, before] = np.where(before > 0, self.lookup(sym[rows, before], merged), NONE)
        alive[:, 0] = alive[:, -1] = False
        alive[:, 1:-1] &= np.arange(width) < lengths[:, None]
        out = []
        odd = ((sym >= self.size) & alive).any(axis=1)
        flat, ends = sym[alive].astype("<u4"), np.cumsum(alive.sum(axis=1))
        data, stops = flat.tobytes(), (ends * 4).tolist()
        a = 0
        for i, b in enumerate(stops):
            if odd[i]:
                ids: list[int] = []
                for j in np.flatnonzero(alive[i]).tolist():
                    ids += [int(sym[i, j])] if sym[i, j] < self.size else self.fallback(runs[i][j - 1])
                out.append(np.array(ids, "<u4").tobytes())
            else:
                out.append(data[a:b])
            a = b
        return out

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()]

    def one(self, run: str) -> bytes:
        """Ids of one run of any length: the agenda is a heap, stale entries are skipped."""
        n, base, pairs = len(run), self.base, self.pairs
        sym = [self.symbol.get(c, self.unknown) for c in run]
        nxt, prv, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def enter(i: int, j: int) -> None:
            v = pairs.get(sym[i] * base + sym[j])
            if v is not None:
                heapq.heappush(heap, (v >> 20, i, v & 0xFFFFF, sym[i], sym[j]))

        for i in range(n - 1):
            enter(i, i + 1)
        while heap:
            _, i, merged, left, right = heapq.heappop(heap)
            j = nxt[i]
            if gone[i] or j >= n or sym[i] != left or sym[j] != right:
                continue
            sym[i], gone[j], nxt[i] = merged, True, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                enter(i, nxt[i])
            if prv[i] >= 0:
                enter(prv[i], i)
        ids: list[int] = []
        for i in range(n):
            if not gone[i]:
                ids += [sym[i]] if sym[i] < self.size else self.fallback(run[i])
        return np.array(ids, "<u4").tobytes()

    def encode_runs(self, runs: list[str]) -> list[bytes]:
        """Ids of runs (blanks as marks), each checked against the library."""
        out: list[bytes] = [b""] * len(runs)
        kind = np.searchsorted(WIDTHS, np.fromiter(map(len, runs), np.int64, len(runs)))
        for k in np.unique(kind).tolist():
            places = np.flatnonzero(kind == k).tolist()
            some = [runs[i] for i in places]
            found = self.together(some, WIDTHS[k]) if k < len(WIDTHS) else map(self.one, some)
            for i, ids in zip(places, found, strict=True):
                out[i] = ids
        # The library adds the first mark itself, but not to an empty text.
        expected = self.sp.encode([r[1:] for r in runs], num_threads=1)
        lengths = [len(x) if r != MARK else 1 for r, x in zip(runs, expected, strict=True)]
        joined = [i for r, x in zip(runs, expected, strict=True) for i in (x if r != MARK else [self.piece[MARK]])]
        if [len(b) // 4 for b in out] != lengths or np.frombuffer(b"".join(out), "<u4").tolist() != joined:
            raise ValueError("encoding differs from the sentencepiece library's")
        return out


class Encoder:
    """Whole texts by their runs, with a bounded memory of runs."""

    def __init__(self, model_file: str):
        self.agenda = Agenda(model_file)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.runs_re = re.compile(" +[^ ]*")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids without begin and end, as u32 bytes."""
        runs: list[list[str]] = []
        for t in texts:
            if MARK in t:
                t = t.replace(MARK, " ")
            if not t:
                runs.append([])
            elif not self.agenda.split_runs:
                runs.append([t])
            elif t[0] == " " or "  " in t:
                runs.append([r[1:] for r in self.runs_re.findall(" " + t)])
            else:
                runs.append(t.split(" "))
        young, old = self.young, self.old
        flat = list(chain.from_iterable(runs))
        ids = list(map(young.get, flat))
        if None in ids:
            places = [i for i, x in enumerate(ids) if x is None]
            missing = []
            for r in {flat[i] for i in places}:
                if r in old:
                    young[r] = old[r]
                else:
                    missing.append(r)
            marked = [MARK + r.replace(" ", MARK) for r in missing]
            young.update(zip(missing, self.agenda.encode_runs(marked), strict=True))
            for i in places:
                ids[i] = young[flat[i]]
        ends = list(accumulate(map(len, runs), initial=0))
        out = [b"".join(ids[a:b]) for a, b in pairwise(ends)]
        if len(young) > CACHE_ENTRIES:
            self.old, self.young = young, {}
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.agenda.sp.decode([np.frombuffer(b, "<u4").tolist() for b in ids], num_threads=1)


@lru_cache(2)
def encoder_for(model_file: str) -> Encoder:
    """One for all tasks of a Python worker, so that its memory of runs lasts."""
    return Encoder(model_file)


LASTING["sp_agenda"] = encoder_for.cache_clear


def encode_decode(
    docs: DataFrame,
    model_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    digests_only: bool = False,
) -> DataFrame:
    """Per row: the kept columns, ids (u32 bytes with begin and end), n_tokens, decoded, and their digests."""
    keep = [id_col] if keep is None else keep
    schema = extended(
        docs,
        keep,
        "n_tokens long, ids_sha256 string, decoded_sha256 string" + ("" if digests_only else ", ids binary, decoded string"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_for(model_file)
        sp = enc.agenda.sp
        bos, eos = (np.array([x], "<u4").tobytes() for x in (sp.bos_id(), sp.eos_id()))
        for batch in batches:
            texts = as_texts(batch.column(0))
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (size < BATCH_CHARS or stop == start):
                    size += len(texts[stop])
                    stop += 1
                ids = [bos + b + eos for b in enc.encode(texts[start:stop])]
                decoded = enc.decode(ids)
                kept = batch.slice(start, stop - start)
                columns = [kept.column(k + 1) for k in range(len(keep))] + [
                    pa.array([len(b) // 4 for b in ids], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in ids], pa.string()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                ]
                if not digests_only:
                    columns += [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)
                start = stop

    return docs.select(F.col(text_col).alias("__text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep))).mapInArrow(tidy(run, "sp_agenda"), schema)
