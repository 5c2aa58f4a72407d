"""Token ids as static range asymmetric numeral system (rANS) blocks.

File format: a Parquet dataset, one row per block, in ascending id order. A block holds
whole documents: their ids and token counts, the place of its first token, and a payload:

    magic "RNS1", u32 lanes, u32 steps, u32 tokens, u32 scale bits, u32 checkpoint interval,
    u32 words, then per checkpoint u32 word offset + lanes x u64 states, then the words (u32).

Token i of a block belongs to lane i % lanes at step i // lanes; all lanes advance together
(numpy vectors) and share one word stream, so blocks decode independently of each other and
every checkpoint is a place to start inside a block. The symbol frequencies are shared by all
blocks; they are exact counts over all documents, scaled to 2**bits with every
occurring symbol kept, and stand beside the blocks (folder _model: id, freq, bits), so that a dataset can be
read by itself. Each payload has a crc32, checked before decoding. A whole block is decoded from all its
checkpoints at once: each is a row of lanes that advances with the others.

Edge cases: a null or empty text is a document of the end id alone; an empty table gives
an empty dataset; rows with equal or null ids are kept and ordered by id, then by tokens (nulls
first); only the id and text columns are used.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import LASTING, as_texts, materialise, shared_dir, short_batches, tidy

MAGIC = b"RNS1"
HEAD = struct.Struct("<4s6I")
LOW = 1 << 31
BLOCK_TOKENS = 1 << 20
CACHE_ENTRIES = 400_000
BATCH_CHARS = 4 << 20
BATCH_SIZE = "4m"


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable bytes stand for themselves."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()
# Texts of ASCII (but odd blanks) and extended Latin letters, whose classes no Unicode version has changed.
PLAIN = re.compile("[\\n\x01-\x08\x0e-\x1b\x20-\x7fÀ-ÖØ-öø-ɏ]*\\Z")
# Classes of their UTF-8 bytes: letter, digit, blank, other.
LETTER, DIGIT, BLANK, OTHER = range(4)
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
CLASSES[48:58] = DIGIT
CLASSES[[10, 32]] = BLANK


def piece_starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the byte-level pre-tokenizer's pieces start in plain texts, one after another in data.

    Its pattern: 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?digits| ?others|blanks; first are the texts' own starts.
    """
    kind = CLASSES[data]
    start = np.empty(len(data), bool)
    start[:1] = True
    start[1:] = (kind[1:] != kind[:-1]) & (data[:-1] != 32)
    start |= kind == BLANK
    start[first] = True
    quotes = np.flatnonzero((data == 39) & start)
    if len(quotes):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        text_end = np.concatenate([first, [len(data)]])
        left = text_end[np.searchsorted(text_end, quotes, "right")] - quotes - 1
        a, b = padded[quotes + 1], padded[quotes + 2]
        one = (left >= 1) & np.isin(a, [115, 116, 109, 100])  # s t m d
        two = (left >= 2) & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))  # re ve ll
        for hit, size in ((quotes[one], 1), (quotes[two & ~one], 2)):
            start[hit + 1] = False
            after = hit + 1 + size
            after = after[after < len(data)]
            start[after[kind[after] == LETTER]] = True
    return np.flatnonzero(start)


# --- tokenizing ---------------------------------------------------------------------------


class PieceTokenizer:
    """The tokenizers library's ids of whole texts, looked up by the pieces of its pre-tokenizer.

    A byte-level pre-tokenizer cuts a text by a pattern, and merges never cross its pieces. The texts of a
    batch are cut by the same pattern as one vector of bytes, and Arrow numbers the distinct pieces; those
    not met before are encoded by the library's model, and the ids of the texts are gathered from their
    pieces'. Texts with added tokens, unusual characters or several blanks in a row, and all texts of other
    kinds of tokenizers, go to the library whole.
    """

    def __init__(self, path: str, end_id: int):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        kind = self.tok.pre_tokenizer.__getstate__() if self.tok.pre_tokenizer else b""
        kind = kind if isinstance(kind, bytes) else str(kind).encode()
        plain = b'"add_prefix_space":false' in kind and b'"use_regex":true' in kind
        self.by_piece = b'"ByteLevel"' in kind and plain and self.tok.normalizer is None
        added = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.end = np.uint32(end_id).tobytes()
        # Recent pieces, two generations.
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        return [
            np.array(e.ids, np.uint32).tobytes()
            for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)
        ]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of the pre-tokenizer, as the library's model merges them."""
        one = self.tok.model.tokenize
        return [array("I", [t.id for t in one(p.decode("latin1").translate(BYTE_LETTERS))]).tobytes() for p in pieces]

    def looked_up(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces."""
        young, old = self.young, self.old
        found = list(map(young.get, pieces))
        missing = []
        for i, x in enumerate(found):
            if x is None:
                if (x := old.get(pieces[i])) is not None:
                    young[pieces[i]] = found[i] = x
                else:
                    missing.append(i)
        new = [pieces[i] for i in missing]
        for i, p, x in zip(missing, new, self.encode_pieces(new), strict=True):
            young[p] = found[i] = x
        if len(young) > CACHE_ENTRIES:
            self.old, self.young = young, {}
        return found

    def whole(self, t: str) -> bool:
        """Whether a text has to go to the library as it is."""
        if not self.by_piece or self.added and self.added.search(t):
            return True
        return "  " in t or "\n " in t or " \n" in t or "\n\n" in t or not PLAIN.match(t)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, each text's followed by the end id, and their numbers."""
        alone = [i for i, t in enumerate(texts) if self.whole(t)]
        odd = set(alone)
        plain = [b"" if i in odd else t.encode() for i, t in enumerate(texts)]
        data = np.frombuffer(b"".join(plain), np.uint8)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))])
        begin = bounds[:-1][np.diff(bounds) > 0]
        at = piece_starts(data, begin) if len(data) else np.zeros(0, np.int64)
        offsets = np.append(at, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        numbered = pieces.dictionary_encode()
        known = self.looked_up(numbered.dictionary.to_pylist())
        known += [x + self.end for x in self.library([texts[i] for i in alone])]
        known.append(self.end)
        index = numbered.indices.to_numpy().astype(np.int64)
        cuts = np.searchsorted(at, bounds)
        # One more entry behind each text: the end id, or the whole text with it.
        last = np.full(len(texts), len(known) - 1, np.int64)
        last[alone] = len(known) - 1 - len(alone) + np.arange(len(alone))
        index = np.insert(index, cuts[1:], last)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        values = np.frombuffer(b"".join(known), "<u4")
        n = sizes[index]
        ends = np.cumsum(n)
        flat = values[np.repeat(starts[index] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        doc_ends = ends[cuts[1:] + np.arange(len(texts))] if len(texts) else np.zeros(0, np.int64)
        return flat, np.diff(np.concatenate([[0], doc_ends]))


@lru_cache(2)
def tokenizer_for(path: str, end_id: int) -> PieceTokenizer:
    """One for all tasks of a Python worker, so that its memory of pieces lasts."""
    return PieceTokenizer(path, end_id)


LASTING["rans"] = tokenizer_for.cache_clear


def runs(texts: list[str], chars: int = BATCH_CHARS) -> Iterator[slice]:
    """Slices of a batch with about so many characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (packed little-endian, u16 where the vocabulary allows) of each document."""
    narrow = Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 65536

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer_for(tokenizer_path, end_id)
        for batch in batches:
            texts = as_texts(batch.column(1))
            for part in runs(texts):
                flat, n = tok.ids(texts[part])
                data = flat.astype("<u2" if narrow else "<u4")
                at = np.concatenate([[0], np.cumsum(n)]) * data.itemsize
                ids = pa.Array.from_buffers(
                    pa.binary(), len(n), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)]
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part.start : part.stop], pa.array(n, pa.int64()), ids], ["doc_id", "n_tokens", "ids"]
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        tidy(run, "rans"), "doc_id long, n_tokens long, ids binary"
    )


def token_counts(tokens: DataFrame, vocab: int, width: str) -> np.ndarray:
    """Exact number of each id over all documents: histograms by task, summed by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, np.int64)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(b, width), minlength=vocab) if len(b) > 65536 else 0
            small = b"".join(b for b in batch.column(0).to_pylist() if len(b) <= 65536)
            total += np.bincount(np.frombuffer(small, width), minlength=vocab)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    counted = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(vocab, np.int64)
    for r in counted.collect():  # one row per id of the vocabulary at most
        out[r["id"]] = r["n"]
    return out


# --- the coder ----------------------------------------------------------------------------


def scaled(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 for every symbol that occurs."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.uint64)
    freq = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * (1 << bits) // total), 0).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    left = (1 << bits) - int(freq.sum())
    if left > 0:
        freq[order[0]] += left
    while left < 0:
        for i in order:
            take = min(-left, int(freq[i]) // 2)
            freq[i] -= take
            left += take
            if not left:
                break
    return freq.astype(np.uint64)


class Coder:
    """Encodes and decodes blocks with one shared frequency table."""

    def __init__(self, freq: np.ndarray, bits: int, lanes: int = 2048, interval: int = 64):
        self.freq, self.bits, self.lanes, self.interval = freq.astype(np.uint64), bits, lanes, interval
        self.cum = np.concatenate([[0], np.cumsum(self.freq)])[:-1].astype(np.uint64)
        self.symbol: np.ndarray | None = None

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = max(1, min(self.lanes, -(-n // 32)))
        steps = -(-n // lanes)
        x = np.full(lanes, LOW, np.uint64)
        bits, up, low32 = np.uint64(self.bits), np.uint64(63 - self.bits), np.uint64(0xFFFFFFFF)
        words: list[np.ndarray] = []
        marks: list[tuple[int, bytes]] = []
        written = 0
        for step in reversed(range(steps)):
            s = ids[step * lanes : (step + 1) * lanes]
            f, c, y = self.freq[s], self.cum[s], x[: len(s)]
            full = y >= f << up
            if full.any():
                words.append((y[full] & low32).astype(np.uint32))
                written += len(words[-1])
                y = np.where(full, y >> np.uint64(32), y)
            q = y // f
            x[: len(s)] = (q << bits) + (y - q * f) + c
            if step % self.interval == 0:
                marks.append((written, x.tobytes()))
        head = HEAD.pack(MAGIC, lanes, steps, n, self.bits, self.interval, written)
        # The decoder reads words from the last written one back: offsets count from there.
        places = b"".join(struct.pack("<I", written - w) + states for w, states in reversed(marks))
        return head + places + b"".join(w.tobytes() for w in reversed(words))

    def decode(self, payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of a block, from the checkpoint before start on."""
        magic, lanes, steps, n, bits, interval, written = HEAD.unpack_from(payload)
        if magic != MAGIC or bits != self.bits:
            raise ValueError("not a block of this coder")
        stop = n if stop is None else min(stop, n)
        if start >= stop:
            return np.zeros(0, np.uint32)
        if self.symbol is None:
            self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        mark = start // lanes // interval
        one = 4 + 8 * lanes
        count = -(-steps // interval)
        at = HEAD.size + mark * one
        pos = struct.unpack_from("<I", payload, at)[0]
        x = np.frombuffer(payload, "<u8", lanes, at + 4).copy()
        words = np.frombuffer(payload, "<u4", written, HEAD.size + count * one)
        shift, mask, low, w32 = np.uint64(bits), np.uint64((1 << bits) - 1), np.uint64(LOW), np.uint64(32)
        first = mark * interval
        last = -(-stop // lanes)
        out = np.empty((last - first) * lanes, np.uint32)
        for step in range(first, last):
            k = min(lanes, n - step * lanes)
            y = x[:k]
            slot = y & mask
            s = self.symbol[slot]
            out[(step - first) * lanes : (step - first) * lanes + k] = s
            y = self.freq[s] * (y >> shift) + slot - self.cum[s]
            short = np.flatnonzero(y < low)
            if len(short):
                y[short] = (y[short] << w32) | words[pos : pos + len(short)]
                pos += len(short)
            x[:k] = y
        return out[start - first * lanes : stop - first * lanes]


    def decode_block(self, payload: bytes) -> np.ndarray:
        """All ids of a block: the segments behind its checkpoints side by side, one vector step for all of them."""
        magic, lanes, steps, n, bits, interval, written = HEAD.unpack_from(payload)
        if magic != MAGIC or bits != self.bits:
            raise ValueError("not a block of this coder")
        if not n:
            return np.zeros(0, np.uint32)
        if self.symbol is None:
            self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        count = -(-steps // interval)
        one = 4 + 8 * lanes
        marks = np.frombuffer(payload, np.uint8, count * one, HEAD.size).reshape(count, one)
        pos = marks[:, :4].copy().view("<u4").ravel().astype(np.int64)
        x = marks[:, 4:].copy().view("<u8")
        words = np.frombuffer(payload, "<u4", written, HEAD.size + count * one)
        shift, mask, low, w32 = np.uint64(bits), np.uint64((1 << bits) - 1), np.uint64(LOW), np.uint64(32)
        out = np.empty((count, interval, lanes), np.uint32)
        for j in range(min(interval, steps)):
            live = count if (count - 1) * interval + j < steps else count - 1
            y = x[:live]
            slot = y & mask
            s = self.symbol[slot]
            out[:live, j] = s
            y = self.freq[s] * (y >> shift) + slot - self.cum[s]
            short = y < low
            if (live - 1) * interval + j == steps - 1:  # the last step may fill some lanes only
                short[-1, n - (steps - 1) * lanes :] = False
            row, lane = np.nonzero(short)
            if len(row):
                taken = short.sum(axis=1)
                before = np.concatenate([[0], np.cumsum(taken)[:-1]])
                y[row, lane] = (y[row, lane] << w32) | words[pos[row] + np.arange(len(row)) - before[row]]
                pos[:live] += taken
            x[:live] = y
        return out.reshape(-1)[:n]


# --- blocks -------------------------------------------------------------------------------

BLOCK_SCHEMA = (
    "part int, block int, start long, n_tokens long, doc_ids array<bigint>, doc_tokens array<bigint>, "
    "payload binary, crc32 long"
)


def write_blocks(tokens: DataFrame, coder: Coder, width: str, path: str, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode all documents in ascending id order and write the block dataset."""
    spark = tokens.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast((coder.freq, coder.bits))  # one entry per id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Coder(*shared.value)
        part = TaskContext.get().partitionId()
        block = start = held = 0
        ids: list[np.ndarray] = []
        docs: list[int | None] = []

        def flush() -> pa.RecordBatch:
            payload = own.encode(np.concatenate(ids))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([start], pa.int64()),
                    pa.array([held], pa.int64()),
                    pa.array([docs], pa.list_(pa.int64())),
                    pa.array([[len(x) for x in ids]], pa.list_(pa.int64())),
                    pa.array([payload], pa.binary()),
                    pa.array([zlib.crc32(payload)], pa.int64()),
                ],
                ["part", "block", "start", "n_tokens", "doc_ids", "doc_tokens", "payload", "crc32"],
            )

        for batch in batches:
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(np.frombuffer(b, width))
                docs.append(i)
                held += len(ids[-1])
                if held >= block_tokens:
                    yield flush()
                    block, start, held, ids, docs = block + 1, start + held, 0, [], []
        if ids:
            yield flush()

    (
        tokens.select("doc_id", "ids")
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "ids")
        .mapInArrow(run, BLOCK_SCHEMA)
        .write.option("compression", "none")
        .parquet(path)
    )


def encode(
    docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> Coder:
    """Tokenize docs, count all ids, and write the blocks to path. Returns the coder that reads them.

    Batches are set to BATCH_SIZE bytes in a session that has no sizes of its own.
    """
    short_batches(docs.sparkSession, size=BATCH_SIZE)
    vocab = Tokenizer.from_file(tokenizer_path).get_vocab_size()
    width = "<u2" if vocab <= 65536 else "<u4"
    tokens = materialise(tokenize(docs, tokenizer_path, end_id, id_col, text_col), "rans-ids", compression="zstd")
    bits = max(16, vocab.bit_length() + 4)
    coder = Coder(scaled(token_counts(tokens, vocab, width), bits), bits)
    write_blocks(tokens, coder, width, path)
    write_model(docs.sparkSession, coder, path)
    return coder


def write_model(spark: SparkSession, coder: Coder, path: str) -> None:
    """The shared frequencies beside the blocks: one row per id of the vocabulary, and one (id null) for the scale."""
    ids = np.flatnonzero(coder.freq)
    rows = pa.table({"id": pa.array([None, *ids.tolist()], pa.int64()), "freq": pa.array([len(coder.freq), *coder.freq[ids].tolist()], pa.int64()), "bits": pa.array([coder.bits] * (len(ids) + 1), pa.int32())})
    spark.createDataFrame(rows).coalesce(1).write.parquet(f"{path}/_model")


def read_model(spark: SparkSession, path: str) -> Coder:
    rows = spark.read.parquet(f"{path}/_model").collect()  # one row per id of the vocabulary
    size = next(r for r in rows if r["id"] is None)
    freq = np.zeros(size["freq"], np.uint64)
    for r in rows:
        if r["id"] is not None:
            freq[r["id"]] = r["freq"]
    return Coder(freq, size["bits"])


def read(spark: SparkSession, path: str, coder: Coder | None = None) -> DataFrame:
    """Documents of a block dataset: doc_id, start (ids before it), n_tokens, ids (u32 bytes), ids_crc32.

    Without a coder the dataset's own frequencies are loaded.
    """
    coder = coder or read_model(spark, path)
    blocks = spark.read.parquet(path)
    # One row per file of the dataset, not per block.
    ends = blocks.groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens")).alias("n")).collect()
    base: dict[int, int] = {}
    total = 0
    for r in sorted(ends, key=lambda r: r["part"]):
        base[r["part"]] = total
        total += r["n"]
    shared = spark.sparkContext.broadcast((coder.freq, coder.bits, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, bits, bases = shared.value
        own = Coder(freq, bits)
        for batch in batches:
            for row in batch.to_pylist():
                if zlib.crc32(row["payload"]) != row["crc32"]:
                    raise ValueError(f"checksum of block {row['part']}/{row['block']} is wrong")
                ids = own.decode_block(row["payload"]).astype("<u4")
                cut = np.concatenate([[0], np.cumsum(row["doc_tokens"])]).astype(np.int64)
                texts = [ids[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(cut[:-1] + (bases[row["part"]] + row["start"])),
                        pa.array(row["doc_tokens"], pa.int64()),
                        pa.array(texts, pa.binary()),
                        pa.array([zlib.crc32(t) for t in texts], pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids", "ids_crc32"],
                )

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def new_path(spark: SparkSession) -> str:
    return shared_dir(spark, "rans-blocks")
