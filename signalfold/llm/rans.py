"""Token ids in a range-coded binary format (static rANS).

A file row is one shard: whole documents in doc_id order, up to about SHARD_IDS ids. Its payload holds one
frequency table, shared by the shard's blocks, and independent blocks of up to BLOCK_IDS ids. A block is
LANES interleaved coders with 64-bit states and 32-bit words; id number i belongs to lane i mod LANES (a block of fewer
ids has a lane for each STEPS of them), so numpy advances all lanes at once. A block's header has its id count, the CRC-32 of its ids and
checkpoints: every CHECKPOINT steps the word offset and the lane states, from each of which decoding can
start, so parts of a block can be decoded in parallel too. Spark writes and reads the rows as Parquet: lost tasks
are repeated and commit once, and any store that Spark reads will do.

Layout, little-endian: b"RANS", u32 version, u32 bytes of the packed table, u32 blocks; the table (zlib: ids as
u32, then frequencies as u32, which sum to 2^SCALE); for each block u32 ids, u32 CRC-32, u32 checkpoints,
u32 words, u32 lanes, then the checkpoints (u32 step, u32 word, a u64 state for each lane), then the words.

Defined cases: a null text is empty and holds the end id alone; doc_id may be of any type with an order, and integers of any
width count as long; null doc_ids come first, equal doc_ids in order of their text; an empty table makes no shard and an empty
result; a document longer than a shard has one of its own; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
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
from pyspark.sql import types as T

from signalfold.llm.bpe import RunTable, byte_alphabet, encoded
from signalfold.llm.store import ship, slices

MAGIC, VERSION = b"RANS", 2
SCALE, LANES, STEPS, BLOCK_IDS, SHARD_IDS, CHECKPOINT = 20, 4096, 32, 1 << 20, 1 << 22, 128
LOW = np.uint64(1 << 31)


def _shard(kind: str) -> str:
    """Columns of a shard of documents whose doc_id has this type."""
    return f"part int, seq int, n_ids long, doc_ids array<{kind}>, counts array<int>, payload binary"


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their frequencies, each at least 1, with sum 2^SCALE."""
    seen, n = np.unique(ids, return_counts=True)
    total = 1 << SCALE
    if len(seen) > total // 2:
        raise ValueError("more distinct ids than the table can hold")
    freq = 1 + (n * ((total - len(seen)) / n.sum())).astype(np.int64)
    freq[np.argmax(freq)] += total - freq.sum()
    return seen.astype(np.uint32), freq.astype(np.uint32)


def _encode_block(ids: np.ndarray, freq: np.ndarray, cum: np.ndarray, limit: np.ndarray) -> bytes:
    lanes = min(LANES, -(-len(ids) // STEPS))
    steps = -(-len(ids) // lanes)
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, np.ndarray]] = []
    written = 0
    for s in range(steps - 1, -1, -1):
        row = ids[s * lanes:(s + 1) * lanes]
        y, f = x[:len(row)], freq[row]
        full = y >= limit[row]
        if full.any():
            out = (y[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            words.append(out)
            written += len(out)
            y[full] >>= np.uint64(32)
        q = y // f
        y[:] = (q << np.uint64(SCALE)) + (y - q * f) + cum[row]
        if s % CHECKPOINT == 0:
            marks.append((s, written, x.copy()))
    stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    head = struct.pack("<5I", len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(marks), len(stream), lanes)
    rows = b"".join(struct.pack("<2I", s, written - w) + st.astype("<u8").tobytes() for s, w, st in reversed(marks))
    return head + rows + stream.astype("<u4").tobytes()


class Table:
    def __init__(self, seen: np.ndarray, freq: np.ndarray):
        self.seen, self.freq = seen, freq.astype(np.uint64)
        self.cum = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.limit = ((LOW >> np.uint64(SCALE)) << np.uint64(32)) * self.freq

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.seen), dtype=np.uint32), self.freq.astype(np.int64))


def encode_shard(ids: np.ndarray) -> bytes:
    seen, freq = frequencies(ids)
    t = Table(seen, freq)
    place = np.zeros(int(seen[-1]) + 1, np.uint32)
    place[seen] = np.arange(len(seen))
    freq_of, cum_of, limit_of = (np.zeros(len(place), np.uint64) for _ in range(3))
    freq_of[seen], cum_of[seen], limit_of[seen] = t.freq, t.cum, t.limit
    blocks = [_encode_block(ids[i:i + BLOCK_IDS], freq_of, cum_of, limit_of) for i in range(0, len(ids), BLOCK_IDS)]
    packed = zlib.compress(seen.astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 3)
    return MAGIC + struct.pack("<3I", VERSION, len(packed), len(blocks)) + packed + b"".join(blocks)


class ShardReader:
    """Random access to the blocks of a payload, and to the checkpoints of a block."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a shard of this format")
        version, packed, n = struct.unpack_from("<3I", payload, 4)
        if version != VERSION:
            raise ValueError(f"unknown version {version}")
        both = np.frombuffer(zlib.decompress(payload[16:16 + packed]), "<u4")
        self.table = Table(both[:len(both) // 2], both[len(both) // 2:])
        self.slots, self.payload, self.blocks, at = self.table.slots(), payload, [], 16 + packed
        for _ in range(n):
            ids, crc, marks, words, lanes = struct.unpack_from("<5I", payload, at)
            self.blocks.append((at + 20, ids, crc, marks, words, lanes))
            at += 20 + marks * (8 + 8 * lanes) + 4 * words

    def part(self, block: int, mark: int) -> np.ndarray:
        """The ids from one checkpoint to the next."""
        at, n, _, marks, words, lanes = self.blocks[block]
        each = 8 + 8 * lanes
        step, pos = struct.unpack_from("<2I", self.payload, at + mark * each)
        x = np.frombuffer(self.payload, "<u8", lanes, at + mark * each + 8).astype(np.uint64)
        stream = np.frombuffer(self.payload, "<u4", words, at + marks * each)
        stop = min(step + CHECKPOINT, -(-n // lanes))
        t, out = self.table, np.empty(min(stop * lanes, n) - step * lanes, np.uint32)
        mask, shift = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
        for s in range(step, stop):
            y = x[:min(lanes, n - s * lanes)]
            low = y & mask
            k = self.slots[low]
            out[(s - step) * lanes:(s - step) * lanes + len(y)] = k
            y[:] = t.freq[k] * (y >> shift) + low - t.cum[k]
            need = y < LOW
            c = int(np.count_nonzero(need))
            if c:
                y[need] = (y[need] << np.uint64(32)) | stream[pos:pos + c]
                pos += c
        return t.seen[out]

    def block(self, i: int) -> np.ndarray:
        _, _, crc, marks, _, _ = self.blocks[i]
        ids = np.concatenate([self.part(i, m) for m in range(marks)])
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i}: checksum differs")
        return ids

    def ids(self) -> np.ndarray:
        return np.concatenate([self.block(i) for i in range(len(self.blocks))]) if self.blocks else np.empty(0, np.uint32)


# -- tokens through the library -----------------------------------------------------------------------
class LibraryEncoder:
    """The library's ids of many texts. It encodes each distinct run without white space apart, once while the bounded table
    keeps it; words of a plain run, which normalising and splitting leave as they are, go to its model directly."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.model, self.shown = self.library.model, dict(enumerate(byte_alphabet()))
        self.table = RunTable(self._words, self._others)

    def _words(self, words: list[str]) -> list[bytes]:
        shown = [w if w.isascii() else w.encode().decode("latin-1").translate(self.shown) for w in words]
        return [array("H", [t.id for t in self.model.tokenize(w)]).tobytes() for w in shown]

    def _others(self, runs: list[str]) -> list[bytes]:
        return [array("H", x.ids).tobytes() for x in self.library.encode_batch_fast(runs, add_special_tokens=False)]

    def _alone(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2")

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, and where each text's end after a leading 0."""
        return encoded(self.table, texts, self.special, self._alone)


@lru_cache(maxsize=1)
def _library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_ids(docs: DataFrame, vocabulary: str, out: str, end_id: int = 1) -> None:
    """Encode docs (doc_id, text), add end_id to each and write shards in order of doc_id under `out`."""
    ship(docs.sparkSession)
    parts = max(1, docs.rdd.getNumPartitions())
    own = docs.schema["doc_id"].dataType
    kind = "bigint" if isinstance(own, T.IntegralType) else own.simpleString()
    rows = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), "text")
    ordered = rows.repartitionByRange(parts, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    types = {"part": pa.int32(), "seq": pa.int32(), "n_ids": pa.int64(), "doc_ids": None, "counts": pa.list_(pa.int32()), "payload": pa.binary()}

    def shards(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = _library(vocabulary), TaskContext.get().partitionId(), 0
        ids, doc_ids, counts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            row = {"part": part, "seq": seq, "n_ids": held, "doc_ids": pa.concat_arrays(doc_ids), "counts": np.concatenate(counts), "payload": encode_shard(np.concatenate(ids))}
            kinds = types | {"doc_ids": pa.list_(doc_ids[0].type)}
            return pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in kinds.items()], names=list(kinds))

        for whole in it:
            for b in slices(whole, 1):
                flat, ends = encoder.batch(b.column(1))
                flat = np.insert(flat, ends[1:], end_id)
                ends = ends + np.arange(len(ends))
                first = 0
                while first < b.num_rows:
                    # As many more documents as the shard takes; one at least if it is empty.
                    stop = int(np.searchsorted(ends, ends[first] + SHARD_IDS - held, side="right")) - 1
                    stop = max(stop, first + (not held))
                    if stop > first:
                        ids.append(flat[ends[first]:ends[stop]])
                        doc_ids.append(b.column(0).slice(first, stop - first))
                        counts.append(np.diff(ends[first:stop + 1]).astype(np.int32))
                        held += int(ends[stop] - ends[first])
                    if stop < b.num_rows:
                        yield flush()
                        ids, doc_ids, counts, held, seq = [], [], [], 0, seq + 1
                    first = stop
        if held:
            yield flush()

    ordered.mapInArrow(shards, _shard(kind)).write.parquet(out)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the shards at `path`: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    ship(spark)
    shards = spark.read.parquet(path)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    # Offsets: one row for each task that wrote, summed in order of the tasks.
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    firsts, at = [], 0
    for r in totals:
        firsts.append((r.part, at))
        at += r.n
    first = spark.createDataFrame(firsts, "part int, first long")
    inside = shards.select("part", "seq", "n_ids").alias("a").join(shards.select("part", "seq", "n_ids").alias("b"), (F.col("a.part") == F.col("b.part")) & (F.col("b.seq") < F.col("a.seq")), "left")
    offset = inside.groupBy("a.part", "a.seq").agg(F.coalesce(F.sum("b.n_ids"), F.lit(0)).alias("before"))
    offset = offset.join(F.broadcast(first), "part").select("part", "seq", (F.col("before") + F.col("first")).alias("start"))
    made = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def documents(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in range(b.num_rows):
                start, counts, payload = (b.column(c)[r].as_py() for c in (0, 2, 3))
                ids, n = ShardReader(payload).ids(), np.array(counts, np.int64)
                ends = np.cumsum(n)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - c):4 * e]) for e, c in zip(ends.tolist(), counts, strict=True)]
                cols = [b.column(1)[r].values, pa.array(start + ends - n, pa.int64()), pa.array(n), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    joined = shards.join(F.broadcast(offset) if at < 1 << 40 else offset, ["part", "seq"])
    return joined.select("start", "doc_ids", "counts", "payload").mapInArrow(documents, made)
