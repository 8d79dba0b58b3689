"""Documents packed into immutable blocks, so that two passes see the same order.

A pass over a block sends per-slice summaries to a shuffle; what comes back is
joined to the block by its id and applied to the same documents in the same
order. Blocks are stored compressed, so carrying them costs less than the texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolytics.llm.common import raw_bytes, stored

#: Text bytes of a block; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20


def packed(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Stored rows (block_id, n_bytes, ids array, payload); null texts count as empty."""
    id_type = docs.schema[id_col].dataType
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        kind = None

        def block(ids: list, texts: list[bytes]) -> pa.RecordBatch:
            lengths = np.array([len(t) for t in texts], "<i8")
            payload = compress(lengths.tobytes() + b"".join(texts))
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().int >> 65]), pa.array([int(lengths.sum())], pa.int64()),
                 pa.array([ids], pa.list_(kind)), pa.array([payload], pa.binary())],
                ["block_id", "n_bytes", "ids", "payload"])

        ids, texts, size = [], [], 0
        for batch in batches:
            kind = batch.column(0).type
            for i, t in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1))):
                t = t or b""
                if ids and size + len(t) > block_bytes:
                    yield block(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids:
            yield block(ids, texts)

    return stored(source.mapInArrow(pack, f"block_id long, n_bytes long, ids array<{id_type.simpleString()}>, "
                                          "payload binary"), "blocks")


def unpacked(ids: list, payload: bytes) -> list[bytes]:
    """The texts of a block in their order."""
    raw = zstandard.ZstdDecompressor().decompress(payload)
    lengths = np.frombuffer(raw, "<i8", len(ids))
    ends = len(ids) * 8 + np.cumsum(lengths)
    return [raw[e - n:e] for e, n in zip(ends.tolist(), lengths.tolist())]


class Keys:
    """Distinct keys of a block in order, and the place of each occurrence among them.

    A key is the top ``high_bits`` of a 64-bit hash and an optional 32-bit check.
    """

    def __init__(self, high: np.ndarray, low: np.ndarray | None = None, high_bits: int = 64):
        high = high >> np.uint64(64 - high_bits)
        low = np.zeros(len(high), np.uint32) if low is None else low
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        new = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))[:len(high)]
        at = np.flatnonzero(new)
        self.place = np.empty(len(order), np.int32)
        self.place[order] = np.cumsum(new) - 1
        self.high, self.low, self.high_bits = high[at], low[at], high_bits
        self.counts = np.diff(np.append(at, len(order)))
        self.many = self.counts > 1

    def runs(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(slices that hold a key, edges of their keys): of 2^bits equal slices of the key range, only those met."""
        if not len(self.high):
            return np.empty(0, np.int64), np.zeros(1, np.int64)
        of = (self.high >> np.uint64(self.high_bits - bits)).astype(np.int64)
        starts = np.append(0, np.flatnonzero(np.diff(of)) + 1)
        return of[starts], np.append(starts, len(of))

    def messages(self, bits: int, with_check: bool, with_counts: bool) -> tuple[np.ndarray, pa.Array]:
        """(slice, message) for every slice met; the work follows the keys, however many slices there are.

        A message is the byte width of its gaps, the gaps (the first from the
        slice's start), checks and counts if asked for, and a bit per key for
        those found twice here.
        """
        slices, edges = self.runs(bits)
        n, sizes = len(self.high), np.diff(edges)
        run = np.repeat(np.arange(len(slices)), sizes)
        place = np.arange(n) - edges[run]
        base = (slices.astype(np.uint64) << np.uint64(self.high_bits - bits)) if len(slices) else np.empty(0, np.uint64)
        gaps = np.where(place == 0, self.high - base[run], np.diff(self.high, prepend=self.high[:1]))
        width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if n else 1
        fields = [gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]]
        fields += [v.astype("<u4").view(np.uint8).reshape(-1, 4)
                   for v, sent in ((self.low, with_check), (self.counts, with_counts)) if sent]
        row = sum(f.shape[1] for f in fields)
        starts = np.cumsum(np.append(0, 1 + sizes * row + (sizes + 7) // 8))
        out = np.zeros(int(starts[-1]), np.uint8)
        out[starts[:-1]] = width
        at = starts[run] + 1
        for f in fields:
            out[(at + place * f.shape[1])[:, None] + np.arange(f.shape[1])] = f
            at = at + sizes[run] * f.shape[1]
        twice = np.flatnonzero(self.many)
        np.add.at(out, at[twice] + (place[twice] >> 3), (128 >> (place[twice] & 7)).astype(np.uint8))
        return slices, pa.Array.from_buffers(pa.large_binary(), len(slices), [
            None, pa.py_buffer(starts.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())])


def _received(blob: bytes, start: int, with_check: bool, with_counts: bool) -> tuple[np.ndarray, ...]:
    """Keys, checks, marks and counts of a message to the slice that begins at ``start``."""
    width = blob[0]
    row = width + 4 * with_check + 4 * with_counts
    n = 8 * (len(blob) - 1) // (8 * row + 1)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(blob, np.uint8, n * width, 1).reshape(n, width)
    at = 1 + n * width
    low = np.frombuffer(blob, "<u4", n, at) if with_check else np.zeros(n, np.uint32)
    at += 4 * n * with_check
    counts = np.frombuffer(blob, "<u4", n, at) if with_counts else np.ones(n, np.uint32)
    many = np.unpackbits(np.frombuffer(blob, np.uint8, (n + 7) // 8, at + 4 * n * with_counts), count=n)
    return np.cumsum(gaps.view("<u8").reshape(-1)) + np.uint64(start), low, many.astype(bool), counts


def answered(blocks: DataFrame, keys_of, slice_bits: int, with_check: bool = False, heavy: int | None = None,
             high_bits: int = 64) -> DataFrame:
    """``blocks`` with ``flags``: per slice, bits that tell which of the block's keys stand elsewhere.

    ``keys_of(texts)`` gives a block's Keys. Every block sends each slice its
    distinct keys once, so a key held by any share of the rows adds one entry
    per block. ``high_bits`` is that of the Keys. A slice answers with a bit per key for "found again in the
    corpus" and, if ``heavy`` is given, one for "found ``heavy`` times or more".
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block_id, ids, payload = (c[r].as_py() for c in batch.columns)
                slices, messages = keys_of(unpacked(ids, payload)).messages(slice_bits, with_check, heavy is not None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slices, pa.int32()), pa.array(np.full(len(slices), block_id), pa.int64()),
                     messages.cast(pa.binary())], ["slice", "block_id", "keys"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        start = int(pdf["slice"].iloc[0]) << high_bits - slice_bits
        parts = [_received(b, start, with_check, heavy is not None) for b in pdf["keys"]]
        high, low, many, counts = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((low, high))
        new = np.append(True, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1]))
        first, of = np.flatnonzero(new), np.cumsum(new) - 1
        holders, found = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        holders[order] = np.diff(np.append(first, len(order)))[of]
        found[order] = np.add.reduceat(counts[order].astype(np.int64), first)[of]
        ends = np.cumsum([len(p[0]) for p in parts])
        bits = [[np.packbits(x[e - len(p[0]):e]).tobytes() for e, p in zip(ends, parts)]
                for x in (many | (holders > 1), found >= (heavy or 1 << 62))]
        return pd.DataFrame({"slice": pdf["slice"], "block_id": pdf["block_id"], "again": bits[0], "heavy": bits[1]})

    sent = blocks.select("block_id", "ids", "payload").mapInArrow(send, "slice int, block_id long, keys binary")
    answers = sent.groupBy("slice").applyInPandas(count, "slice int, block_id long, again binary, heavy binary")
    # At most one entry per slice, so a block's list is as long as there are slices.
    flags = answers.groupBy("block_id").agg(F.collect_list(F.struct("slice", "again", "heavy")).alias("flags"))
    return blocks.join(flags, "block_id", "left")


def flagged(keys: Keys, flags: list | None, slice_bits: int, name: str = "again") -> np.ndarray:
    """Per occurrence in the block: the answer's bit for its key."""
    out = np.zeros(len(keys.high), bool)
    if flags:
        slices, edges = keys.runs(slice_bits)
        run = np.searchsorted(slices, np.fromiter((f["slice"] for f in flags), np.int64, len(flags)))
        sizes = np.diff(edges)[run]
        bits = np.unpackbits(np.frombuffer(b"".join([f[name] for f in flags]), np.uint8))
        # Every answer begins at a byte of its own.
        starts = np.cumsum(np.append(0, (sizes + 7) // 8))[:-1] * 8
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(edges[run], sizes) + inner] = bits[np.repeat(starts, sizes) + inner] > 0
    return out[keys.place]


def slice_bits(spark, n_keys: int, per_slice: int) -> int:
    """Bits for enough slices that one holds ``per_slice`` keys on average, and no fewer than shuffle partitions."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, (max(n_keys // per_slice, parts) - 1).bit_length())
