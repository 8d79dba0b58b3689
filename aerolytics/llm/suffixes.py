"""Byte-level suffix deduplication by column-wise multi-document construction.

Inserting one symbol per document and round into a collection's Burrows-Wheeler
transform takes as many rounds as the longest document has bytes, each over the
whole transform. Two steps keep the method and bound the rounds:

* Every string of the repeat length holds an anchor, the smallest hash of its
  short substrings. Equal strings have equal anchors at equal offsets, so the
  text around anchors, aligned at them, is the collection. The strings over an
  anchor fall into a few cells by their start; all strings of a cell share a
  core of several hundred bytes, and only cores found twice in the corpus go on.
  A segment of the collection is the core, as one symbol (its 128-bit hash),
  with the margins before and after it.
* The collection is built column by column from the right: each round inserts
  one symbol per segment, keeps the order of all segments' suffixes and updates
  the common prefixes of neighbours from those of the round before. The symbols
  of a round, in suffix order, are that column of the transform; they are read
  from sequential external column files. Suffixes of one column are all that a
  repeat can match, because of the alignment.

A string whose neighbour shares the whole repeat length is removed.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolytics.llm.blocks import Keys, answered, flagged, packed, slice_bits, unpacked

REPEAT_BYTES = 400
#: Bytes of the substrings that compete to be anchors.
ANCHOR_BYTES = 32
#: Window starts hashed at once.
PIECE = 1 << 18
#: Cores a slice counts, and segments a task builds, on average.
SLICE_CORES = 1 << 20
TASK_SEGMENTS = 1 << 17
#: Strings over an anchor by start, in so many cells.
CELLS = 2
#: A core found so often is dealt in finer cells of so many starts: their longer
#: cores part what only shares the passage, and their margins are a few bytes.
HEAVY_CORE = 1 << 11
FINE_STARTS = 8
# Fixed value: odd multiplier of the rolling hash (modulo 2^64).
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _POWERS[base] = have
    return have[:n]


def _rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Mixed polynomial hash of every substring of ``width`` bytes."""
    n = len(data) - width + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(data)), out=sums[1:])
    h = (sums[width:] - sums[:n]) * _powers(pow(BASE, -1, 1 << 64), n)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def anchors(texts: list[bytes], repeat: int = REPEAT_BYTES, width: int = ANCHOR_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(position in the joined texts, hash) of every anchor, ascending.

    Every ``repeat`` bytes inside a text give their leftmost least substring.
    """
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    span = repeat - width + 1
    low = np.uint64(PIECE * 2 - 1)
    found_at, found_hash = [], []
    valid = np.ones(max(0, len(data) - repeat + 1), bool)
    for e in ends[:-1].tolist():
        valid[max(0, e - repeat + 1):e] = False
    for at in range(0, len(valid), PIECE):
        good = valid[at:at + PIECE]
        if not good.any():
            continue
        h = _rolling(data[at:at + len(good) + repeat - 1], width)
        # The position breaks ties to the left, alike wherever the string stands.
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        covered = 1
        while covered * 2 <= span:
            least = np.minimum(least[:-covered], least[covered:])
            covered *= 2
        rest = span - covered
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        at_piece = np.unique((least & low).astype(np.int64)[good])
        found_at.append(at_piece + at)
        found_hash.append(h[at_piece])
    if not found_at:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    positions, hashes = np.concatenate(found_at), np.concatenate(found_hash)
    positions, first = np.unique(positions, return_index=True)
    return positions, hashes[first]


def cells_of(first: int, last: int, starts: int) -> list[int]:
    """First starts of cells of ``starts`` starts that cover first..last; the last cell may overlap."""
    return [min(f, last - starts + 1) for f in range(first, last + 1, starts)]


def column_rounds(groups: np.ndarray, low: np.ndarray, high: np.ndarray, column, width: int, starts: int,
                  repeat: int) -> Iterator[tuple[int, np.ndarray]]:
    """Right-to-left construction over aligned segments; yields (column, repeated segments).

    ``column(j)`` gives the symbols of column j; a segment has symbols in
    [low, high). ``order`` holds the segments by group and suffix, ``common``
    the prefix length shared with the segment before. A round's symbols taken
    in that order are the transform's column; sorting them stably gives the
    next order, and the common prefix of two that stay neighbours by symbol is
    one more than the least among those between them before.
    """
    order = np.argsort(groups, kind="stable")
    common = np.zeros(len(order), np.int32)
    for j in range(width - 1, -1, -1):
        symbol = column(j)[order].astype(np.int64)
        inside = (low[order] <= j) & (j < high[order])
        symbol[~inside] = 256
        key = groups[order].astype(np.int64) * 257 + symbol
        moved = np.argsort(key, kind="stable")
        sorted_key = key[moved]
        joined = np.flatnonzero((sorted_key[1:] == sorted_key[:-1]) & (symbol[moved][1:] < 256)) + 1
        now = np.zeros(len(order), np.int32)
        if len(joined):
            between = np.empty(2 * len(joined), np.int64)
            between[::2], between[1::2] = moved[joined - 1] + 1, moved[joined] + 1
            now[joined] = np.minimum.reduceat(np.append(common, 0), between)[::2] + 1
        order, common = order[moved], np.minimum(now, repeat)
        if j < starts:
            full = np.append(common, 0) >= repeat
            yield j, order[full[:-1] | full[1:]]


def packed_positions(at: list[int]) -> bytes:
    """Ascending positions in a block in few bytes: one alone as 4 bytes, more as a width, the first and the gaps."""
    if len(at) == 1:
        return at[0].to_bytes(4, "little")
    gaps = np.diff(np.array(at, np.int64))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return (bytes([width]) + at[0].to_bytes(4, "little")
            + np.ascontiguousarray(gaps.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes())


def unpacked_positions(blob: bytes) -> np.ndarray:
    if len(blob) == 4:
        return np.array([int.from_bytes(blob, "little")], np.int64)
    width, n = blob[0], (len(blob) - 5) // blob[0]
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(blob, np.uint8, n * width, 5).reshape(n, width)
    return int.from_bytes(blob[1:5], "little") + np.append(0, np.cumsum(gaps.view("<i8").reshape(-1)))


def _shaped(margin: int, low: int, high: int) -> int:
    """Margin and the first and last column of a segment in one number."""
    return margin << 40 | low << 20 | high


def _unshaped(shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return shape >> 40, shape >> 20 & 0xFFFFF, shape & 0xFFFFF


class _Rounds:
    """The segments of one margin in a task: an external column file and what is needed per segment.

    Segments are written column by column per batch, and each round reads its
    column front to back; memory holds the order and the result bits.
    """

    def __init__(self, margin: int):
        self.margin, self.file = margin, tempfile.TemporaryFile()
        self.batches: list[tuple[int, int]] = []
        self.meta: list[tuple] = []

    def add(self, batch: pa.RecordBatch) -> None:
        n, width = batch.num_rows, 2 * self.margin
        one, two, shape = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "key2", "shape"))
        _, low, high = _unshaped(shape)
        columns = np.zeros((n, width), np.uint8)
        for i, segment in enumerate(batch.column("segment").to_pylist()):
            columns[i, low[i]:high[i]] = np.frombuffer(segment, np.uint8)
        self.batches.append((self.file.tell(), n))
        self.file.write(np.ascontiguousarray(columns.T).tobytes())
        self.meta.append((one, two, low, high, batch.column("block_id"), batch.column("positions")))

    def column(self, j: int) -> np.ndarray:
        parts = []
        for offset, n in self.batches:
            self.file.seek(offset + j * n)
            parts.append(np.frombuffer(self.file.read(n), np.uint8))
        return np.concatenate(parts)

    def repeated(self) -> Iterator[pa.RecordBatch]:
        """Batches (block_id, positions, starts as bits) of the segments that repeat."""
        one, two, low, high = (np.concatenate([m[i] for m in self.meta]) for i in range(4))
        order = np.lexsort((two, one))
        new = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        # A segment that its block holds at several positions repeats as a whole.
        many = np.concatenate([pc.binary_length(m[5]).to_numpy(zero_copy_only=False) > 4 for m in self.meta])
        starts = self.margin + 1
        bits = np.zeros((len(group), (starts + 7) // 8), np.uint8)

        def mark(j: int, segments: np.ndarray) -> None:
            bits[segments, j >> 3] |= np.uint8(1 << (j & 7))

        for j, segments in column_rounds(group, low, high, self.column, 2 * self.margin, starts, self.margin):
            mark(j, segments)
            mark(j, np.flatnonzero(many & (low <= j) & (j + self.margin <= high)))
        if not self.margin:  # the core is the string
            mark(0, np.flatnonzero(many | (np.bincount(group)[group] > 1)))
        hit, done = bits.any(1), 0
        for m in self.meta:
            rows = np.flatnonzero(hit[done:done + len(m[0])])
            yield pa.RecordBatch.from_arrays(
                [m[4].take(pa.array(rows)), m[5].take(pa.array(rows)),
                 pa.array([b.tobytes() for b in bits[done + rows]], pa.binary())], ["block_id", "positions", "starts"])
            done += len(m[0])
        self.file.close()


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat: int = REPEAT_BYTES,
                   heavy: int = HEAVY_CORE) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end in bytes), kept.

    A byte goes if a string of ``repeat`` bytes over it starts anywhere else
    too, in the same text or another; overlaps count, and strings are judged on
    the input. Matches never cross texts. Null, empty and shorter texts keep
    everything. Repeated rows remove each other, null ids are kept as they are,
    and no other column is read. ``kept`` is binary: a cut may split a character.
    """
    blocks = packed(docs, id_col, text_col)
    spark, width = docs.sparkSession, ANCHOR_BYTES if repeat >= 2 * ANCHOR_BYTES else max(1, repeat // 4)
    left = repeat - width  # bytes before an anchor, and the last start that holds it
    n_bytes = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    n_cores = CELLS * (1 + 2 * n_bytes // (left + 2))
    bits = slice_bits(spark, n_cores, SLICE_CORES)
    starts = -(-(left + 1) // CELLS)
    firsts, fine = cells_of(0, left, starts), min(FINE_STARTS, starts)

    def cores(texts: list[bytes]) -> tuple[bytes, list[tuple]]:
        """The joined texts, and (text begin, text end, cell start, its first start, core digest) per anchor and cell."""
        data, found = b"".join(texts), []
        ends = np.cumsum([len(t) for t in texts])
        at = anchors(texts, repeat, width)[0]
        text_of = np.searchsorted(ends, at, side="right")
        upper = ends[text_of].tolist()
        lower = (ends - [len(t) for t in texts])[text_of].tolist()
        digest = xxhash.xxh3_128_intdigest
        for p, begin, end in zip(at.tolist(), lower, upper):
            for first in firsts:
                a = p - left + first
                # Some string of the cell lies in the text; then its core does.
                if max(a, begin) + repeat <= min(a + starts - 1 + repeat, end):
                    found.append((begin, end, a, first, digest(data[a + starts - 1:a + repeat], first)))
        return data, found

    def keys_of(texts: list[bytes]) -> Keys:
        return Keys(np.array([c[4] & _MASK for c in cores(texts)[1]], np.uint64))

    marked = answered(blocks, keys_of, bits, heavy=heavy)
    fields = ["key", "key2", "block_id", "positions", "shape", "segment"]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Margins around cores that stand elsewhere too: once per block and content, with all positions."""
        for batch in batches:
            for r in range(batch.num_rows):
                block_id, ids, payload, flags = (c[r].as_py() for c in batch.columns)
                data, of_block = cores(unpacked(ids, payload))
                keys, found = Keys(np.array([c[4] & _MASK for c in of_block], np.uint64)), {}
                heavy_key = flagged(keys, flags, bits, "heavy")
                for k in np.flatnonzero(flagged(keys, flags, bits)).tolist():
                    begin, end, cell, first, core = of_block[k]
                    parts = [(cell, starts - 1, core)]
                    if heavy_key[k]:
                        parts = [(a, fine - 1, None) for a in cells_of(cell, cell + starts - 1, fine)]
                    for a, margin, core in parts:
                        lo, hi = max(a, begin), min(a + margin + repeat, end)
                        if lo + repeat > hi:
                            continue
                        if core is None:
                            core = xxhash.xxh3_128_intdigest(data[a + margin:a + repeat], a - cell + (first + 1 << 20))
                        text = data[lo:a + margin] + data[a + repeat:hi]
                        found.setdefault((core, _shaped(margin, lo - a, hi - a - repeat + margin), text), []).append(a + repeat)  # a cell may begin before its block
                rows = list(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array([x[0] & _MASK for x in rows], np.uint64).view(np.int64)),
                     pa.array(np.array([x[0] >> 64 for x in rows], np.uint64).view(np.int64)),
                     pa.array([block_id] * len(rows), pa.int64()),
                     pa.array([packed_positions(sorted(v)) for v in found.values()], pa.binary()),
                     pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.binary())], fields)

    def rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_margin: dict[int, _Rounds] = {}
        for batch in batches:
            margins = _unshaped(batch.column("shape").to_numpy(zero_copy_only=False))[0]
            for m in np.unique(margins).tolist():
                by_margin.setdefault(m, _Rounds(m)).add(batch.take(pa.array(np.flatnonzero(margins == m))))
        for group in by_margin.values():
            yield from group.repeated()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_cores // TASK_SEGMENTS)
    found = (marked.where("flags is not null").select("block_id", "ids", "payload", "flags")
             .mapInArrow(segments, "key long, key2 long, block_id long, positions binary, shape long, segment binary"))
    repeats = found.repartition(parts, "key").mapInArrow(rounds, "block_id long, positions binary, starts binary")
    # A block's list is bounded by its anchors and cells.
    per_block = repeats.groupBy("block_id").agg(F.collect_list(F.struct("positions", "starts")).alias("hits"))
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for r in range(batch.num_rows):
                ids, payload, hits = (c[r].as_py() for c in batch.columns)
                texts = unpacked(ids, payload)
                starts = np.zeros(sum(map(len, texts)) + 1, bool)
                for h in hits or []:
                    offsets = np.flatnonzero(np.unpackbits(np.frombuffer(h["starts"], np.uint8), bitorder="little"))
                    positions = unpacked_positions(h["positions"]) - repeat
                    if len(positions) < len(offsets):
                        for p in positions:
                            starts[p + offsets] = True
                    else:
                        for o in offsets:
                            starts[positions + o] = True
                out, begin = [], 0
                for text in texts:
                    mine = np.flatnonzero(starts[begin:begin + len(text)])
                    begin += len(text)
                    # Runs of starts closer than the length touch or overlap.
                    gap = np.flatnonzero(np.diff(mine) > repeat)
                    a = mine[np.concatenate([[0], gap + 1])] if len(mine) else mine
                    b = mine[np.concatenate([gap, [len(mine) - 1]])] + repeat if len(mine) else mine
                    cuts = [0, *np.column_stack([a, b]).ravel().tolist(), len(text)]
                    kept = b"".join([text[x:y] for x, y in zip(cuts[::2], cuts[1::2])])
                    out.append((len(text), len(text) - len(kept), len(a), hashlib.sha256(kept).hexdigest(),
                                [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())], kept))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, kind), *[pa.array(columns[i], pa.int64()) for i in range(3)],
                     pa.array(columns[3], pa.string()), pa.array(columns[4], spans_type),
                     pa.array(columns[5], pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return (blocks.join(per_block, "block_id", "left").select("ids", "payload", "hits")
            .mapInArrow(apply, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                               "spans array<struct<start:long,end:long>>, kept binary"))
