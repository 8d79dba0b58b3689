"""Substring deduplication over word windows.

Every window of a fixed number of words gets a Rabin-Karp hash. Blocks of
documents send their sorted hashes to the slices of the hash range, a slice
counts how often each occurs in the corpus and answers every block with one
bit per hash; runs of repeated windows are the maximal removal intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolytics.llm.blocks import Keys, answered, flagged, packed, slice_bits, unpacked

WINDOW_WORDS = 35
#: Windows a slice holds on average, which bounds the memory of its count.
SLICE_WINDOWS = 1 << 19
#: Bytes of text per window assumed when the number of slices is set.
BYTES_PER_WINDOW = 6
# Odd multipliers of the two rolling hashes (modulo 2^64).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class WindowHash:
    """Rabin-Karp hashes of all windows of a word sequence, from prefix sums modulo 2^64.

    sum(w[i + k] B^k) is (S[i + n] - S[i]) B^-i with S the prefix sums of
    w[j] B^j. A word enters as its XXH64; a second base gives 32 more bits.
    """

    def __init__(self, window: int):
        self.window = window
        self.powers = [np.ones(1, np.uint64) for _ in range(4)]

    def _powers(self, k: int, n: int) -> np.ndarray:
        base = BASES[k // 2] if k % 2 == 0 else _inverse(BASES[k // 2])
        have = self.powers[k]
        while len(have) < n:
            step = np.uint64(pow(base, len(have), 1 << 64))
            have = np.concatenate([have, have * step])
        self.powers[k] = have
        return have[:n]

    def hashes(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(64-bit hash, 32-bit check) of the windows starting at each word."""
        n = len(words) - self.window + 1
        out = []
        for k in (0, 2):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self._powers(k, len(words)))])
            out.append((sums[self.window:] - sums[:n]) * self._powers(k + 1, n))
        return _mixed(out[0]), (_mixed(out[1]) >> np.uint64(32)).astype(np.uint32)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Bijective finish, so that the top bits deal windows evenly."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _windows(texts: list[bytes], window: int, high_bits: int) -> tuple[list[list[bytes]], Keys, list[int]]:
    """Words of each text, the keys of all their windows, and where each text's windows begin."""
    hasher, ids = WindowHash(window), {}
    all_words, parts, starts = [], [], [0]
    for text in texts:
        words = text.split()
        n = max(0, len(words) - window + 1)
        if n:
            for w in set(words).difference(ids):
                ids[w] = xxhash.xxh64_intdigest(w)
            parts.append(hasher.hashes(np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))))
        all_words.append(words)
        starts.append(starts[-1] + n)
    high = np.concatenate([np.empty(0, np.uint64), *(p[0] for p in parts)])
    low = np.concatenate([np.empty(0, np.uint32), *(p[1] for p in parts)])
    return all_words, Keys(high, low, high_bits), starts


def removal_intervals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      window: int = WINDOW_WORDS) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, kept_text, intervals (start, end in words).

    A word goes if a window over it has a word sequence that starts anywhere
    else too, in the same document or another; all windows are judged on the
    input. Null, empty and short texts (fewer words than a window) keep all
    their words. Repeated rows remove each other's windows, null ids are kept
    as they are, and no other column is read.
    """
    blocks = packed(docs, id_col, text_col)
    n_windows = max(1, (blocks.agg(F.sum("n_bytes")).first()[0] or 0) // BYTES_PER_WINDOW)
    bits = slice_bits(docs.sparkSession, n_windows, SLICE_WINDOWS)
    # With 2 log2(n) + 10 bits fewer than one in a thousand corpora has two
    # different windows with one key; 32 of the bits are the check.
    high_bits = min(64, max(bits, 2 * n_windows.bit_length() + 10 - 32))
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for r in range(batch.num_rows):
                ids, payload, flags = (c[r].as_py() for c in batch.columns)
                all_words, keys, begin = _windows(unpacked(ids, payload), window, high_bits)
                again = flagged(keys, flags, bits)
                out = []
                for i, words in enumerate(all_words):
                    starts = np.flatnonzero(again[begin[i]:begin[i + 1]])
                    cover = np.zeros(len(words) + 1, np.int32)
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + window, -1)
                    gone = np.cumsum(cover)[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    kept = b" ".join(words) if not len(starts) else b" ".join(
                        [w for w, g in zip(words, gone.tolist()) if not g])
                    out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"),
                                [{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, kind), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                     pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string()),
                     pa.array(columns[4], spans)],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "intervals"])

    def keys_of(texts: list[bytes]) -> Keys:
        return _windows(texts, window, high_bits)[1]

    flagged_blocks = answered(blocks, keys_of, bits, with_check=True, high_bits=high_bits)
    id_type = docs.schema[id_col].dataType.simpleString()
    return flagged_blocks.select("ids", "payload", "flags").mapInArrow(
        apply, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, kept_text string, "
               "intervals array<struct<start:int,end:int>>")
