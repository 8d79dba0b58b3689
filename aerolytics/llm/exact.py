"""Exact deduplication over counting quotient filters.

Each input partition inserts its 64-bit text fingerprints into counting
quotient filters, one per slice of the fingerprint range. Filters of a slice
merge losslessly by their sorted remainders, so the merged counters are exact
per fingerprint. Only texts whose fingerprint counts more than one are compared
byte for byte; every other text is unique without being looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolytics.llm.common import drop_marked, stored, text_sha

#: Equal rows written out from one counted row at a time.
COPIES_AT_ONCE = 1 << 16

#: Fingerprints a slice holds on average, which bounds the memory of a merge.
SLICE_FINGERPRINTS = 1 << 19
#: Fingerprints a partition gathers before it emits its filters.
FLUSH_FINGERPRINTS = 1 << 20


class CountingQuotientFilter:
    """Fingerprints as quotient and remainder with a counter per remainder.

    ``occupied`` has a bit per quotient that has a run, ``run_end`` a bit per
    slot that ends one; ``remainders`` holds the runs in quotient order, each
    sorted; ``extra`` is the counter minus one of the slots listed in
    ``extra_at``, so that fingerprints seen once pay nothing for counting.
    """

    def __init__(self, q_bits: int, occupied, run_end, remainders, extra_at, extra):
        self.q_bits, self.occupied, self.run_end = q_bits, occupied, run_end
        self.remainders, self.extra_at, self.extra = remainders, extra_at, extra

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        """From sorted distinct uint64 fingerprints and their counts."""
        q = max(1, int(len(fingerprints)).bit_length())
        r = np.uint64(64 - q)
        quotient = fingerprints >> r
        remainders = fingerprints & ((np.uint64(1) << r) - np.uint64(1))
        occupied = np.zeros(1 << q, bool)
        occupied[quotient.astype(np.int64)] = True
        run_end = np.append(quotient[1:] != quotient[:-1], True)[:len(quotient)]
        extra_at = np.flatnonzero(counts > 1).astype(np.uint32)
        return cls(q, occupied, run_end, remainders, extra_at, (counts[extra_at] - 1).astype(np.uint64))

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and counts, rebuilt from runs and remainders."""
        runs = np.flatnonzero(self.occupied).astype(np.uint64)
        run_of_slot = np.concatenate([[0], np.cumsum(self.run_end)[:-1]]).astype(np.int64)[:len(self.remainders)]
        fingerprints = (runs[run_of_slot] << np.uint64(64 - self.q_bits)) | self.remainders
        counts = np.ones(len(self.remainders), np.uint64)
        counts[self.extra_at] += self.extra
        return fingerprints, counts

    def to_bytes(self) -> bytes:
        head = np.array([self.q_bits, len(self.remainders), len(self.extra_at)], np.uint64)
        # A remainder needs 64 - q bits: its high byte stays away when q allows.
        low = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :(64 - self.q_bits + 7) // 8]
        return b"".join(x.tobytes() for x in (head, np.packbits(self.occupied), np.packbits(self.run_end),
                                              np.ascontiguousarray(low), self.extra_at, self.extra))

    @classmethod
    def from_bytes(cls, blob: bytes) -> CountingQuotientFilter:
        q, n, m = (int(x) for x in np.frombuffer(blob, np.uint64, 3))
        at, width = 24, (64 - q + 7) // 8

        def take(dtype, count):
            nonlocal at
            out = np.frombuffer(blob, dtype, count, at)
            at += out.nbytes
            return out

        occupied = np.unpackbits(take(np.uint8, ((1 << q) + 7) // 8), count=1 << q).astype(bool)
        run_end = np.unpackbits(take(np.uint8, (n + 7) // 8), count=n).astype(bool)
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = take(np.uint8, n * width).reshape(n, width)
        return cls(q, occupied, run_end, full.view("<u8").reshape(-1), take(np.uint32, m), take(np.uint64, m))

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Lossless: sorted runs merge and counters of equal fingerprints add up."""
        parts = [f.items() for f in filters]
        return cls.build(*_add_up(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])))


def _add_up(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(fingerprints, kind="stable")
    fingerprints, counts = fingerprints[order], counts[order]
    first = np.append(True, fingerprints[1:] != fingerprints[:-1])[:len(fingerprints)]
    at = np.flatnonzero(first)
    return fingerprints[at], np.add.reduceat(counts, at) if len(at) else counts


def repeated_fingerprints(fingerprints: DataFrame, n_rows: int) -> DataFrame:
    """Fingerprints (column ``fp``) that occur twice or more, with their exact count.

    One shuffle of filters: every partition sends each slice of the range at
    most one filter per FLUSH_FINGERPRINTS rows, so a fingerprint held by any
    share of the rows adds one slot per sender. Slices grow with ``n_rows``.
    """
    parts = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, (max(n_rows // SLICE_FINGERPRINTS, parts) - 1).bit_length())

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        values = np.concatenate(parts)
        fps, counts = _add_up(values, np.ones(len(values), np.uint64))
        cuts = np.searchsorted(fps, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        edges = np.append(cuts, len(fps))
        rows = [(s, CountingQuotientFilter.build(fps[a:b], counts[a:b]).to_bytes())
                for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
        return pa.RecordBatch.from_pydict({"slice": pa.array([r[0] for r in rows], pa.int32()),
                                           "filter": pa.array([r[1] for r in rows], pa.binary())})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            n += len(held[-1])
            if n >= FLUSH_FINGERPRINTS:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        merged = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(b) for b in pdf["filter"]])
        fps, counts = merged.items()
        many = counts > 1
        return pd.DataFrame({"fp": fps[many].view(np.int64), "n": counts[many].astype(np.int64)})

    return (fingerprints.select("fp").mapInArrow(build, "slice int, filter binary")
            .groupBy("slice").applyInPandas(combine, "fp long, n long"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("fp"))


def _groups(keyed: DataFrame) -> DataFrame:
    """(fp, sha, keep_id, group_size) of every text that two or more rows hold.

    Rows with a repeated fingerprint are grouped by the text itself, so equality
    is decided on bytes; partial aggregation sends one row per text and task.
    """
    repeated = stored(repeated_fingerprints(keyed, keyed.count()), "repeated")
    return (keyed.join(repeated, "fp", "left_semi").groupBy("fp", "text")
            .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .where("group_size > 1")
            .select("fp", text_sha(F.col("text")).alias("sha"), "keep_id", "group_size"))


def _members(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, fp, sha, n_rows, keep_id, group_size) per distinct id and text."""
    rows = (keyed.select("doc_id", "fp", text_sha(F.col("text")).alias("sha"))
            .groupBy("doc_id", "fp", "sha").agg(F.count(F.lit(1)).alias("n_rows")))
    return rows.join(groups, ["fp", "sha"], "left")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. A null text counts as
    empty; a null id loses to any id and has keep_id null where all ids of its
    group are null. Of repeated rows (equal id and text) exactly one is kept.
    No other column is read; an empty table gives an empty result.
    """
    keyed = _keyed(docs, id_col, text_col)
    alone = F.col("group_size").isNull()
    # A row repeated any number of times comes back in chunks, so no array is as long as the group.
    counted = _members(keyed, _groups(keyed)).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_rows") - 1) / COPIES_AT_ONCE))))
    last = F.least(F.lit(COPIES_AT_ONCE), F.col("n_rows") - F.col("chunk") * COPIES_AT_ONCE)
    out = (counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), last)))
           .withColumn("copy", F.col("copy") + F.col("chunk") * COPIES_AT_ONCE))
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("group_size")).alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns, any names) that ``exact_dedup`` keeps.

    Of repeated rows that differ in other columns the first by their JSON stays.
    """
    keyed = _keyed(docs, id_col, text_col)
    members = stored(_members(keyed, _groups(keyed)).where("group_size > 1").select(
        "doc_id", "sha", "n_rows", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("stays")), "copies")
    return drop_marked(docs, members, id_col, text_col)
