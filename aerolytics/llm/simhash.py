"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint is a ring of 2t + 1 segments for distance t. If two fingerprints
differ in at most t bits, some start on the ring has every chain of l
consecutive segments differ in at most l t / (2t + 1) bits: the first two
segments are equal and of the next two at least one. Those segments are the
join key; the longer chains prune the candidates before the Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolytics.llm.common import drop_marked, raw_bytes, stored, text_sha, unsigned_hex
from aerolytics.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Shingles hashed at once, which bounds memory on very long texts.
BLOCK = 1 << 16
#: Fingerprints of one key that one task compares; larger keys are split into pairs of blocks.
KEY_ROWS = 4096


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash over the XXH64 of word shingles, repeats included; no words: zero."""
    words = (text or b"").lower().split()  # ASCII case and white space, as the words are defined
    n = len(words) - shingle_words + 1
    if not words:
        return 0
    ones, total = np.zeros(64, np.int64), max(1, n)
    for at in range(0, total, BLOCK):
        part = words[at:at + BLOCK + shingle_words - 1]
        shingles = zip(*[part[k:] for k in range(shingle_words)]) if n > 0 else [words]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle_words: int = SHINGLE_WORDS,
                 sha: bool = False) -> DataFrame:
    """(doc_id, fp[, sha]) per row; fp as signed 64 bits. A null text has no words."""
    @F.arrow_udf("long")
    def simhash(column: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, shingle_words) for t in raw_bytes(column)], np.uint64).view(np.int64))

    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), simhash(text).alias("fp"),
                       *([text_sha(text).alias("sha")] if sha else []))


class Ring:
    """Segments of a 64-bit fingerprint on a ring, their budgets and join keys."""

    def __init__(self, max_bits: int):
        m = 2 * max_bits + 1
        edges = [round(64 * i / m) for i in range(m + 1)]
        self.masks = [np.uint64(((1 << (b - a)) - 1) << a) for a, b in zip(edges, edges[1:])]
        self.max_bits, self.segments = max_bits, m

    def keyed(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every fingerprint and probe: probe number, the three equal segments' bits, fingerprint."""
        probes, bits = [], []
        for start in range(self.segments):
            for third in (2, 3):
                mask = np.uint64(0)
                for k in (0, 1, third):
                    mask |= self.masks[(start + k) % self.segments]
                probes.append(start * 2 + third - 2)
                bits.append(fps & mask)
        return (np.repeat(np.array(probes, np.int32), len(fps)), np.concatenate(bits), np.tile(fps, len(probes)))

    def close(self, start: np.ndarray | int, differing: np.ndarray) -> np.ndarray:
        """Which of the XORed pairs hold every chain budget from ``start`` on, then the full distance."""
        alive = np.arange(len(differing))
        start = np.broadcast_to(start, len(differing))
        masks = np.array(self.masks)
        chain = np.zeros(len(differing), np.int64)
        for length in range(1, self.segments + 1):
            segment = masks[(start[alive] + length - 1) % self.segments]
            chain[alive] += np.bitwise_count(differing[alive] & segment)
            alive = alive[chain[alive] <= length * self.max_bits // self.segments]
        out = np.zeros(len(differing), bool)
        out[alive] = np.bitwise_count(differing[alive]) <= self.max_bits
        return out


def _run_links(ring: Ring, start: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside one key as stars: each found fingerprint with the one that began its group.

    A fingerprint that is linked leaves the open set at once, so a dense group
    costs a few passes and gives one link per member, never all its pairs.
    """
    open_, u, v = fps, [], []
    while len(open_) > 1:
        root, open_, frontier = open_[0], open_[1:], [open_[0]]
        while frontier and len(open_):
            hit = ring.close(start, open_ ^ frontier.pop())
            found = open_[hit]
            open_ = open_[~hit]
            frontier.extend(found)
            u.append(found)
            v.append(np.full(len(found), root, np.uint64))
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *u]), np.concatenate([none, *v])


def links(distinct: DataFrame, max_bits: int = MAX_BITS, key_rows: int = KEY_ROWS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column ``fp``) that connect all within ``max_bits``.

    Not every close pair is an edge, but any two close fingerprints are
    connected. Keys held by more than ``key_rows`` fingerprints are dealt as
    pairs of blocks, so no task compares more than two blocks of a key.
    """
    ring = Ring(max_bits)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, bits, fps = ring.keyed(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(bits.view(np.int64)),
                                              pa.array(fps.view(np.int64))], ["probe", "bits", "fp"])

    keyed = distinct.select("fp").mapInArrow(probe, "probe int, bits long, fp long")
    sizes = keyed.groupBy("probe", "bits").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / key_rows).cast("int")
    large = stored(sizes.where(F.col("n") > key_rows).select("probe", "bits", blocks.alias("blocks")), "large-keys")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (keyed.join(large, ["probe", "bits"], "left")
             .withColumn("own", F.coalesce(own, F.lit(0)))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
             .select("probe", "bits", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def edges(rows: list[np.ndarray], last: bool):
            """Links of all complete runs; returns the rows of the run still open."""
            table = np.concatenate(rows, axis=1)
            new_run = np.append(True, (table[:4, 1:] != table[:4, :-1]).any(0))
            at = np.append(np.flatnonzero(new_run), table.shape[1])
            done = len(at) - 1 if last else len(at) - 2
            size = at[1:] - at[:-1]
            fps, u, v = table[4].view(np.uint64), [], []
            pairs = at[:done][size[:done] == 2]
            hit = ring.close(table[0][pairs] // 2, fps[pairs] ^ fps[pairs + 1])
            u.append(fps[pairs + 1][hit])
            v.append(fps[pairs][hit])
            for r in np.flatnonzero(size[:done] > 2):
                x, y = _run_links(ring, int(table[0][at[r]]) // 2, fps[at[r]:at[r + 1]])
                u.append(x)
                v.append(y)
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in (u, v)], ["u", "v"])
            return batch, table[:, at[done]:]

        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            out, rest = edges(held, False)
            held = [rest]
            yield out
        if held and held[0].shape[1]:
            yield edges(held, True)[0]

    return (dealt.repartition("probe", "bits", "a", "b").sortWithinPartitions("probe", "bits", "a", "b", "fp")
            .mapInArrow(compare, "u long, v long"))


def _components(rows: DataFrame, max_bits: int) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint of the stored ``rows`` (doc_id, fp, ...)."""
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fingerprints")
    roots = stored(connected_components(links(distinct, max_bits)).withColumnRenamed("node", "fp"), "roots")
    known = roots.join(distinct, "fp")
    least = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = known.join(least, "root").select("fp", "component_id")
    return (distinct.join(linked, "fp", "left")
            .select("fp", F.coalesce("component_id", "least_id").alias("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Equal fingerprints are one node, however many rows hold them. Null, empty
    and blank texts have fingerprint zero and link like any other. A null id
    never names a component unless all its ids are null. Repeated rows give
    repeated results; no other column is read.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle_words), "simhash")
    # Stored, so that the join is of two plain exchanges, whose large partitions Spark splits.
    return (rows.join(stored(_components(rows, max_bits), "components"), "fp")
            .select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` (all columns) with one row per component: least id, then fingerprint, then text digest."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle_words, sha=True), "simhash")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = stored(connected_components(links(stored(distinct, "fingerprints"), max_bits))
                   .withColumnRenamed("node", "fp"), "roots")
    grouped = rows.join(roots, "fp", "left").select(
        "doc_id", "sha", F.coalesce("root", "fp").alias("group"),
        F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "fp", "sha").alias("rank"))
    members = grouped.groupBy("group", "rank").agg(F.count(F.lit(1)).alias("n_rows"))
    first = members.groupBy("group").agg(F.min("rank").alias("first"), F.sum("n_rows").alias("size"))
    marks = (members.join(first.where("size > 1"), "group")
             .select("rank.doc_id", "rank.sha", "n_rows", (F.col("rank") == F.col("first")).alias("stays")))
    return drop_marked(docs, stored(marks, "near-copies"), id_col, text_col)
