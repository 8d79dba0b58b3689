"""Centroid clustering whose bounds are loosened by geometry instead of by full drift.

Vectors are integers, stored in immutable blocks; a block's state is a cluster,
an upper bound on the distance to its centroid and a lower bound on the distance
to any other, per vector. When centroids move, all vectors of a cluster lie in
the sphere around its old centroid that holds them. In the plane through that
centre and the path of another centroid the sphere is a disc, and how much
nearer the moved centroid can have come to a point of the disc follows from the
tangents to it: less than its drift, and less than nothing when it moved away.
A vector whose bounds cross is ambiguous and is scanned exactly; the others keep
their cluster without being read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolytics.llm.common import stored
from aerolytics.session import checkpoint_dir

#: Vectors of a block, bytes of blocks in a bucket.
BLOCK_VECTORS = 8192
BUCKET_BYTES = 64 << 20
#: Components are held within this size, so that a squared distance fits 64 bits.
MAX_COMPONENT = 1 << 27
#: Pieces of a centroid's path whose tangents bound its approach.
PATH_PIECES = 8
#: Relative slack of a bound, above the rounding of square roots and sums.
SLACK = 1e-9


def approach(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray, pieces: int = PATH_PIECES) -> float:
    """At most how much nearer than ``old`` the centroid ``new`` is to a point within ``radius`` of ``centre``.

    The distance to a centroid at s on its way falls by cos(a) per unit of way,
    a being the angle between the way and the line to the point. Over the disc
    that cosine is largest on the lower tangent from s, and falls as s advances,
    so the value at the start of each piece of the path bounds the piece.
    """
    way = (new - old).astype(float)
    drift = float(np.sqrt(way @ way))
    if drift == 0.0:
        return 0.0
    to_centre = (centre - old).astype(float)
    along = float(to_centre @ way) / drift
    aside = float(np.sqrt(max(0.0, to_centre @ to_centre - along * along)))
    scale = drift + abs(along) + aside + radius
    radius += SLACK * scale
    at = along - drift * np.arange(pieces) / pieces
    gone = np.hypot(at, aside)
    outside = gone > radius
    angle = np.arctan2(aside, at) - np.arcsin(np.where(outside, radius / np.where(outside, gone, 1.0), 1.0))
    cosine = np.where(outside, np.cos(np.maximum(angle, 0.0)), 1.0)
    return float(min(drift, drift * cosine.mean())) + SLACK * scale


def loosening(old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(own drift, largest approach of another centroid) per cluster."""
    k = len(old)
    drift = np.sqrt(((new - old).astype(float) ** 2).sum(1)) * (1 + SLACK)
    near = np.array([max((approach(old[i], radii[i], old[j], new[j]) for j in range(k) if j != i), default=0.0)
                     for i in range(k)])
    return drift, near


def scan(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance, distance bound of the next) of integer vectors; ties: smaller number."""
    square = np.stack([((vectors - c) ** 2).sum(1) for c in centroids], 1)
    best = square.argmin(1)
    least = square[np.arange(len(best)), best]
    others = square.copy()
    others[np.arange(len(best)), best] = np.iinfo(np.int64).max
    following = others.min(1) if square.shape[1] > 1 else np.full(len(best), np.inf)
    return best, least, np.where(square.shape[1] > 1, np.sqrt(following.astype(float)) * (1 - SLACK), np.inf)


def _unpacked(payload: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), "<i4").reshape(-1, dim).astype(np.int64)


def _blocks(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """Rows (block_id, ids, payload) of the kept vectors as integers."""
    v = F.col("v")
    kept = (vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
            .where((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))))
    id_type = vectors.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_VECTORS):
                part = batch.slice(at, BLOCK_VECTORS)
                x = np.floor(part.column(1).flatten().to_numpy(zero_copy_only=False) * 1024.0)
                whole = np.clip(x, -MAX_COMPONENT, MAX_COMPONENT).astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().int >> 65]), pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)),
                     pa.array([zstandard.ZstdCompressor(level=1).compress(whole)], pa.binary())],
                    ["block_id", "ids", "payload"])

    return kept.mapInArrow(pack, f"block_id long, ids array<{id_type}>, payload binary")


class _Buckets:
    """Tables of one run, bucketed alike by block, so that a round joins state to blocks without a shuffle."""

    def __init__(self, spark, n: int):
        self.spark, self.n, self.run = spark, n, uuid.uuid4().hex

    def table(self, df: DataFrame, tag: str, deal: bool = False) -> DataFrame:
        name = f"centroids_{tag}_{self.run}"
        df = df.repartition(self.n, "block_id") if deal else df
        (df.write.bucketBy(self.n, "block_id").sortBy("block_id")
         .option("path", f"{checkpoint_dir(self.spark)}/llm/{name}").saveAsTable(name))
        return self.spark.table(name)

    def forget(self, tag: str) -> None:
        """Take a table that no later round reads out of the catalogue; its files stay with the run's folder."""
        self.spark.sql(f"DROP TABLE centroids_{tag}_{self.run}")


_STATE = "block_id long, cluster binary, upper binary, lower binary, sums binary, scanned long"


def _round(blocks: DataFrame, state: DataFrame | None, centroids: np.ndarray, moved, dim: int) -> DataFrame:
    """The state after assigning every vector to the nearest of ``centroids``; ``moved`` is their ``loosening``."""
    k, first = len(centroids), state is None

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                if first:
                    x = _unpacked(row["payload"], dim)
                    best, least, lower = scan(x, centroids)
                    upper = np.sqrt(least.astype(float)) * (1 + SLACK)
                    sums = np.zeros((k, dim + 1), np.int64)
                    np.add.at(sums, best, np.column_stack([np.ones(len(x), np.int64), x]))
                    looked = len(x)
                else:
                    best, upper, lower = (np.frombuffer(row[c], t).copy() for c, t in
                                          (("cluster", "<i4"), ("upper", "<f8"), ("lower", "<f8")))
                    sums = np.frombuffer(row["sums"], "<i8").reshape(k, dim + 1).copy()
                    upper += moved[0][best]
                    lower -= moved[1][best]
                    at = np.flatnonzero(upper >= lower)
                    looked = 0
                    if len(at):
                        x = _unpacked(row["payload"], dim)
                        own = ((x[at] - centroids[best[at]]) ** 2).sum(1)
                        upper[at] = np.sqrt(own.astype(float)) * (1 + SLACK)
                        at = at[upper[at] >= lower[at]]
                        looked = len(at)
                        now, least, lower[at] = scan(x[at], centroids)
                        upper[at] = np.sqrt(least.astype(float)) * (1 + SLACK)
                        turned = np.flatnonzero(now != best[at])
                        rows = np.column_stack([np.ones(len(turned), np.int64), x[at[turned]]])
                        np.subtract.at(sums, best[at[turned]], rows)
                        np.add.at(sums, now[turned], rows)
                        best[at] = now
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block_id"]], pa.int64()), pa.array([best.astype("<i4").tobytes()], pa.binary()),
                     pa.array([upper.astype("<f8").tobytes()], pa.binary()),
                     pa.array([lower.astype("<f8").tobytes()], pa.binary()),
                     pa.array([sums.astype("<i8").tobytes()], pa.binary()), pa.array([looked], pa.int64())],
                    ["block_id", "cluster", "upper", "lower", "sums", "scanned"])

    source = blocks.select("block_id", "payload")
    if not first:
        source = source.join(state.select("block_id", "cluster", "upper", "lower", "sums"), "block_id")
    return source.mapInArrow(assign, _STATE)


def _summary(state: DataFrame, k: int, dim: int) -> tuple[list[list[int]], np.ndarray]:
    """Per cluster: count and component sums over all blocks, and the radius that holds its vectors."""
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, radius = np.zeros((k, dim + 1), object), np.zeros(k)
        for batch in batches:
            for r in range(batch.num_rows):
                total += np.frombuffer(batch.column("sums")[r].as_py(), "<i8").reshape(k, dim + 1)
                best = np.frombuffer(batch.column("cluster")[r].as_py(), "<i4")
                np.maximum.at(radius, best, np.frombuffer(batch.column("upper")[r].as_py(), "<f8"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(k), dim + 1), pa.int32()), pa.array(np.tile(np.arange(dim + 1), k), pa.int32()),
             pa.array([str(v) for v in total.ravel()]), pa.array(np.repeat(radius, dim + 1))],
            ["cluster", "place", "total", "radius"])

    rows = (state.select("sums", "cluster", "upper").mapInArrow(parts, "cluster int, place int, total string, radius double")
            .groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"),
                                             F.max("radius").alias("radius")).collect())
    sums, radii = [[0] * (dim + 1) for _ in range(k)], np.zeros(k)
    for r in rows:  # k times (dim + 1) rows
        sums[r["cluster"]][r["place"]] = int(r["total"])
        radii[r["cluster"]] = r["radius"]
    return sums, radii


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8,
                      rounds: int = 10, dim: int = 64, seed: int = 3) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of ``dim`` components, none null or non-finite, as integers
    floor(1024 x), held within 2^27. Centroids start as the ``k`` kept vectors
    (all, if fewer) with the least SHA-256 of ``seed:id``, null ids last, equal
    ids by their components. Repeated rows are vectors like any other. A table
    without kept vectors gives no rows; no other column is read.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    out_schema = f"vec_id {id_type}, cluster int, distance long"
    blocks = stored(_blocks(vectors, id_col, vector_col, dim), "vectors")
    n_bytes = blocks.agg(F.sum(F.length("payload"))).first()[0] or 0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x = _unpacked(batch.column("payload")[r].as_py(), dim)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[r].values, pa.array(x.tolist(), pa.list_(pa.int64()))],
                                                 ["vec_id", "x"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = (blocks.select("ids", "payload").mapInArrow(rows, f"vec_id {id_type}, x array<long>")
             .orderBy(digest.asc_nulls_last(), "x").limit(k).select("x").collect())  # k rows
    empty_sums = spark.createDataFrame([], out_schema + ", cluster_inertia long, inertia long, centroid_sha256 string")
    if not first:
        return empty_sums
    centroids = np.array([r["x"] for r in first], np.int64)
    k = len(centroids)
    buckets = _Buckets(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // BUCKET_BYTES))
    blocks = buckets.table(blocks, "blocks", deal=True)
    state, moved = None, None
    for t in range(rounds + 1):
        state = buckets.table(_round(blocks, state, centroids, moved, dim), f"state{t}")
        if t:
            buckets.forget(f"state{t - 1}")
        if t < rounds:
            sums, radii = _summary(state, k, dim)
            # Python's floor division is exact for integers of any size.
            new = np.array([[v // s[0] for v in s[1:]] if s[0] else c.tolist() for s, c in zip(sums, centroids)], np.int64)
            moved, centroids = loosening(centroids, new, radii), new

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                best = np.frombuffer(batch.column("cluster")[r].as_py(), "<i4")
                x = _unpacked(batch.column("payload")[r].as_py(), dim)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[r].values, pa.array(best, pa.int32()),
                     pa.array(((x - centroids[best]) ** 2).sum(1), pa.int64())], ["vec_id", "cluster", "distance"])

    out = (blocks.join(state.select("block_id", "cluster"), "block_id").select("ids", "payload", "cluster")
           .mapInArrow(distances, out_schema))
    totals = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    inertia = {r["cluster"]: int(r["s"]) for r in totals}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    place = F.col("cluster") + 1
    return out.select("vec_id", "cluster", "distance",
                      F.element_at(F.array(*[F.lit(inertia.get(i, 0)).cast("long") for i in range(k)]), place)
                      .alias("cluster_inertia"),
                      F.lit(sum(inertia.values())).cast("long").alias("inertia"),
                      F.element_at(F.array(*[F.lit(s) for s in sha]), place).alias("centroid_sha256"))
