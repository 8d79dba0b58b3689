"""Prefix trie of conversations from sorted sequences, common prefixes and range minima.

A conversation is cut into units of at most ``LAYER`` turns; a unit hangs under
the prefix before it. Units are sorted over the whole table by that prefix and
their turns' digests, so that the members of a prefix stand side by side, and
every block of sorted units gets the common prefix of neighbours and a sparse
table of range minima over them. Each candidate prefix (a unit and a depth)
then finds the left and the right end of its members by two binary searches on
their own, without a stack and without regard to other candidates. A block's
interval is a piece of a node where it touches the block's edge; pieces are few
and add up by the node's prefix digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolytics.llm.common import stored

#: Conversations of one family share the opening turns of its first conversation.
FAMILY = 20
OPENINGS = 4
#: Turns of a unit, units and bytes of a block, layers in a run of the prefix sums.
LAYER = 64
BLOCK_UNITS = 1 << 14
BLOCK_BYTES = 16 << 20
RUN_LAYERS = 1 << 10
#: Conversation ids hashed as one piece.
ID_PIECE = 1 << 16
_WORD = r"[^\x20\x09-\x0D]+"
#: Seeds of the two halves of a prefix digest.
SEEDS = (11, 23)
_ROOT = "00" * 16


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, p, t1, t2, words): turns numbered from 0 by turn (null first), then by their digest."""
    said = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    who = F.coalesce(F.col(f"`{role}`"), F.lit(""))
    # The role's length parts role and text.
    sha = F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256)
    half = lambda at: F.conv(F.substring(sha, at, 16), 16, -10).cast("long")
    slim = rows.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), half(1).alias("t1"),
        half(17).alias("t2"), F.regexp_count(said, F.lit(_WORD)).cast("long").alias("words"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A range sort splits a conversation of any length; equal rows are parted by a random last key.
    keys = ["conv_id", "turn", "t1", "t2"]
    dealt = slim.withColumn("salt", F.rand(7)).repartitionByRange(n, *keys, "salt").withColumn("part", F.spark_partition_id())
    kept = stored(dealt, "turns")
    per_part = kept.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = per_part.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("conv_id", "part").orderBy("turn", "t1", "t2")
    return (kept.withColumn("i", F.row_number().over(own) - 1).join(start, ["conv_id", "part"])
            .select("conv_id", (F.col("start") + F.col("i")).alias("p"), "t1", "t2", "words"))


def _opening(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(conv.cast("string").cast("binary")) % OPENINGS


def rebuilt(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns of the rebuilt conversations with position ``p`` from 0, one row per conversation with its ``length``).

    Conversation c opens with the first h turns of conversation c - c % 20 and
    goes on with its own turns after its first h; h = crc32(c) % 4.
    """
    turns = stored(_turns(rows, conv, turn, role, text), "numbered")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("conv_id")
    asked = sizes.select("conv_id", "n", (c - c % FAMILY).alias("first"), _opening(c).alias("h"))
    first = sizes.select(F.col("conv_id").alias("first"), F.col("n").alias("n_first"))
    convs = stored(asked.join(first, "first", "left")
                   .withColumn("taken", F.least("h", F.coalesce("n_first", F.lit(0))))
                   .withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "rebuilt")
    heads = turns.where((F.col("p") < OPENINGS - 1) & (c % FAMILY == 0)).withColumnRenamed("conv_id", "first")
    opening = (heads.join(convs.where("taken > 0").select("conv_id", "first", "taken"), "first").where("p < taken")
               .select("conv_id", "p", "t1", "t2", "words"))
    rest = (turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("p >= h")
            .select("conv_id", (F.col("p") - F.col("h") + F.col("taken")).alias("p"), "t1", "t2", "words"))
    return opening.unionByName(rest), convs.select("conv_id", "length")


def _units(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(layer, g1, g2, turns, words, conv_id, length): units under the digest (g1, g2) of the prefix before them.

    A prefix's digest is the exclusive or of its turns' digests with their
    positions. Sums over a conversation's layers run in two levels, so that no
    window holds more than a run of layers or one row per run.
    """
    placed = turns.select("conv_id", F.floor(F.col("p") / LAYER).cast("long").alias("layer"), "p", "words",
                          *[F.xxhash64("t1", "t2", "p", F.lit(s)).alias(f"d{i}") for i, s in enumerate(SEEDS, 1)])
    units = placed.groupBy("conv_id", "layer").agg(
        F.sort_array(F.collect_list(F.struct("p", "d1", "d2", "words"))).alias("turns"),  # at most LAYER turns
        F.expr("bit_xor(d1)").alias("x1"), F.expr("bit_xor(d2)").alias("x2"))
    units = units.withColumn("run", F.floor(F.col("layer") / RUN_LAYERS))
    runs = units.groupBy("conv_id", "run").agg(F.expr("bit_xor(x1)").alias("r1"), F.expr("bit_xor(x2)").alias("r2"))
    over_runs = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    over_layers = Window.partitionBy("conv_id", "run").orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda c, w: F.coalesce(F.expr(f"bit_xor({c})").over(w), F.lit(0))
    base = runs.select("conv_id", "run", summed("r1", over_runs).alias("b1"), summed("r2", over_runs).alias("b2"))
    local = units.select("conv_id", "run", "layer", "turns", summed("x1", over_layers).alias("l1"),
                         summed("x2", over_layers).alias("l2"))
    return (local.join(base, ["conv_id", "run"]).join(convs, "conv_id")
            .select("layer", F.col("b1").bitwiseXOR(F.col("l1")).alias("g1"), F.col("b2").bitwiseXOR(F.col("l2")).alias("g2"),
                    F.transform("turns", lambda t: F.struct(t["d1"], t["d2"])).alias("digests"),
                    F.transform("turns", lambda t: t["words"]).alias("words"), "conv_id", "length"))


class RangeMinima:
    """Sparse table: the minimum of any range of an array in two look-ups, and searches that double their step."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << len(self.rows) - 1 <= len(values):
            step = 1 << len(self.rows) - 1
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum of values[a..b], both inclusive, per pair."""
        level = np.frexp((b - a + 1).astype(float))[1] - 1
        out = np.empty(len(a), self.rows[0].dtype)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.rows[k][a[at]], self.rows[k][b[at] - (1 << k) + 1])
        return out

    def right_end(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Largest r with values[at + 1..r] >= depth."""
        r, n = at.copy(), len(self.rows[0])
        for k in range(len(self.rows) - 1, -1, -1):
            fits = r + (1 << k) < n
            ok = fits.copy()
            ok[fits] = self.rows[k][r[fits] + 1] >= depth[fits]
            r[ok] += 1 << k
        return r

    def left_end(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Least l with values[l + 1..at] >= depth."""
        left = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            fits = left >= 1 << k
            ok = fits.copy()
            ok[fits] = self.rows[k][left[fits] - (1 << k) + 1] >= depth[fits]
            left[ok] -= 1 << k
        return left


def member_intervals(layer: np.ndarray, group: np.ndarray, digests: list, conv: np.ndarray, length: np.ndarray) -> dict:
    """Nodes of one block of sorted units: arrays unit, depth (in the layer), left, right, least_conv, longest, edge.

    ``digests`` holds an (n_turns, 2) array per unit. ``edge`` tells that the
    members reach the block's first or last unit, where others may follow.
    """
    n = len(digests)
    sizes = np.array([len(d) for d in digests])
    width = int(sizes.max())
    grid = np.zeros((n, width, 2), np.int64)
    inside = np.arange(width) < sizes[:, None]
    grid[inside] = np.concatenate(digests)
    same = (grid[1:] == grid[:-1]).all(2) & inside[1:] & inside[:-1]
    common = np.full(n, -1, np.int64)  # with the unit before; -1 where another prefix begins
    common[1:] = np.logical_and.accumulate(same, 1).sum(1)
    common[1:][(layer[1:] != layer[:-1]) | (group[1:] != group[:-1]).any(1)] = -1
    minima = RangeMinima(common)
    unit = np.repeat(np.arange(n), sizes)
    depth = np.concatenate([np.arange(1, s + 1) for s in sizes.tolist()])
    left, right = minima.left_end(unit, depth), minima.right_end(unit, depth)
    first = left == unit  # one candidate stands for each interval
    unit, depth, left, right = unit[first], depth[first], left[first], right[first]
    prefix = np.bitwise_xor.accumulate(grid, 1) ^ group[:, None, :]
    above = np.where((depth > 1)[:, None], prefix[unit, np.maximum(depth - 2, 0)], group[unit])
    return {"unit": unit, "depth": depth, "left": left, "right": right, "id": prefix[unit, depth - 1], "parent": above,
            "least_conv": RangeMinima(conv).least(left, right), "longest": -RangeMinima(-length).least(left, right),
            "edge": (left == 0) | (right == n - 1)}


def _hex(x: Column, y: Column) -> Column:
    return F.concat(F.lpad(F.hex(x), 16, "0"), F.lpad(F.hex(y), 16, "0"))


def _pieces(units: DataFrame, block_units: int) -> DataFrame:
    """(id1, id2, up1, up2, depth, conv_id, n, longest, words, edge): nodes, in pieces where a block's edge cuts them."""
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["layer", "g1", "g2", "digests", "conv_id"]
    ordered = units.repartitionByRange(n, *keys).sortWithinPartitions(*keys)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nodes(rows: list[tuple]) -> pa.RecordBatch:
            layer, g1, g2, digests, words, conv, length = zip(*rows)
            layer, conv, length = (np.array(x, np.int64) for x in (layer, conv, length))
            m = member_intervals(layer, np.column_stack([g1, g2]).astype(np.int64),
                                 [np.array([(t["d1"], t["d2"]) for t in d], np.int64) for d in digests], conv, length)
            spoken = np.array([words[u][d - 1] for u, d in zip(m["unit"].tolist(), m["depth"].tolist())], np.int64)
            columns = [m["id"][:, 0], m["id"][:, 1], m["parent"][:, 0], m["parent"][:, 1],
                       layer[m["unit"]] * LAYER + m["depth"], m["least_conv"], m["right"] - m["left"] + 1, m["longest"],
                       spoken, m["edge"]]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns],
                                              ["id1", "id2", "up1", "up2", "depth", "conv_id", "n", "longest", "words", "edge"])

        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(row)
                # The grid of a block is as wide as its longest unit.
                size = max(size, 16 * len(row[3]))
                if len(rows) >= block_units or len(rows) * size >= BLOCK_BYTES:
                    yield nodes(rows)
                    rows, size = [], 0
        if rows:
            yield nodes(rows)

    return ordered.select("layer", "g1", "g2", "digests", "words", "conv_id", "length").mapInArrow(
        build, "id1 long, id2 long, up1 long, up2 long, depth long, conv_id long, n long, longest long, words long, "
               "edge boolean")


def _ends(units: DataFrame, convs: DataFrame) -> DataFrame:
    """(id, ends_sha256) for every prefix at which conversations end; the root for those without turns."""
    last = units.where(F.col("layer") == F.floor((F.col("length") - 1) / LAYER))
    fold = lambda c: F.aggregate("digests", F.col(c), lambda a, t: a.bitwiseXOR(t["d" + c[1]]))
    ended = last.select(_hex(fold("g1"), fold("g2")).alias("id"), "conv_id")
    ended = ended.unionByName(convs.where("length = 0").select(F.lit(_ROOT).alias("id"), "conv_id"))
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of ids as text, so that many ids of one prefix travel as few rows."""
        def flush(runs):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs]), pa.array([r[1][0] for r in runs], pa.int64()),
                                               pa.array([",".join(map(str, r[1])) for r in runs])], ["id", "first", "text"])
        runs = []
        for batch in batches:
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if runs and runs[-1][0] == node and len(runs[-1][1]) < ID_PIECE:
                    runs[-1][1].append(conv)
                    continue
                if len(runs) >= 4096 or runs and len(runs[-1][1]) >= ID_PIECE:
                    yield flush(runs)
                    runs = []
                runs.append((node, [conv]))
        if runs:
            yield flush(runs)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One running hash: a hash is sequential, but holds no more than its state."""
        node, state, done = None, None, []
        out = lambda d: pa.RecordBatch.from_arrays([pa.array([x[0] for x in d], pa.string()),
                                                    pa.array([x[1] for x in d], pa.string())], ["id", "ends_sha256"])
        for batch in batches:
            for at, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if at == node:
                    state.update(b"," + text.encode())
                    continue
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = at, hashlib.sha256(text.encode())
            if len(done) >= 4096:
                yield out(done)
                done = []
        if state is not None:
            done.append((node, state.hexdigest()))
        yield out(done)

    runs = (ended.repartitionByRange(n, "id", "conv_id").sortWithinPartitions("id", "conv_id")
            .mapInArrow(joined, "id string, first long, text string"))
    return (runs.repartition(n, "id").sortWithinPartitions("id", "first").select("id", "first", "text")
            .mapInArrow(digest, "id string, ends_sha256 string"))


def _subtree_sums(shared: DataFrame) -> DataFrame:
    """(id, saved, leaves) summed over subtrees of ``shared`` (id, up, saved, leaves), by doubling ancestors.

    After r rounds a node holds the sums over its descendants within 2^r - 1
    steps and the name of the ancestor 2^r steps up, so a trie of any depth
    takes the logarithm of it.
    """
    now = stored(shared, "sums")
    while now.where("up IS NOT NULL").limit(1).count():
        gain = now.where("up IS NOT NULL").groupBy("up").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        above = now.select(F.col("id").alias("up"), F.col("up").alias("next"))
        now = stored(now.join(gain.withColumnRenamed("up", "id"), "id", "left").join(above, "up", "left")
                     .select("id", F.col("next").alias("up"),
                             (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"),
                             (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves")), "sums")
    return now.select("id", "saved", "leaves")


def prefix_trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text", block_units: int = BLOCK_UNITS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty, a null turn stands first, equal turns are
    ordered by the SHA-256 of role and text, and repeated rows are turns of
    their own. Rows without a conversation id belong to no conversation and are
    left out. A table without conversations has no node; otherwise the root is
    one. Texts enter whole, as digests; no other column is read.
    """
    turns, convs = rebuilt(rows, conv, turn, role, text)
    convs = stored(convs, "conversations")
    units = stored(_units(turns, convs), "units")
    pieces = stored(_pieces(units, block_units), "pieces")
    edge = (pieces.where("edge").groupBy("id1", "id2", "up1", "up2", "depth")
            .agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.max("longest").alias("longest"),
                 F.max("words").alias("words")))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.max("length").alias("longest"))
    nodes = (pieces.where("NOT edge").drop("edge").unionByName(edge)
             .select(_hex(F.col("id1"), F.col("id2")).alias("id"), _hex(F.col("up1"), F.col("up2")).alias("up"),
                     "depth", "conv_id", "n", "longest", "words"))
    nodes = stored(nodes.unionByName(root.where("n > 0").select(
        F.lit(_ROOT).alias("id"), F.lit(None).cast("string").alias("up"), F.lit(0).cast("long").alias("depth"), "conv_id", "n",
        "longest", F.lit(0).cast("long").alias("words"))), "nodes")
    leaf = F.col("longest") == F.col("depth")
    # What only one conversation holds saves nothing and ends in one leaf; sums run over the others.
    below = nodes.groupBy("up").agg(F.count(F.lit(1)).alias("children"), F.sum((F.col("n") == 1).cast("long")).alias("lone"))
    shared = (nodes.where((F.col("n") > 1) | (F.col("depth") == 0)).join(below.withColumnRenamed("up", "id"), "id", "left")
              .select("id", "up", "conv_id", F.coalesce("children", F.lit(0)).alias("n_children"),
                      ((F.col("n") - 1) * F.col("words")).alias("saved"),
                      (leaf.cast("long") + F.coalesce("lone", F.lit(0))).alias("leaves")))
    shared = stored(shared, "shared")
    sums = _subtree_sums(shared.select("id", "up", "saved", "leaves"))
    known = stored(shared.select("id", "conv_id", "n_children").join(sums, "id"), "known")
    over = known.select(F.col("id").alias("up"), F.col("conv_id").alias("over"))
    none = hashlib.sha256(b"").hexdigest()
    return (nodes.join(known.drop("conv_id"), "id", "left").join(over, "up", "left")
            .join(_ends(units, convs), "id", "left")
            .select("conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("over", "conv_id")).alias("parent_conv_id"),
                    F.col("n").alias("n_convs"), F.coalesce("n_children", F.when(leaf, 0).otherwise(1)).cast("long").alias("n_children"),
                    F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
                    F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))
