"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's shingles are ordered from rare to frequent. If two sets overlap
enough, their first |x| - t + l shingles (t: the least overlap x allows) share
at least l of them, for every l. Each document takes the l that its own costs
favour: a longer prefix reads longer lists, but a partner must then be met l
times before the sets are compared. A pair is held to the smaller of its two l.

* Blocks of documents send their distinct shingles to slices of the hash range,
  which answer whether another document has them too. A document with too few
  shared shingles has no partner and goes no further; equal sets become one.
* Each set is compared with one leader of its lists first, the set with most
  copies. Sets near one leader are kept as differences from it, whose common
  part gives the exact overlap of any two; those that already link to the leader
  need no comparison with each other, so a hot group is not expanded to pairs.
* What is left, pairs of different components and leaders, is met through the
  prefixes, counted, and compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolytics.llm.blocks import Keys, answered, flagged, packed, slice_bits, unpacked
from aerolytics.llm.common import stored
from aerolytics.llm.components import connected_components

SHINGLE_WORDS = 5
PERCENT = 80
#: Longest matching asked for, and the cost of comparing two sets in list entries.
MAX_MATCHES = 8
COMPARE_COST = 16
#: Shingles a slice counts, and bytes of text per shingle assumed for their number.
SLICE_KEYS = 1 << 19
BYTES_PER_KEY = 6
#: Bits of a key beyond the logarithm of their number: one in sixteen is taken for shared by chance.
KEY_BITS = 4
#: Entries of a list, and of its sets outside the largest component, that meet in one task.
LIST_ENTRIES, MINOR_ENTRIES = 1 << 12, 1 << 9
# Odd multipliers that place the words of a shingle (modulo 2^64).
PLACES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[bytes], n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes, ends): the distinct shingles of each text, ascending, one text after another."""
    ids: dict[bytes, int] = {}
    parts, counts = [], []
    for text in texts:
        words = text.lower().split()
        if len(words) < n_words:
            h = np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)] if words else [], np.uint64)
        else:
            for w in set(words).difference(ids):
                ids[w] = xxhash.xxh64_intdigest(w)
            at = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
            n = len(words) - n_words + 1
            h = np.zeros(n, np.uint64)
            for k in range(n_words):  # Horner's rule, so that the order of the words counts
                h = h * np.uint64(PLACES[0]) + (at[k:k + n] ^ np.uint64(PLACES[1]))
            h = _mixed(h)
        h = np.unique(h)
        parts.append(h)
        counts.append(len(h))
    return np.concatenate([np.empty(0, np.uint64), *parts]), np.cumsum(counts, dtype=np.int64)


def least_overlap(n: np.ndarray | int, percent: int):
    """Least number of common shingles of a set of ``n`` with any set it links to."""
    return (n * percent + 99) // 100


def _shared_sets(docs: DataFrame, id_col: str, text_col: str, n_words: int, percent: int) -> DataFrame:
    """Stored (doc_id, n_shingles, digest, shared): digest and shared shingles only where a partner is possible."""
    blocks = packed(docs, id_col, text_col)
    n_keys = max(1, (blocks.agg(F.sum("n_bytes")).first()[0] or 0) // BYTES_PER_KEY)
    bits = slice_bits(docs.sparkSession, n_keys, SLICE_KEYS)
    high_bits = min(64, max(bits, n_keys.bit_length() + KEY_BITS))
    id_type = docs.schema[id_col].dataType.simpleString()

    def keys_of(texts: list[bytes]) -> Keys:
        return Keys(shingle_sets(texts, n_words)[0], None, high_bits)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for r in range(batch.num_rows):
                ids, payload, flags = (c[r].as_py() for c in batch.columns)
                h, ends = shingle_sets(unpacked(ids, payload), n_words)
                again = flagged(Keys(h, None, high_bits), flags, bits) if len(h) else np.empty(0, bool)
                sizes = np.diff(ends, prepend=0)
                digests, shared = [], []
                for e, n in zip(ends.tolist(), sizes.tolist()):
                    mine, found = h[e - n:e], again[e - n:e]
                    # A link needs a shared shingle among the first n - t + 1, and those of no other set come first.
                    alone = n - int(found.sum()) > n - least_overlap(n, percent) or not n
                    digests.append(None if alone else xxhash.xxh3_128_digest(mine.tobytes()))
                    shared.append(None if alone else mine[found].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, kind), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(shared, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "shared"])

    return stored(answered(blocks, keys_of, bits, high_bits=high_bits).select("ids", "payload", "flags").mapInArrow(
        apply, f"doc_id {id_type}, n_shingles long, digest binary, shared array<long>"), "shingle-sets")


def best_matches(n: int, frequencies: list[int], percent: int, most: int = MAX_MATCHES) -> int:
    """The number of matches to ask for, from the frequencies of a set's shared shingles, rarest first.

    With l matches the lists of the first n - t + l shingles are read, S entries
    in all, and a set met l times took l of them, so S / l sets are compared.
    """
    spare = n - least_overlap(n, percent)
    lone = n - len(frequencies)
    read, best, least = sum(f - 1 for f in frequencies[:max(0, spare + 1 - lone)]), 1, None
    for matches in range(1, min(most, n - spare) + 1):
        if matches > 1 and 0 <= spare + matches - 1 - lone < len(frequencies):
            read += frequencies[spare + matches - 1 - lone] - 1
        cost = read * (1 + COMPARE_COST / matches)
        if least is None or cost < least:
            best, least = matches, cost
    return best


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """Stored list entries (token, node, n, copies, level, matches): ``level`` is the least l whose prefix has the token."""
    tokens = sets.select("node", "n", "copies", F.explode("shared").alias("token"))
    # Stored, so that the join is of two plain exchanges, whose large partitions Spark splits (here and below).
    often = stored(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "frequencies")
    ranked = (tokens.join(often, "token").groupBy("node", "n", "copies")
              .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked")))  # one set

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for node, n, copies, ranked in zip(*(c.to_pylist() for c in batch.columns)):
                matches = best_matches(n, [t["df"] for t in ranked], percent)
                spare, lone = n - least_overlap(n, percent), n - len(ranked)
                for at, t in enumerate(ranked[:max(0, spare + matches - lone)], lone + 1):
                    for column, value in zip(out, (t["token"], node, n, copies, max(1, at - spare), matches)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out],
                                             ["token", "node", "n", "copies", "level", "matches"])

    return stored(ranked.mapInArrow(cut, "token long, node long, n long, copies long, level long, matches long"), "prefixes")


def _fits(a: str, b: str, percent: int):
    """Sizes that allow a link."""
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def _homes(sets: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """Stored (node, home, n, common, covered, lost, delta) of the sets near their leader.

    The leader of a list is its set with most copies; a set takes the leader it
    meets most often. ``covered`` sets link to it; ``delta`` is the difference.
    """
    leaders = stored(entries.groupBy("token").agg(F.max(F.struct("copies", "node", "n")).alias("top")), "leaders")
    met = (entries.join(leaders, "token").where((F.col("node") != F.col("top.node")) & _fits("n", "top.n", percent))
           .groupBy("node", F.col("top.node").alias("home")).agg(F.count(F.lit(1)).alias("times")))
    asked = met.groupBy("node").agg(F.max(F.struct("times", "home")).alias("m")).select("node", F.col("m.home").alias("home"))
    mine = sets.select("node", "n", "shared")
    theirs = sets.select(F.col("node").alias("home"), F.col("n").alias("n_home"), F.col("shared").alias("of_home"))
    both = asked.join(theirs, "home").join(mine, "node").withColumn("lost", F.array_except("of_home", "shared"))
    common = (F.size("of_home") - F.size("lost")).cast("long")
    union = F.col("n") + F.col("n_home") - F.col("common")
    return stored(both.withColumn("common", common).withColumn("covered", F.col("common") * 100 >= union * percent)
                  .where(F.col("common") * 100 >= union * max(0, 2 * percent - 100))
                  .select("node", "home", "n", F.size("of_home").cast("long").alias("of_home"), "covered",
                          F.size("lost").cast("long").alias("lost"),
                          F.concat("lost", F.array_except("shared", "of_home")).alias("delta")), "homes")


def _links_by_difference(members: pd.DataFrame, minors: pd.DataFrame, percent: int) -> tuple[list[int], list[int]]:
    """Links that connect ``minors`` with all ``members`` of one home they link to."""
    shared = np.intersect1d(np.concatenate(minors["delta"].tolist()), np.concatenate(members["delta"].tolist()))

    def grid(rows: pd.DataFrame, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(tokens)), np.float32)
        for i, delta in enumerate(rows["delta"]):
            at = np.searchsorted(tokens, delta)
            at = at[(at < len(tokens)) & (tokens[np.minimum(at, len(tokens) - 1)] == delta)] if len(tokens) else at[:0]
            out[i, at] = 1
        return out

    common = np.zeros((len(minors), len(members)), np.float32)
    for at in range(0, len(shared), 2048):
        common += grid(minors, shared[at:at + 2048]) @ grid(members, shared[at:at + 2048]).T
    lost, n = minors["lost"].to_numpy()[:, None], minors["n"].to_numpy()[:, None]
    overlap = (minors["of_home"].to_numpy()[:, None] - lost - members["lost"].to_numpy()[None, :]
               + common.astype(np.int64))
    hit = overlap * 100 >= (n + members["n"].to_numpy()[None, :] - overlap) * percent
    hit &= minors["node"].to_numpy()[:, None] != members["node"].to_numpy()[None, :]
    # Covered members are one component already: one link to any of them is enough.
    covered = members["covered"].to_numpy().astype(bool)
    name = np.where(covered, members["home"].to_numpy(), members["node"].to_numpy())
    u, v = [], []
    for i, node in enumerate(minors["node"].tolist()):
        ends = np.unique(name[hit[i]]).tolist()
        u.extend([node] * len(ends))
        v.extend(ends)
    return _forest(u, v)


def _forest(u: list[int], v: list[int]) -> tuple[list[int], list[int]]:
    """As few of the links as connect the same nodes."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    kept: tuple[list[int], list[int]] = [], []
    for a, b in zip(u, v):
        x, y = root(a), root(b)
        if x != y:
            above[x] = y
            kept[0].append(a)
            kept[1].append(b)
    return kept


def _home_links(homes: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) inside homes: of covered sets to the leader, of the others to any member.

    A home is dealt as blocks of its members against blocks of its uncovered
    sets, so no task holds a whole home.
    """
    sizes = homes.groupBy("home").agg(F.count(F.lit(1)).alias("g"), F.sum((~F.col("covered")).cast("long")).alias("b")).where("b > 0")
    cut = homes.join(sizes, "home").withColumns({
        "a_parts": F.ceil(F.col("g") / LIST_ENTRIES), "b_parts": F.ceil(F.col("b") / MINOR_ENTRIES)})
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    columns = ["home", "a", "b", "minor", "node", "n", "of_home", "covered", "lost", "delta"]
    members = cut.withColumns({"a": place("a_parts"), "minor": F.lit(False)}).withColumn("b", spread("b_parts")).select(columns)
    minors = (cut.where("NOT covered").withColumns({"b": place("b_parts"), "minor": F.lit(True)})
              .withColumn("a", spread("a_parts")).select(columns))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = _links_by_difference(pdf[~pdf["minor"]], pdf[pdf["minor"]], percent) if pdf["minor"].any() and not pdf["minor"].all() else ([], [])
        return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    inside = members.unionByName(minors).groupBy("home", "a", "b").applyInPandas(link, "u long, v long")
    return inside.unionByName(homes.where("covered").select(F.col("node").alias("u"), F.col("home").alias("v")))


def _far_links(sets: DataFrame, entries: DataFrame, homes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between sets of different components and homes that meet often enough in their prefixes."""
    known = (entries.join(labels.withColumnRenamed("root", "label"), "node", "left")
             .join(homes.select("node", "home"), "node", "left")
             .withColumns({"label": F.coalesce("label", "node"), "home": F.coalesce("home", "node")}))
    known = stored(known.select("token", "node", "n", "level", "matches", "label", "home"), "labelled")
    parts = known.groupBy("token", "label").agg(F.count(F.lit(1)).alias("m"))
    lists = stored(parts.groupBy("token").agg(F.sum("m").alias("g"), F.max(F.struct("m", "label")).alias("top"))
                   .where("g > top.m").select("token", F.col("top.label").alias("main"),
                                              F.ceil(F.col("g") / LIST_ENTRIES).alias("parts")), "lists")
    cut = known.join(lists, "token")
    left = (cut.where("label <> main").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            .drop("main", "parts").alias("x"))
    right = cut.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).drop("parts").alias("y")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    matches = F.least(x("matches"), y("matches"))
    met = (left.join(right, (x("token") == y("token")) & (x("part") == y("part")) & (x("label") != y("label"))
                     & (x("home") != y("home")) & _fits("x.n", "y.n", percent)
                     & ((y("label") == y("main")) | (x("node") < y("node"))))
           .where((x("level") <= matches) & (y("level") <= matches))
           .groupBy(F.least(x("node"), y("node")).alias("u"), F.greatest(x("node"), y("node")).alias("v"), matches.alias("matches"))
           .agg(F.count(F.lit(1)).alias("times")).where("times >= matches").select("u", "v"))
    sides = [sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("shared").alias(f"of_{c}")) for c in "uv"]
    common = F.size(F.array_intersect("of_u", "of_v"))
    return (met.join(sides[0], "u").join(sides[1], "v").withColumn("common", common)
            .where(F.col("common") * 100 >= (F.col("n_u") + F.col("n_v") - F.col("common")) * percent).select("u", "v"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least id reachable by links).

    Texts link when their sets of distinct shingles of A-Z-lowered words have a
    Jaccard similarity of ``percent`` / 100 or more; a text with fewer words is
    one shingle. Null, empty and blank texts have no shingle and link with
    nothing. Equal sets are one node, however many rows hold them. A null id
    names no component unless all its ids are null; repeated rows give repeated
    results; no other column is read.
    """
    rows = _shared_sets(docs, id_col, text_col, shingle_words, percent)
    sets = stored(rows.where("digest IS NOT NULL").groupBy("digest", F.col("n_shingles").alias("n"))
                  .agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("shared").alias("shared"))
                  .withColumn("node", F.monotonically_increasing_id()), "sets")
    entries = _prefixes(sets, percent)
    homes = _homes(sets, entries, percent)
    near = stored(_home_links(homes, percent), "near-links")
    labels = stored(connected_components(near), "labels")
    far = stored(_far_links(sets, entries, homes, labels, percent), "far-links")
    roots = connected_components(near.unionByName(far)) if far.limit(1).count() else labels
    named = stored(sets.select("digest", "node", "least_id").join(roots, "node", "left")
                   .select("digest", "least_id", F.coalesce("root", "node").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = stored(named.join(least, "root").select("digest", "component_id"), "classes")
    return (rows.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
            .select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
                    .alias("component_id")))
