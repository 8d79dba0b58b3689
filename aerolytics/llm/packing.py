"""Best-fit packing of token sequences with a swap-based local search.

Pieces of one length are interchangeable, so the search works on how many
pieces each length has (at most ``max_tokens`` numbers, whatever the corpus
size) and on classes of equal bins. Spark tokenizes, counts the lengths, and
gives every piece its place: the k-th piece of a length takes the k-th place
that the packing has for that length.
"""

from __future__ import annotations

import bisect
import heapq
import json
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerolytics.llm.common import stored, texts

MAX_TOKENS = 1024
END_ID = 2
#: Pieces of one length that a numbering window holds on average.
SHARD_PIECES = 1 << 18

# Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """text -> uint32 ids, equal to the ``tokenizers`` library's on ``vocabulary``.

    The file's vocabulary runs in tiktoken, which takes a fifth of the time. Its
    regular expression engine gives up on some very long runs; those texts go
    to ``tokenizers`` itself.
    """
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}
    ranks = {bytes(byte_of[ch] for ch in token): i for token, i in spec["model"]["vocab"].items()
             if token not in special}
    fast = tiktoken.Encoding("vocabulary", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens=special)
    slow = []

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as gave_up:  # the engine's panics are no Exception
            if isinstance(gave_up, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            if not slow:
                from tokenizers import Tokenizer
                slow.append(Tokenizer.from_file(vocabulary))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def cut(n: int, max_tokens: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter."""
    first = (n - 1) % max_tokens + 1
    return [(0, first)] + [(s, max_tokens) for s in range(first, n, max_tokens)]


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS,
             vocabulary: str | None = None, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids if asked).

    Every document's ids end with ``end_id``, so null and empty texts give one
    piece of one token. Repeated rows and null ids give pieces of their own.
    """
    vocabulary = vocabulary or default_vocabulary()
    fields = [("piece", pa.int32(), "int"), ("start", pa.int64(), "long"), ("length", pa.int32(), "int"),
              ("ids_crc32", pa.int64(), "long")] + [("ids", pa.list_(pa.int32()), "array<int>")] * keep_ids
    kind = pa.list_(pa.struct([(n, t) for n, t, _ in fields]))

    @F.arrow_udf("array<struct<" + ",".join(f"{n}:{s}" for n, _, s in fields) + ">>")
    def pieces(column: pa.Array) -> pa.Array:
        encode, out = encoder(vocabulary), []
        for text in texts(column):
            ids = np.append(encode(text) if text else np.empty(0, np.uint32), np.uint32(end_id)).astype("<u4")
            out.append([{"piece": k, "start": s, "length": n, "ids_crc32": zlib.crc32(ids[s:s + n].tobytes())}
                        | ({"ids": ids[s:s + n].astype(np.int32)} if keep_ids else {})
                        for k, (s, n) in enumerate(cut(len(ids), max_tokens))])
        return pa.array(out, kind)

    return (docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.explode(pieces(F.col(f"`{text_col}`"))).alias("p"))
            .select("doc_id", *[F.col(f"p.{n}").alias(n) for n, _, _ in fields]))


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing over length counts: bin pattern (lengths, descending) -> bins.

    Equal bins are one class, so the work depends on the number of lengths and
    classes, not on the number of pieces.
    """
    open_: dict[int, Counter] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple, bins: int) -> None:
        if room not in open_:
            open_[room] = Counter()
            bisect.insort(rooms, room)
        open_[room][pattern] += bins

    def fill(room: int, pattern: tuple, bins: int, length: int, left: int) -> int:
        """Put up to ``left`` pieces into these bins; returns those put."""
        each = room // length
        full = min(bins, left // each)
        if full:
            put(room - each * length, pattern + (length,) * each, full)
        rest = left - full * each
        if full < bins and rest and rest < each:
            put(room - rest * length, pattern + (length,) * rest, 1)
            full, rest = full + 1, 0
        if bins > full:
            put(room, pattern, bins - full)
        return left - rest

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                left -= fill(capacity, (), -(-left // (capacity // length)), length, left)
                continue
            room = rooms[at]
            pattern, bins = open_[room].popitem()
            if not open_[room]:
                del open_[room], rooms[at]
            left -= fill(room, pattern, bins, length, left)
    out: Counter = Counter()
    for patterns in open_.values():
        out.update({p: n for p, n in patterns.items() if n})
    return out


def _best_exchange(giver: tuple, taker: tuple, capacity: int):
    """The move or exchange that fills ``taker`` most: (given, taken) or None.

    Moves one piece, or exchanges one for one, two for one or one for two; the
    taker gains, and the sum of squared fills grows by 2 d (b - a + d).
    """
    a, b = sum(giver), sum(taker)
    room, best = capacity - b, None
    gifts = [(x,) for x in dict.fromkeys(giver)]
    pairs = list(dict.fromkeys((x, y) for i, x in enumerate(giver) for y in giver[i + 1:]))
    backs = [(), *[(x,) for x in dict.fromkeys(taker)]]
    back_pairs = list(dict.fromkeys((x, y) for i, x in enumerate(taker) for y in taker[i + 1:]))
    for given, takens in ((gifts, backs), (pairs, backs[1:]), (gifts, back_pairs)):
        for g in given:
            for t in takens:
                d = sum(g) - sum(t)
                if 0 < d <= room and b - a + d > 0 and (best is None or d > best[0]):
                    best = (d, g, t)
    return best and best[1:]


def _changed(pattern: tuple, out: tuple, into: tuple) -> tuple:
    left = list(pattern)
    for x in out:
        left.remove(x)
    return tuple(sorted([*left, *into], reverse=True))


class _Parts:
    """What the underfull classes can part with: no piece, one or two, by size and by the rest that stays.

    A part of size s and rest r against one of size t and rest q raises the
    squared fill by 2 (s - t) (q - r); it fits the taker if q + s <= capacity.
    So per rest only the least size counts of takers, per size the least rest of givers.
    """

    #: Pieces given -> pieces taken.
    TAKES = {1: (0, 1, 2), 2: (1,)}

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.classes: dict[tuple[int, int, int], dict[tuple, tuple]] = {}
        self.sizes = [[[] for _ in range(capacity + 1)] for _ in range(3)]
        self.rests = [[[] for _ in range(capacity + 1)] for _ in range(3)]
        self.least_size = np.full((3, capacity + 1), capacity + 1)
        self.least_rest = np.full((3, capacity + 1), capacity + 1)
        self.steps = np.arange(1, capacity + 1)

    @staticmethod
    def of(pattern: tuple) -> dict[tuple[int, int], tuple]:
        """(pieces, size) -> one part of that kind."""
        pairs = {(2, x + y): (x, y) for i, x in enumerate(pattern) for y in pattern[i + 1:]}
        return {(0, 0): (), **{(1, x): (x,) for x in pattern}, **pairs}

    def add(self, pattern: tuple) -> None:
        fill = sum(pattern)
        for (k, s), part in self.of(pattern).items():
            r = fill - s
            same = self.classes.setdefault((k, s, r), {})
            if not same:
                bisect.insort(self.sizes[k][r], s)
                self.least_size[k, r] = self.sizes[k][r][0]
                bisect.insort(self.rests[k][s], r)
                self.least_rest[k, s] = self.rests[k][s][0]
            same[pattern] = part

    def drop(self, pattern: tuple) -> None:
        fill, none = sum(pattern), self.capacity + 1
        for k, s in self.of(pattern):
            r = fill - s
            same = self.classes[k, s, r]
            del same[pattern]
            if not same:
                del self.classes[k, s, r]
                for lists, least, at, v in ((self.sizes, self.least_size, r, s), (self.rests, self.least_rest, s, r)):
                    found = lists[k][at]
                    del found[bisect.bisect_left(found, v)]
                    least[k, at] = found[0] if found else none

    def best_exchange(self, pattern: tuple):
        """The exchange of this class, as giver or taker, that raises the squared fill most.

        (giver, taker, given, taken), or None if no class has one with it.
        """
        fill = sum(pattern)
        room = self.capacity - fill
        steps, best, found = self.steps[:room], 0, None
        for (k, s), part in self.of(pattern).items():
            r = fill - s
            for other in self.TAKES.get(k, ()):  # as giver: least sizes over the rests r + 1, r + 2, ...
                gains = (s - self.least_size[other, r + 1:r + 1 + room]) * steps
                at = int(gains.argmax())
                if gains[at] > best:
                    q = r + 1 + at
                    best, found = gains[at], (True, part, (other, int(self.least_size[other, q]), q))
            for other in self.TAKES:  # as taker: least rests over the sizes s + 1, s + 2, ...
                if k in self.TAKES[other]:
                    gains = (r - self.least_rest[other, s + 1:s + 1 + room]) * steps
                    at = int(gains.argmax())
                    if gains[at] > best:
                        t = s + 1 + at
                        best, found = gains[at], (False, part, (other, t, int(self.least_rest[other, t])))
        if found is None:
            return None
        gives, part, key = found
        partner, back = next(iter(self.classes[key].items()))
        return (pattern, partner, part, back) if gives else (partner, pattern, back, part)


def local_search(bins: Counter, capacity: int) -> Counter:
    """Exchanges between underfull bins until none raises the squared fill.

    Every class is held against all others, the emptiest first, and again only
    after it was made anew or became a class of two bins; so when none is left
    to look at, no two bins have an exchange. A change is applied to as many
    bins as both classes have. Bins whose pieces are all gone vanish.
    Stops at the lower bound ceil(tokens / capacity), which cannot be beaten.
    """
    bins = Counter({p: n for p, n in bins.items() if p and n})
    least = -(-sum(sum(p) * n for p, n in bins.items()) // capacity)
    total = sum(bins.values())
    if total <= least:
        return bins
    parts = _Parts(capacity)
    for p in bins:
        if sum(p) < capacity:
            parts.add(p)
    waiting = [(sum(p), p) for p in bins if sum(p) < capacity]
    heapq.heapify(waiting)

    def change(pattern: tuple, n: int) -> None:
        before, now = bins[pattern], bins[pattern] + n
        bins[pattern] = now
        if not now:
            del bins[pattern]
        fill = sum(pattern)
        if fill < capacity:
            if not before:
                parts.add(pattern)
            elif not now:
                parts.drop(pattern)
            if n > 0 and before < 2:
                heapq.heappush(waiting, (fill, pattern))

    while waiting and total > least:
        fill, pattern = heapq.heappop(waiting)
        if pattern not in bins:
            continue
        alone = bins[pattern] == 1
        if alone:  # one bin has no exchange with itself
            parts.drop(pattern)
        found = parts.best_exchange(pattern)
        if alone:
            parts.add(pattern)
        if found is None:
            continue
        giver, taker, given, taken = found
        n = bins[giver] // 2 if taker == giver else min(bins[giver], bins[taker])
        change(giver, -n)
        change(taker, -n)
        for new in (_changed(giver, given, taken), _changed(taker, taken, given)):
            if new:
                change(new, n)
            else:
                total -= n
        if pattern in bins:
            heapq.heappush(waiting, (fill, pattern))
    return bins


def places(bins: Counter) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first ordinal, first bin and offset of each run of equal places, by ordinal."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    first_bin = 0
    for pattern, n in sorted(bins.items(), reverse=True):
        offset = 0
        for length in pattern:
            runs.setdefault(length, []).append((used[length], first_bin, offset))
            used[length] += n
            offset += length
        first_bin += n
    return {length: tuple(np.array(c, np.int64) for c in zip(*r)) for length, r in runs.items()}


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, ...).

    ``pieces`` is read twice and should be stored. Only the count per length
    (at most ``max_tokens`` rows) reaches the driver. The k of a piece comes
    from windows over (length, shard), which stay bounded when one length holds
    most pieces, plus the shard's offset. A ``tag`` column that tells equal rows
    apart keeps them bounded too when one row is repeated very often.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    at = places(local_search(best_fit(counts, max_tokens), max_tokens))
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(parts, sum(counts.values()) // SHARD_PIECES)
    row = [c for c in ("doc_id", "piece", "start", "ids_crc32", "tag") if c in pieces.columns]
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64(*row), F.lit(shards)))
    sizes = sharded.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "shard", F.coalesce(F.sum("n").over(
        W.partitionBy("length").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    k = F.row_number().over(W.partitionBy("length", "shard").orderBy(*row)) - 1
    numbered = sharded.withColumn("k", k).join(before, ["length", "shard"]).withColumn("k", F.col("k") + F.col("before"))

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(length: pa.Array, k: pa.Array) -> pa.Array:
        lengths, ks = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (length, k))
        bins, offsets = np.empty(len(ks), np.int64), np.empty(len(ks), np.int64)
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            first, first_bin, offset = at[int(n)]
            run = np.searchsorted(first, ks[rows], side="right") - 1
            bins[rows] = first_bin[run] + ks[rows] - first[run]
            offsets[rows] = offset[run]
        return pa.StructArray.from_arrays([pa.array(bins), pa.array(offsets)], ["sequence_id", "offset"])

    return (numbered.withColumn("at", place("length", "k"))
            .select(*pieces.columns, F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset")))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   max_tokens: int = MAX_TOKENS, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Tokenizes, cuts and packs: one row per piece with its sequence and place.

    Null and empty texts are one end token; repeated rows and null ids are
    packed row by row; an empty table gives an empty result.
    """
    # Stored with the tag, so that both readings of the pieces see the same one.
    cut_up = stored(tokenize(docs, id_col, text_col, max_tokens, vocabulary, keep_ids=keep_ids)
                    .withColumn("tag", F.monotonically_increasing_id()), "pieces")
    return pack(cut_up, max_tokens).drop("tag")
