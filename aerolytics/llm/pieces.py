"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie."""

from __future__ import annotations

import math
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolytics.llm.common import texts

MARK = "▁"
#: Distinct chunks whose segmentation a worker remembers.
CACHE_CHUNKS = 300_000
#: Chunks up to this length are segmented in lock step, so many at a time, and remembered.
SHORT_CHUNK = 64
LOCK_STEP = 1 << 13
#: Texts whose chunks are looked up together.
TEXTS_AT_ONCE = 256
#: How far an unknown character scores below the least piece.
UNKNOWN_PENALTY = 10.0

# Bytes of a UTF-8 character by its first byte.
_WIDTH = np.array([1] * 0xC0 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10, np.int32)


class DoubleArrayTrie:
    """Byte trie in two arrays: child c of s is base[s] + c + 1 if check there is s."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        value_of: list[int] = [-1]
        for k, key in enumerate(keys):
            s = 0
            for c in key:
                if c not in children[s]:
                    children[s][c] = len(children)
                    children.append({})
                    value_of.append(-1)
                s = children[s][c]
            value_of[s] = k
        self.base, self.check, self.value = [0], [-2], [-1]
        # Cells before ``search_from`` are nearly all taken and no longer looked at.
        place, search_from = {0: 0}, 1
        for node, kids in enumerate(children):  # parents come before their children
            if not kids:
                continue
            codes = sorted(kids)
            cell, taken = max(search_from, codes[0] + 1) - 1, 0
            while True:
                cell += 1
                if not self._free(cell):
                    taken += 1
                elif all(self._free(cell + c - codes[0]) for c in codes):
                    break
            if taken > 0.9 * (cell - search_from + 1):
                search_from = cell
            s, b = place[node], cell - codes[0] - 1
            self.base[s] = b
            for c in codes:
                t = b + c + 1
                self.check[t], self.value[t] = s, value_of[kids[c]]
                place[kids[c]] = t
        self._free(max(self.base) + 257)  # every step from every state stays inside

    def _free(self, t: int) -> bool:
        if t >= len(self.check):
            more = t + 257 - len(self.check)
            self.base += [0] * more
            self.check += [-1] * more
            self.value += [-1] * more
        return self.check[t] == -1

    def prefixes(self, key: bytes, start: int = 0):
        """(end, value) of every key that starts at ``start``."""
        s = 0
        for end in range(start, len(key)):
            t = self.base[s] + key[end] + 1
            if self.check[t] != s:
                return
            s = t
            if self.value[t] >= 0:
                yield end + 1, self.value[t]


def log_scores(scores: list[float], unigram: bool) -> list[float]:
    """Log scores of the normal pieces.

    A unigram model stores them. A merge model stores only an order (minus the
    merge's rank), which becomes the log of a Zipf law over that order.
    """
    if unigram:
        return list(scores)
    order = sorted(set(scores), reverse=True)
    below, rank = 0, {}
    for s in order:
        rank[s] = below + 1
        below += 1
    norm = math.log(sum(1 / rank[s] for s in scores))
    return [-math.log(rank[s]) - norm for s in scores]


# Texts that a character map or white-space removal changes.
NORMALISER_PROBES = ("a  b", "a b ", "\uFB01", "\u2460", "e\u0301", "A", "\uFF21", "a\u00A0b")


class PieceModel:
    """Pieces, log scores and byte pieces of one model file."""

    def __init__(self, path: str, unigram: bool = False):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        # A model that changes its text before segmenting would give other ids than these.
        changed = [t for t in NORMALISER_PROBES if model.decode(model.encode(t)) != t]
        if changed:
            raise ValueError(f"the model normalises its text (it changes {changed[0]!r}), which is not supported")
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
                   for i in range(size)]
        self.normal = [i for i in range(size) if not special[i]]
        pieces = {i: model.id_to_piece(i) for i in range(size)}
        self.byte_id = {int(pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        values = log_scores([model.get_score(i) for i in self.normal], unigram)
        self.scores = values
        self.unknown = min(values) - UNKNOWN_PENALTY
        self.unknown_id = model.unk_id()
        self.trie = DoubleArrayTrie([pieces[i].encode() for i in self.normal])
        self.longest = max(len(pieces[i].encode()) for i in self.normal)
        # What a piece stands for in decoded text; control pieces stand for nothing.
        self.surface = [b""] * size
        for i in self.normal:
            self.surface[i] = pieces[i].replace(MARK, " ").encode()
        for b, i in self.byte_id.items():
            self.surface[i] = bytes([b])
        self.is_byte = np.zeros(size, bool)
        self.is_byte[list(self.byte_id.values())] = True
        # What an id adds to the score; an unknown character's falls to its first byte.
        self.score_of = np.zeros(size)
        self.score_of[self.normal] = values
        self.score_of[[i for b, i in self.byte_id.items() if not 0x80 <= b < 0xC0] or [self.unknown_id]] = self.unknown
        # No piece continues past the start of a marker run that follows other
        # text, nor over a line end unless some piece holds one: a best path
        # breaks there, so the chunks between can be segmented one by one.
        alone = "" if any("\n" in pieces[i] for i in self.normal) else "\n"
        self.chunks = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|{alone}" if alone else ""))
        self.segments: dict[str, bytes] = {}
        self.arrays = [np.array(x, np.int32) for x in (self.trie.base, self.trie.check, self.trie.value)]
        self.byte_ids = np.array([self.byte_id.get(b, self.unknown_id) for b in range(256)], np.int32)

    def viterbi(self, chunk: bytes) -> list[int]:
        """Ids of the best segmentation; of equal paths the earlier start wins."""
        n, base, check, value, scores = len(chunk), self.trie.base, self.trie.check, self.trie.value, self.scores
        best, start, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here == -math.inf:  # inside a character
                continue
            lead = chunk[i]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            s, end, single = 0, i, i + width
            for c in chunk[i:i + self.longest]:
                t = base[s] + c + 1
                if check[t] != s:
                    break
                s = t
                end += 1
                v = value[t]
                if v >= 0:
                    if here + scores[v] > best[end]:
                        best[end], start[end], piece[end] = here + scores[v], i, v
                    if end == i + width:
                        single = 0
            if single and here + self.unknown > best[single]:
                best[single], start[single], piece[single] = here + self.unknown, i, -1
        ids, at = [], n
        while at:
            if piece[at] >= 0:
                ids.append(self.normal[piece[at]])
            elif self.byte_id:
                ids.extend([self.byte_id[b] for b in reversed(chunk[start[at]:at])])
            else:
                ids.append(self.unknown_id)
            at = start[at]
        ids.reverse()
        return ids

    def viterbi_many(self, chunks: list[bytes]) -> list[bytes]:
        """``viterbi`` of many short chunks in lock step; ids as bytes, chunk by chunk.

        All chunks advance by one start position and one trie step at a time;
        chunks of like length go together.
        """
        lengths = np.array([len(c) for c in chunks], np.int64)
        out: list[bytes] = [b""] * len(chunks)
        by_length = np.argsort(lengths, kind="stable")
        for at in range(0, len(chunks), LOCK_STEP):
            rows = by_length[at:at + LOCK_STEP]
            parts = self._lock_step([chunks[r] for r in rows], lengths[rows])
            for r, part in zip(rows.tolist(), parts):
                out[r] = part
        return out

    def _lock_step(self, chunks: list[bytes], lengths: np.ndarray) -> list[bytes]:
        base, check, value = self.arrays
        scores = np.array(self.scores)
        n, longest = len(chunks), int(lengths.max())
        text = np.zeros((n, longest), np.int32)
        inside = np.arange(longest) < lengths[:, None]
        text[inside] = np.frombuffer(b"".join(chunks), np.uint8)
        width = _WIDTH[text]
        best, start = np.full((n, longest + 1), -np.inf), np.zeros((n, longest + 1), np.int32)
        piece = np.full((n, longest + 1), -1, np.int32)
        best[:, 0] = 0.0
        for i in range(longest):
            first = np.flatnonzero(inside[:, i] & (best[:, i] > -np.inf))
            rows, state, known = first, np.zeros(len(first), np.int32), np.zeros(n, bool)
            for end in range(i + 1, min(longest, i + self.longest) + 1):
                step = base[state] + text[rows, end - 1] + 1
                on = (check[step] == state) & inside[rows, end - 1]
                rows, state = rows[on], step[on]
                if not len(rows):
                    break
                found = value[state]
                ends = found >= 0
                hit, found = rows[ends], found[ends]
                total = best[hit, i] + scores[found]
                better = total > best[hit, end]
                best[hit[better], end], start[hit[better], end] = total[better], i
                piece[hit[better], end] = found[better]
                known[hit[width[hit, i] == end - i]] = True
            lone = first[~known[first]]
            end = np.minimum(i + width[lone, i], longest)
            better = best[lone, i] + self.unknown > best[lone, end]
            lone, end = lone[better], end[better]
            best[lone, end], start[lone, end], piece[lone, end] = best[lone, i] + self.unknown, i, -1
        # Every chunk walks back from its end; the steps are then put in order.
        steps, at = [], lengths.copy()
        rows = np.flatnonzero(at)
        while len(rows):
            end = at[rows]
            begin = start[rows, end]
            steps.append((rows, begin, end, piece[rows, end]))
            at[rows] = begin
            rows = rows[begin > 0]
        row, begin, end, found = (np.concatenate(c) for c in zip(*steps))
        order = np.lexsort((begin, row))
        row, begin, end, found = row[order], begin[order], end[order], found[order]
        # A piece is one id, an unknown character one id per byte (or one unknown id).
        size = np.where(found >= 0, 1, end - begin if self.byte_id else 1)
        of = np.repeat(np.arange(len(row)), size)
        offset = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        ids = np.where(found[of] >= 0, np.array(self.normal, np.int32)[found[of]],
                       self.byte_ids[text[row[of], begin[of] + offset]]).astype(np.int32)
        cuts = np.concatenate([[0], np.cumsum(np.bincount(row, size, n))]).astype(np.int64) * 4
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; spaces become markers, one more stands before the text."""
        out = []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            chunks = [self.chunks.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts[at:at + TEXTS_AT_ONCE]]
            if len(self.segments) >= CACHE_CHUNKS:
                self.segments.clear()
            new = list(set().union(*chunks).difference(self.segments))
            short = [c for c in new if len(c) <= SHORT_CHUNK]
            self.segments.update(zip(short, self.viterbi_many([c.encode() for c in short])))
            long = {c: np.array(self.viterbi(c.encode()), np.int32).tobytes() for c in new if len(c) > SHORT_CHUNK}
            self.segments.update(long)
            out += [np.frombuffer(b"".join(map(self.segments.__getitem__, c)), np.int32) for c in chunks]
            for c in long:
                del self.segments[c]
        return out

    def encode(self, text: str) -> tuple[np.ndarray, float]:
        """Ids and score of one text."""
        ids = self.encode_many([text])[0]
        return ids, self.score(ids)

    def score(self, ids: np.ndarray) -> float:
        return float(self.score_of[ids].sum())

    def decode(self, ids) -> str:
        """Text of ids: markers become spaces, the one before the text goes, byte runs become characters."""
        surface = self.surface
        out = b"".join([surface[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


@lru_cache(maxsize=2)
def load(path: str, unigram: bool = False) -> PieceModel:
    return PieceModel(path, unigram)


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def encode(text: Column, model: str | None = None, unigram: bool = False) -> Column:
    """Column of piece ids; null stays null, an empty text has no ids."""
    path = model or default_model()

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        m = load(path, unigram)
        found = texts(column)
        ids = m.encode_many([t or "" for t in found])
        return pa.array([None if t is None else i for t, i in zip(found, ids)], pa.list_(pa.int32()))

    return ids(text)


def decode(ids: Column, model: str | None = None, unigram: bool = False) -> Column:
    """Column of texts from piece ids; null stays null. Ids outside the model are an error."""
    path = model or default_model()

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        m = load(path, unigram)
        return pa.array([None if i is None else m.decode(i) for i in column.to_pylist()], pa.string())

    return text(ids)


_FIELDS = {"n_tokens": ("long", pa.int64()), "n_byte_tokens": ("long", pa.int64()), "ids_crc32": ("long", pa.int64()),
           "score": ("double", pa.float64()), "round_trip": ("boolean", pa.bool_())}


def piece_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 model: str | None = None, unigram: bool = False) -> DataFrame:
    """Per row: id, token and byte-token counts, digest of the ids, score, round trip.

    ``ids_crc32`` is over little-endian unsigned 32-bit ids. ``round_trip``
    tells whether decoding gives the text back, with marker characters of the
    text read as spaces. Null and empty texts have no tokens. Repeated rows and
    null ids are encoded row by row; no other column is read.
    """
    path = model or default_model()

    @F.arrow_udf("struct<" + ",".join(f"{n}:{t}" for n, (t, _) in _FIELDS.items()) + ">")
    def report(column: pa.Array) -> pa.Array:
        m, out = load(path, unigram), []
        found = [t or "" for t in texts(column)]
        for at in range(0, len(found), TEXTS_AT_ONCE):  # ids of a whole batch are never held
            part = found[at:at + TEXTS_AT_ONCE]
            for t, ids in zip(part, m.encode_many(part)):
                out.append((len(ids), int(m.is_byte[ids].sum()), zlib.crc32(ids.astype("<u4").tobytes()),
                            round(m.score(ids), 6), m.decode(ids.tolist()) == t.replace(MARK, " ")))
        columns = list(zip(*out)) or [()] * len(_FIELDS)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS.values())], list(_FIELDS))

    return (docs.select(F.col(f"`{id_col}`").alias("doc_id"), report(F.col(f"`{text_col}`")).alias("r"))
            .select("doc_id", *[F.col(f"r.{n}").alias(n) for n in _FIELDS]))
