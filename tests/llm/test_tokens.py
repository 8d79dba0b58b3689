"""SentencePiece and packing against the libraries and brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolytics.llm import packing, pieces
from tests.llm.cases import bag, empty, messy, messy_rows, prose


@pytest.fixture(scope="module")
def model():
    return pieces.load(pieces.default_model())


def texts():
    rng = random.Random(8)
    alphabet = "abcdefghijklmnop  \n.▁é漢\U0001F600\x00"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(60)] + [
        t for _, t in messy_rows() if t] + ["Hello   world", "▁", " ", "    x", "\n"]


def test_double_array_trie_holds_exactly_its_keys():
    rng = random.Random(1)
    keys = sorted({bytes(rng.randrange(256) for _ in range(rng.randrange(1, 6))) for _ in range(3000)})
    trie = pieces.DoubleArrayTrie(keys)
    for k, key in enumerate(keys):
        want = [(n, keys.index(key[:n])) for n in range(1, len(key) + 1) if key[:n] in set(keys)]
        if k % 50 == 0:
            assert list(trie.prefixes(key)) == want
    assert list(trie.prefixes(b"")) == []


def brute(model, chunk: str):
    """Plain dynamic programme over character positions with a dictionary of pieces."""
    table = {p: i for i, p in enumerate(model.pieces_by_text)}
    best = [0.0] + [-math.inf] * len(chunk)
    for i in range(len(chunk)):
        known = False
        for j in range(i + 1, min(len(chunk), i + 48) + 1):
            v = table.get(chunk[i:j])
            if v is not None:
                best[j] = max(best[j], best[i] + model.scores[v])
                known = known or j == i + 1
        if not known:
            best[i + 1] = max(best[i + 1], best[i] + model.unknown)
    return best[-1]


def test_viterbi_reaches_the_best_score(model):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    model.pieces_by_text = [sp.id_to_piece(i) for i in model.normal]
    for text in texts():
        if len(text) < 3000:
            _, score = model.encode(text)
            assert score == pytest.approx(brute(model, "▁" + text.replace(" ", "▁")), abs=1e-6)


def test_lock_step_and_single_chunks_agree(model):
    rng = random.Random(6)
    chunks = ["".join(rng.choice("▁abcthe.é漢\x00\U0001F600") for _ in range(rng.randrange(1, 30))).encode()
              for _ in range(3000)]
    assert model.viterbi_many(chunks) == [np.array(model.viterbi(c), np.int32).tobytes() for c in chunks]


def test_ids_equal_the_library_with_the_same_scores(model):
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece
    m = proto.ModelProto()
    with open(pieces.default_model(), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for i, s in zip(model.normal, model.scores):
        m.pieces[i].score = s
    library = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    for text in texts():
        if len(text) < 3000:
            want = library.encode(text)
            assert model.encode(text)[0].tolist() == want
            assert model.decode(want) == library.decode(want).replace("▁", " ")


def test_encode_decode_round_trip(spark):
    docs = messy(spark)
    ids = docs.select("doc_id", "text", pieces.encode(F.col("text")).alias("ids"))
    back = ids.select("text", pieces.decode(F.col("ids")).alias("back"))
    assert [r for r in back.collect() if (r["text"] or "").replace("▁", " ") != (r["back"] or "")] == []
    report = pieces.piece_report(docs)
    assert report.where("not round_trip").count() == 0
    ids_of = {r["text"]: r["ids"] for r in ids.collect()}
    want = sorted(((i, len(ids_of[t] or []), zlib.crc32(np.array(ids_of[t] or [], "<u4").tobytes()))
                   for i, t in messy_rows()), key=repr)
    assert bag(report, "doc_id", "n_tokens", "ids_crc32") == want
    assert pieces.piece_report(empty(spark)).collect() == []


def test_log_scores_of_both_kinds():
    assert pieces.log_scores([-1.5, -2.0], True) == [-1.5, -2.0]
    zipf = pieces.log_scores([-1.0, -2.0, -1e9, -1e9], False)
    assert zipf[0] > zipf[1] > zipf[2] == zipf[3] and sum(map(math.exp, zipf)) == pytest.approx(1)


def test_ids_equal_the_tokenizers_library():
    from tokenizers import Tokenizer
    path = packing.default_vocabulary()
    library, encode = Tokenizer.from_file(path), packing.encoder(path)
    for text in [*texts(), "a<|endoftext|>b", "x" * 20_000, " " * 5000 + "y", "\n\n \n"]:
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_cut_pieces():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]


@pytest.mark.parametrize("seed", range(12))
def test_packing_of_counts_is_whole_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 1024])
    counts = Counter(rng.randint(1, capacity) if seed % 2 else rng.randint(capacity // 3, capacity)
                     for _ in range(rng.randrange(1, 900)))
    bins = packing.best_fit(dict(counts), capacity)
    for packed in (bins, packing.local_search(bins, capacity)):
        assert all(0 < sum(p) <= capacity for p in packed)
        back = Counter()
        for p, n in packed.items():
            for x in p:
                back[x] += n
        assert back == counts
    # Never more bins than plain best fit over single pieces.
    rooms = []
    for x in sorted(counts.elements(), reverse=True):
        fit = min((r for r in rooms if r >= x), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((capacity if fit is None else fit) - x)
    assert sum(packing.local_search(bins, capacity).values()) <= len(rooms)


def test_local_search_moves_and_exchanges_empty_a_bin():
    assert sum(packing.local_search(Counter({(6,): 1, (4,): 1}), 10).values()) == 1
    # 7+2 | 6+2 | 3: the 3 fits once 2 and 3 change places.
    assert sum(packing.local_search(Counter({(7, 2): 1, (6, 2): 1, (3,): 1}), 10).values()) == 2
    assert packing._best_exchange((3, 2), (6, 1), 10) is not None


def test_local_search_leaves_no_exchange():
    rng = random.Random(1)
    counts = Counter(min(1024, int(rng.lognormvariate(math.log(400), 0.6)) + 1) for _ in range(3000))
    found = packing.local_search(packing.best_fit(dict(counts), 1024), 1024)
    assert sum(found.values()) > -(-sum(x * n for x, n in counts.items()) // 1024)
    under = [p for p in found if sum(p) < 1024]
    assert [(g, t) for g in under for t in under
            if (g != t or found[g] > 1) and packing._best_exchange(g, t, 1024) is not None] == []


def test_packed_documents_are_whole_and_gapless(spark):
    docs = messy(spark)
    out = packing.pack_documents(docs, max_tokens=64, keep_ids=False).collect()
    encode = packing.encoder(packing.default_vocabulary())
    want = Counter()
    for i, t in messy_rows():
        ids = np.append(encode(t or ""), np.uint32(2)).astype("<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 64)):
            want[i, k, s, n, zlib.crc32(ids[s:s + n].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert len(bins) <= -(-sum(r["length"] for r in out) // 64) + 1
    assert packing.pack_documents(empty(spark)).collect() == []


def test_tokenize_keeps_ids_on_request(spark):
    docs = spark.createDataFrame([(1, prose(random.Random(1), 50))], "doc_id long, text string")
    row = packing.tokenize(docs, keep_ids=True).first()
    assert zlib.crc32(np.array(row["ids"], "<u4").tobytes()) == row["ids_crc32"] and row["ids"][-1] == 2


def test_a_model_that_normalises_is_refused(monkeypatch):
    import sentencepiece

    class Normalising(sentencepiece.SentencePieceProcessor):
        def encode(self, text, *a, **k):
            return super().encode(" ".join(text.split()), *a, **k)

    pieces.PieceModel(pieces.default_model())
    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Normalising)
    with pytest.raises(ValueError, match="normalises"):
        pieces.PieceModel(pieces.default_model())


def test_equal_rows_are_dealt_over_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 20)
    docs = spark.createDataFrame([(1, "same text")] * 300 + [(2, "other")], "doc_id long, text string").repartition(4)
    out = packing.pack_documents(docs, max_tokens=16)
    assert "tag" not in out.columns and out.count() == 301
    places = [(r["sequence_id"], r["offset"], r["length"]) for r in out.collect()]
    assert len(set(places)) == 301  # every copy has a place of its own
    fill = Counter()
    for s, _, n in places:
        fill[s] += n
    assert max(fill.values()) <= 16
