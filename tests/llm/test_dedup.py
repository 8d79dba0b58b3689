"""Exact, near, substring and suffix deduplication against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from aerolytics.llm import blocks, components, exact, simhash, substrings, suffixes
from tests.llm.cases import bag, empty, messy, messy_rows


def test_quotient_filter_round_trip_and_merge():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 500, np.uint64) * np.uint64(2)
    values = np.concatenate([values, values[:100], np.array([0, 0, 2 ** 64 - 1], np.uint64)])
    parts = [exact.CountingQuotientFilter.build(*exact._add_up(v, np.ones(len(v), np.uint64)))
             for v in np.array_split(values, 4)]
    again = [exact.CountingQuotientFilter.from_bytes(f.to_bytes()) for f in parts]
    fps, counts = exact.CountingQuotientFilter.merge(again).items()
    assert dict(zip(fps.tolist(), counts.tolist())) == Counter(values.tolist())


def test_exact_dedup_matches_brute_force(spark):
    rows = [(i, t or "") for i, t in messy_rows()]
    size = Counter(t for _, t in rows)
    last = {t: max((i for i, x in rows if x == t and i is not None), default=None) for t in size}
    got = bag(exact.exact_dedup(messy(spark)), "doc_id", "keep_id", "group_size", "text_sha256")
    want = sorted(((i, last[t] if size[t] > 1 else i, size[t], hashlib.sha256(t.encode()).hexdigest())
                   for i, t in rows), key=repr)
    assert got == want
    kept = Counter(r[0] for r in bag(exact.exact_dedup(messy(spark)).where("kept"), "text_sha256"))
    assert set(kept.values()) == {1} and len(kept) == len(size)
    assert exact.exact_dedup(empty(spark)).collect() == []


def test_drop_exact_copies_keeps_columns_and_one_of_each(spark):
    out = exact.drop_exact_copies(messy(spark))
    assert out.columns == messy(spark).columns
    kept = Counter((r["text"] or "") for r in out.collect())
    assert kept == dict.fromkeys({t or "" for _, t in messy_rows()}, 1)
    assert exact.drop_exact_copies(empty(spark)).collect() == []


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(rows):
    fps = {f for _, f in rows}
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for i, f in rows:
        least[find(f)].append(i)
    named = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    return [(i, f"{f:016x}", named[find(f)]) for i, f in rows]


def test_simhash_fingerprints_and_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 1000)
    rows = [(i, brute_fingerprint(t)) for i, t in messy_rows()]
    got = bag(simhash.near_duplicates(messy(spark)), "doc_id", "fingerprint", "component_id")
    assert got == sorted(brute_components(rows), key=repr)
    assert simhash.near_duplicates(empty(spark)).collect() == []


@pytest.mark.parametrize("key_rows", [4096, 8])
def test_simhash_links_lose_nothing_in_dense_groups(spark, key_rows):
    rng = np.random.default_rng(3)
    fps = set(rng.integers(0, 1 << 63, 60).tolist())
    for centre in list(fps)[:6]:
        for _ in range(60):
            x = centre
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << b
            fps.add(x)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3), key_rows=key_rows)
    rows = links.collect()
    assert all(((r["u"] ^ r["v"]) & (2 ** 64 - 1)).bit_count() for r in rows)
    root = {(r["node"] & (2 ** 64 - 1)): r["root"] for r in components.connected_components(links).collect()}
    want = {f: c for f, _, c in brute_components([(f, f) for f in fps])}
    groups = defaultdict(set)
    for f in fps:
        groups[root.get(f, f)].add(want[f])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_drop_near_duplicates_keeps_one_row_per_component(spark):
    # One id in two components would give both the same component_id.
    docs = messy(spark).where("text is null or text <> 'short text'")
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    rows = [(i, brute_fingerprint(t)) for i, t in messy_rows() if t != "short text"]
    component = {(i, f): c for (i, f), (_, _, c) in zip(rows, brute_components(rows))}
    kept = [component[i, brute_fingerprint(t)] for i, t in ((r["doc_id"], r["text"]) for r in out.collect())]
    assert len(kept) == len(set(kept)) and set(kept) == set(component.values())


def test_components_of_a_long_chain_loops_and_nothing(spark):
    edges = [(i, i + 1) for i in range(200)] + [(7, 7), (500, 501), (501, 500)]
    got = dict(bag(components.connected_components(spark.createDataFrame(edges, "u long, v long")), "node", "root"))
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def brute_windows(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k:k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window, block_bytes", [(35, 8 << 20), (35, 3000), (3, 20_000)])
def test_word_windows_match_brute_force(spark, monkeypatch, window, block_bytes):
    monkeypatch.setattr(blocks.packed, "__defaults__", (block_bytes,))
    got = substrings.removal_intervals(messy(spark), window=window)
    assert bag(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_windows(messy_rows(), window)
    for r in got.collect():
        assert sum(s["end"] - s["start"] for s in r["intervals"]) == r["n_removed"]
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
    assert substrings.removal_intervals(empty(spark)).collect() == []


def brute_bytes(rows, repeat):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k:k + repeat] for _, t in texts for k in range(len(t) - repeat + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - repeat + 1):
            if seen[t[k:k + repeat]] > 1:
                gone[k:k + repeat] = b"\1" * repeat
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("repeat, block_bytes, heavy", [(400, 8 << 20, 1 << 11), (400, 3000, 3), (40, 20_000, 2)])
def test_byte_repeats_match_brute_force(spark, monkeypatch, repeat, block_bytes, heavy):
    monkeypatch.setattr(blocks.packed, "__defaults__", (block_bytes,))
    monkeypatch.setattr(suffixes, "PIECE", 1 << 12)
    rows = [r for r in messy_rows() if r[0] != 10]  # brute force holds every window
    docs = messy(spark).where("doc_id is null or doc_id <> 10")
    got = suffixes.repeated_spans(docs, repeat=repeat, heavy=heavy)
    assert bag(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows, repeat)
    for r in got.collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]
    assert suffixes.repeated_spans(empty(spark)).collect() == []


def test_column_rounds_follow_the_suffix_order():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 3, (40, 30)).astype(np.uint8)
    groups, low, high = np.zeros(40, int), np.zeros(40, int), np.full(40, 30)
    for j, repeated in suffixes.column_rounds(groups, low, high, lambda j: rows[:, j], 30, 25, 6):
        seen = Counter(bytes(r[j:j + 6]) for r in rows)
        assert set(repeated.tolist()) == {i for i, r in enumerate(rows) if j + 6 <= 30 and seen[bytes(r[j:j + 6])] > 1}


@pytest.mark.parametrize("with_check,with_counts", [(False, False), (True, False), (False, True), (True, True)])
@pytest.mark.parametrize("bits,high_bits", [(1, 64), (5, 64), (9, 20), (12, 12)])
def test_messages_carry_every_key_to_its_slice(bits, high_bits, with_check, with_counts):
    rng = np.random.default_rng(3)
    high = rng.integers(0, 1 << 63, 400, np.uint64) * np.uint64(2)
    high = np.concatenate([high, high[:90], np.array([0, 0, 2 ** 64 - 1], np.uint64)])
    keys = blocks.Keys(high, rng.integers(0, 3, len(high)).astype(np.uint32) if with_check else None, high_bits)
    slices, messages = keys.messages(bits, with_check, with_counts)
    got = [blocks._received(m, s << high_bits - bits, with_check, with_counts) for s, m in zip(slices.tolist(), messages.to_pylist())]
    h, low, many, counts = (np.concatenate(c) for c in zip(*got))
    assert (h == keys.high).all() and (low == keys.low).all() and (many == keys.many).all()
    assert not with_counts or (counts == keys.counts).all()
    assert (np.repeat(slices, [len(g[0]) for g in got]) == (keys.high >> np.uint64(high_bits - bits)).astype(np.int64)).all()
    flags = [{"slice": s, "again": np.packbits(g[2]).tobytes()} for s, g in zip(slices.tolist(), got)]
    rng.shuffle(flags)
    assert (blocks.flagged(keys, flags, bits) == keys.many[keys.place]).all()
    assert not blocks.flagged(keys, None, bits).any()
    none = blocks.Keys(np.empty(0, np.uint64), None, high_bits)
    assert len(none.messages(bits, with_check, with_counts)[1]) == 0


def test_sending_a_block_costs_the_same_at_many_slices():
    """The work follows the keys; 2^19 slices are those of a corpus of about 1 TB."""
    import time
    keys = blocks.Keys(np.random.default_rng(1).integers(0, 1 << 63, 700_000, np.uint64) * np.uint64(2), None, 64)

    def cost(bits):
        best = []
        for _ in range(3):
            t = time.process_time()
            keys.messages(bits, True, False)
            best.append(time.process_time() - t)
        return min(best)

    assert cost(19) < 2 * cost(10)  # 1.2 measured; room for a busy machine


def test_positions_survive_packing():
    for at in ([0], [4_000_000_000], [0, 1], [5, 5 + 255, 5 + 256 + 255], [7, 70_000, 20_000_000], list(range(0, 3000, 7))):
        blob = suffixes.packed_positions(at)
        assert suffixes.unpacked_positions(blob).tolist() == at and (len(blob) > 4) == (len(at) > 1)


def test_a_row_repeated_many_times_comes_back_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(exact, "COPIES_AT_ONCE", 4)
    rows = [(1, "same")] * 23 + [(2, "same")] * 4 + [(3, "alone")] + [(4, "pair")] * 8
    got = exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(r["doc_id"] for r in got) == {1: 23, 2: 4, 3: 1, 4: 8}
    assert Counter(r["doc_id"] for r in got if r["kept"]) == {2: 1, 3: 1, 4: 1}
    assert {r["group_size"] for r in got if r["doc_id"] < 3} == {27}
