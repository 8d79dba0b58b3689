"""Conversation prefixes, centroid clusters and the shingle join against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from aerolytics.llm import centroids, jaccard, prefixes
from tests.llm.cases import bag, empty, messy, messy_rows, prose

TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
CLUSTERS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
CLASH = "part long, id string, n long, words string, layer string, block_id string, cluster int, v int"
NOTHING = (None,) * 8


def signed(hexadecimal):
    v = int(hexadecimal, 16)
    return v - (1 << 64 if v >> 63 else 0)


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            h = hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()
            own[c].append((t is not None, t or 0, signed(h[:16]), signed(h[16:32]), r, x))
    turns = {c: [s[4:] for s in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        built = turns.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + turns[c][h:]
        for d in range(len(built) + 1):
            members[tuple(built[:d])].append((c, len(built)))
    children, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        words = len(re.findall(rb"[^\x20\x09-\x0D]+", k[-1][1].encode())) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * words
            leaves[k[:d]] += not children[k]
    least = {k: min(m)[0] for k, m in members.items()}
    ends = {k: ",".join(str(c) for c, n in sorted(m) if n == len(k)) for k, m in members.items()}
    return sorted([(least[k], len(k), least[k[:-1]] if k else None, len(m), children[k], leaves[k], saved[k],
                    hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items()], key=repr)


def talks():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["u", "a", None]), rng.choice(["x y", "z", None, "", " \t"]))
            for c in range(-5, 60) for t in range(rng.randrange(0, 9))]
    rows += [(None, 1, "u", "no id"), (7, None, "u", "first"), (7, None, None, None), (7, 3, "a", "tie"), (7, 3, "u", "tie"),
             (7, 3, "u", "tie"), (101, 0, "u", "only an opening"), (103, 0, "u", "q"), (9, 1, "u", "long " * 20_000)]
    rows += [(c, i, "u", f"t{i}") for c in (80, 81, 82, 83, 84) for i in range(200)]  # more turns than a layer holds
    return rows + [(85, i, "u", f"t{i}") for i in range(190)] + [(1000 + c, 0, "u", "hot") for c in range(200)]


def test_prefix_trie_matches_brute_force(spark):
    """In blocks of 5 units, so that many nodes are cut by a block's edge."""
    rows = talks()
    df = spark.createDataFrame([(*r, *NOTHING) for r in rows], f"conv_id long, turn long, role string, text string, {CLASH}")
    assert bag(prefixes.prefix_trie(df.repartition(3), block_units=5), *TRIE) == brute_trie(rows)


def test_prefix_trie_of_an_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixes.prefix_trie(df).collect() == []


def test_range_minima_searches_match_a_scan():
    rng = np.random.default_rng(2)
    values = rng.integers(-1, 6, 200)
    minima = prefixes.RangeMinima(values)
    at, depth = np.repeat(np.arange(200), 5), np.tile(np.arange(1, 6), 200)
    for i, d, left, right in zip(at, depth, minima.left_end(at, depth), minima.right_end(at, depth)):
        want = i
        while want + 1 < 200 and values[want + 1] >= d:
            want += 1
        assert right == want
        want = i
        while want > 0 and values[want] >= d:
            want -= 1
        assert left == want
    a = rng.integers(0, 200, 300)
    b = np.minimum(a + rng.integers(0, 150, 300), 199)
    assert minima.least(a, b).tolist() == [values[x:y + 1].min() for x, y in zip(a, b)]


def brute_clusters(rows, k=8, rounds=10, dim=64):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    by_hash = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c, x = np.array([v for _, v in by_hash[:k]], np.int64), np.array([v for _, v in kept], np.int64)
    for t in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(-1)
        a = d.argmin(1)
        if t < rounds:
            c = np.array([x[a == j].sum(0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    near = d[np.arange(len(a)), a]
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]
    return sorted([(i, int(j), int(s), int(near[a == j].sum()), int(near.sum()), sha[j])
                   for (i, _), j, s in zip(kept, a, near)], key=repr)


def test_centroid_clusters_match_brute_force(spark):
    rng = random.Random(4)
    around = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(around)]) for i in range(300)]
    rows += [(i, around[0]) for i in range(300, 500)]  # a hot vector
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (500, None), (501, []), (502, [0.5] * 63),
             (503, [None] + [0.5] * 63), (504, [float("nan")] * 64), (505, [float("inf")] + [0.0] * 63), (506, [-0.0] * 64)]
    df = spark.createDataFrame([(*r, *NOTHING) for r in rows], f"vec_id long, embedding array<double>, {CLASH}").repartition(3)
    assert bag(centroids.centroid_clusters(df), *CLUSTERS) == brute_clusters(rows)


def test_centroid_clusters_of_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(1, [0.25] * 64), (2, [0.25] * 64), (3, [-1.0] * 64)]
    assert bag(centroids.centroid_clusters(spark.createDataFrame(rows, schema)), *CLUSTERS) == brute_clusters(rows)
    for none in ([], [(1, None), (2, [1.0])]):
        assert centroids.centroid_clusters(spark.createDataFrame(none, schema)).collect() == []


def test_approach_bounds_what_a_sphere_can_lose():
    rng = np.random.default_rng(5)
    less = 0
    for _ in range(300):
        centre, old, new = rng.normal(0, 10, (3, 6))
        radius = abs(rng.normal(0, 5))
        bound = centroids.approach(centre, radius, old, new)
        x = rng.normal(0, 1, (2000, 6))
        x = centre + x / np.linalg.norm(x, axis=1)[:, None] * radius * rng.random((2000, 1)) ** 0.2
        loss = np.linalg.norm(x - old, axis=1) - np.linalg.norm(x - new, axis=1)
        assert loss.max() <= bound
        less += bound < 0.9 * np.linalg.norm(new - old)
    assert less > 50  # the geometry matters


def brute_join(rows, words, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(b" ".join(w[j:j + words]) for j in range(max(1, len(w) - words + 1))) if w else frozenset()))
    distinct = [s for s in dict.fromkeys(s for _, s in sets) if s]
    root = list(range(len(distinct)))
    for a, x in enumerate(distinct):
        for b, y in enumerate(distinct[:a]):
            if 100 * len(x & y) >= percent * len(x | y) and root[a] != root[b]:
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    ids = defaultdict(list)
    for i, s in sets:
        if s and i is not None:
            ids[root[distinct.index(s)]].append(i)
    return sorted([(i, len(s), min(ids[root[distinct.index(s)]], default=None) if s else i) for i, s in sets], key=repr)


def near_copies():
    """A base with many copies, near copies of it, chains of near copies, a passage in unrelated texts."""
    rng = random.Random(6)
    base = prose(rng, 150).split()
    rows = [(i, " ".join(base)) for i in range(20)]
    for i in range(20, 140):
        words = list(base)
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(150)] = f"n{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    step = prose(rng, 120, 5000).split()
    for i in range(140, 160):
        step = step[:]
        step[rng.randrange(120)] = f"s{i}"
        rows.append((i, " ".join(step)))
    passage = prose(rng, 60, 5000)
    rows += [(i, passage + " " + prose(rng, 6, 60)) for i in range(160, 200)]
    return rows + [(i, f"one Line {i % 3}") for i in range(200, 215)]


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_jaccard_components_match_brute_force(spark, words, percent):
    got = jaccard.jaccard_components(messy(spark), shingle_words=words, percent=percent)
    assert bag(got, "doc_id", "n_shingles", "component_id") == brute_join(messy_rows(), words, percent)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = bag(jaccard.jaccard_components(df, shingle_words=words, percent=percent), "doc_id", "n_shingles", "component_id")
    assert got == brute_join(rows, words, percent)


def test_jaccard_components_of_an_empty_table(spark):
    assert jaccard.jaccard_components(empty(spark)).collect() == []


def test_longer_prefixes_ask_for_more_matches():
    # Frequent lists make another match cheaper than comparing every set met once.
    assert jaccard.best_matches(100, [2] * 11 + [3] * 89, 90) > 1
    # Where the next token is far more frequent, the prefix stays short.
    assert jaccard.best_matches(100, [2] * 11 + [100_000] * 89, 90) == 1
    assert jaccard.best_matches(1, [5], 90) == 1


def test_matching_prefixes_share_as_many_tokens_as_asked():
    """The lemma behind the join, for every l both sets allow."""
    rng = random.Random(8)
    for _ in range(200):
        x = set(rng.sample(range(60), rng.randrange(5, 40)))
        y = set(x)
        for _ in range(rng.randrange(0, 4)):
            y.discard(rng.choice(sorted(x)))
            y.add(rng.randrange(100))
        if 100 * len(x & y) < 80 * len(x | y):
            continue
        for matches in range(1, 6):
            cut = [set(sorted(s)[:len(s) - jaccard.least_overlap(len(s), 80) + matches]) for s in (x, y)]
            if all(matches <= jaccard.least_overlap(len(s), 80) for s in (x, y)):
                assert len(cut[0] & cut[1]) >= matches
