"""Quality rules, licence scans, personal data and toxicity."""

import hashlib
import random
import re

import numpy as np
import pytest

from aerolytics.llm import licenses, pii, quality, toxicity
from tests.llm.cases import EXTRA, SCHEMA, bag, empty, messy, messy_rows, prose

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute_quality(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    repeated = {i for i, w in enumerate(windows) if windows.count(w) > 1} if len(windows) < 3000 else set()
    covered = {i + k for i in repeated for k in range(8)}
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered),
            len(words) < 20 or 100 * len(covered) > 30 * len(words))


def test_quality_counts_match_brute_force(spark):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = bag(quality.quality_report(messy(spark)), *cols)
    assert got == sorted(((i, *brute_quality(t)) for i, t in messy_rows()), key=repr)
    assert not quality.quality_report(messy(spark)).where("base_failed and kept").count()
    assert quality.quality_report(empty(spark)).collect() == []


@pytest.mark.parametrize("text", [
    "a b c d e f g h a b c d e f g h", "x " * 9, "l1 one two\nl1 one two\n\n \nl2\nl2 ", "#*$%&|<> a|b",
    "a b c d e f g h i " * 2 + "z y x w v u t s r q " + "b c d e f g h i", "\x0b\x0c\r\n", "ab\x85cd ef"])
def test_quality_edge_texts(spark, text):
    row = quality.quality_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                  "base_failed")) == brute_quality(text)


def test_quality_keeps_prose_and_drops_junk(spark):
    good = "the cat and the dog were in the house of a friend and it was good for them to be there with us " * 1
    rows = [(1, good + "today"), (2, " ".join(w + "%%%" for w in good.split())), (3, "xq zzk " * 30),
            (4, "same line of the day\n" * 30)]
    got = dict(bag(quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "kept"))
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_suffix_automaton_statistics_match_brute_force():
    rng = random.Random(2)
    sequences = [[rng.choice("ab").encode() for _ in range(12)] for _ in range(4)]
    grams = {tuple(s[i:j]) for s in sequences for i in range(12) for j in range(i + 1, 13)}
    automaton = licenses.SuffixAutomaton(sequences)
    words = [rng.choice("abc").encode() for _ in range(300)]
    got = {end: (state, run) for end, state, run in automaton.statistics(words)}
    for end in range(1, 301):
        want = max((k for k in range(1, 13) if k <= end and tuple(words[end - k:end]) in grams), default=0)
        assert got.get(end, (0, 0))[1] == want
        if want:
            gram = words[end - want:end]
            places = {(k, i + want) for k, s in enumerate(sequences) for i in range(13 - want) if s[i:i + want] == gram}
            assert automaton.ends[got[end][0]] == places


def test_license_base_counts_match_brute_force(spark):
    rng = random.Random(4)
    pool = ["mit", "license", "Apache", "general", "public", "the", "x", "é", "LICENSE,", "mit-license"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for i in range(40)]
    rows += [(100 + k, t) for k, (_, t) in enumerate(messy_rows())]

    def brute(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
                           "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        places, labels = [], set()
        for phrase, label in licenses.BASE_PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = bag(licenses.license_scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    assert licenses.license_scan(empty(spark)).collect() == []
    assert licenses.license_scan(messy(spark)).count() == len(messy_rows())


def test_license_templates_are_found_through_small_edits():
    scanner = licenses.LicenseScanner()
    mit = licenses.TEMPLATES[0][1].split()
    edited = " ".join([*mit[:20], "(really)", *mit[20:40], *mit[42:]])
    found = scanner.scan(("Intro words. " + edited + " The end.").encode())
    assert found["labels"] == "mit" and found["base_labels"] == "" and 0.8 <= found["score"] <= 1
    assert found["spans"][0]["start"] == 2
    assert scanner.scan(b"Licensed under CC BY-NC 4.0.")["labels"] == "cc-by-nc"
    assert scanner.scan(" ".join(mit[:30]).encode())["labels"] == ""
    assert scanner.scan(None)["score"] == 0.0


def test_license_spans_of_every_notice():
    scanner = licenses.LicenseScanner()
    mit = licenses.TEMPLATES[0][1].split()
    changed = [*mit[:25], "else", *mit[26:]]
    text = " ".join([*["x"] * 40, *mit, *["x"] * 40, *changed, *["x"] * 40, *mit])
    n = len(mit)
    assert [(s["start"], s["end"], s["coverage"]) for s in scanner.scan(text.encode())["spans"]] == [
        (40, 40 + n, 1.0), (80 + n, 80 + 2 * n, round((n - 1) / n, 6)), (120 + 2 * n, 120 + 3 * n, 1.0)]
    # Side by side, and behind a longer part of the same notice.
    for before, at in ((mit, n), (mit[:30], 30), (mit[:30] + ["x"] * 5, 35), (mit[20:50] + ["x"] * 5, 35)):
        found = scanner.scan(" ".join(before + changed).encode())
        assert found["labels"] == "mit"
        assert (at, at + n) in [(s["start"], s["end"]) for s in found["spans"]]
    many = scanner.scan(" ".join(mit * 3000).encode())["spans"]
    assert [s["start"] for s in many] == list(range(0, 3000 * n, n))


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_pii(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                  "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def luhn(digits):
    d = [int(x) for x in digits[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_pii_base_spans_match_the_plain_patterns(spark):
    rng = random.Random(9)
    alphabet = ["a", "b.", "@", "c-d", ".", "1", "25", "255.1.2.3", "+", "+4 ", "(", ") ", "-", " ", "é", "\n", "4111111111111111",
                "4111-1111 1111-1111", "x@y.zz", "%", "00", "12345678"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(1000 + k, t) for k, (_, t) in enumerate(messy_rows())]
    got = pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = dict((i, brute_pii(t)) for i, t in rows)
    assert sum(map(len, want.values())) > 200
    for r in got:
        base = [s for s in r["spans"].split(",") if s and s.split(":")[0] in BASE]
        assert base == want[r["doc_id"]], dict(rows)[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(s.startswith(k) for s in base) for k in BASE]
    assert pii.pii_report(empty(spark)).collect() == []


def test_pii_added_kinds_context_and_redaction(spark):
    text = "IBAN GB82 WEST 1234 5698 7654 32 or GB83 WEST 1234 5698 7654 32; ssn 078-05-1120, part 078-05-1121"
    spans = pii.find_spans(text)
    assert [(s["kind"], text[s["start"]:s["end"]]) for s in spans] == [
        ("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "078-05-1120"), ("ssn", "078-05-1121")]
    assert pii.find_spans("part 078-05-1121") == []
    assert pii.find_spans("mail a@b.cd")[0]["score"] > pii.find_spans("the a@b.cd")[0]["score"]
    assert pii.redact_text("call +1 (234) 555-0199 now", pii.find_spans("call +1 (234) 555-0199 now")) == "call [PHONE] now"
    docs = messy(spark)
    assert bag(pii.redact(docs), *docs.columns) == bag(docs, *docs.columns)


def test_pii_context_on_both_sides_raises_and_lowers():
    found = lambda t: [(s["kind"], t[s["start"]:s["end"]]) for s in pii.find_spans(t)]
    assert found("078-05-1120 is my SSN") == [("ssn", "078-05-1120")]
    assert found("My number 078-05-1120 (social security)") == [("ssn", "078-05-1120")]
    assert found("078-05-1120" + " x" * 40 + " ssn") == []  # too far away
    assert found("ssn or serial 078-05-1120") == []
    score = lambda t: pii.find_spans(t)[0]["score"]
    assert score("a@b.cd is my mail") > score("a@b.cd is") > score("for example a@b.cd")
    assert found("for example a@b.cd") == [("email", "a@b.cd")]  # base spans always stay


@pytest.mark.parametrize("text,ibans,clean", [
    ("DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32",
     ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"], "[IBAN] [IBAN]"),
    ("REF RE20 2024 0001 IBAN DE89 3704 0044 0532 0130 00", ["DE89 3704 0044 0532 0130 00"],
     "REF RE20 2024 0001 IBAN [IBAN]")])
def test_pii_ibans_inside_longer_proposals(text, ibans, clean):
    spans = [s for s in pii.find_spans(text) if s["kind"] == "iban"]
    assert [text[s["start"]:s["end"]] for s in spans] == ibans
    assert pii.redact_text(text, spans) == clean
    pii.find_spans("RE20 2024 0001 " * 20_000)


def test_pii_is_linear_on_endless_runs():
    for text in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "@" * 100_000, "A1" * 100_000):
        pii.find_spans(text)


def labelled(spark, n=400):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        toxic, junk = i % 5 == 0, i % 7 == 0
        words = prose(rng, 60).split()
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = "grufty" + rng.choice("abcdefghij")
        if junk:
            words = [w + "%%%" for w in words]
        rows.append((i, " ".join(words), "en", "s", None, *EXTRA))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    report = toxicity.toxicity_report(docs, labels.where("doc_id % 2 = 0"))
    assert report.columns == ["doc_id", "p_low_quality", "p_toxic", "p_toxic_low_quality", "toxic", "kept"]
    held_out = report.where("doc_id % 2 = 1").collect()
    assert [r["doc_id"] for r in held_out if r["toxic"] != (r["doc_id"] % 5 == 0)] == []
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [i for i in range(400) if i % 5]


def test_toxicity_edges(spark):
    docs, labels = labelled(spark, 100)
    for some in (labels.limit(0), labels.where("toxic = 0"), labels.selectExpr("doc_id", "null quality", "toxic")):
        assert toxicity.toxicity_report(docs, some).where("toxic").count() == 0
    assert toxicity.toxicity_report(empty(spark), labels).collect() == []
    # Ids of labels and texts do not meet here, but for a repeated label row.
    other = labels.withColumn("doc_id", labels["doc_id"] + 1000)
    out = toxicity.toxicity_report(messy(spark), other.unionByName(other))
    assert out.count() == len(messy_rows()) and out.where("kept").count() == len(messy_rows())
    assert toxicity.drop_toxic(messy(spark), other).count() == len(messy_rows())
    # Labelled rows with null, blank, repeated and very long texts can be trained on.
    assert toxicity.toxicity_report(messy(spark), labels.unionByName(labels)).where("doc_id < 4 and kept").count() == 3


def test_toxicity_sample_is_bounded_after_the_join(spark):
    docs, labels = labelled(spark, 100)
    one = docs.where("doc_id = 3")
    copies = docs.unionByName(one.crossJoin(spark.range(500)).select(docs.columns))
    sample = toxicity.labelled_sample(copies, labels, "doc_id", "text", 120)
    assert dict(bag(sample, "doc_id", "n")) == {i: 501.0 if i == 3 else 1.0 for i in range(100)}
    # One id with many texts: the bound holds, and every id may still come in.
    texts = docs.unionByName(one.crossJoin(spark.range(500)).selectExpr(
        "doc_id", "concat(text, ' ', id) text", *docs.columns[2:]))
    sample = toxicity.labelled_sample(texts, labels, "doc_id", "text", 120)
    assert sample.count() == 120 and sample.where("doc_id <> 3").count() > 5


def test_toxicity_weights_count_as_equal_rows(spark):
    docs, labels = labelled(spark, 200)
    few = docs.where("doc_id % 3 = 0")
    twice = labels.unionByName(labels)  # every row of the join twice
    texts = [r["text"].encode() for r in few.collect()]
    assert (toxicity.train(docs.unionByName(docs), labels).score(texts)
            == pytest.approx(toxicity.train(docs, twice).score(texts), abs=1e-9))
    rng = np.random.default_rng(3)
    presence, rest = rng.integers(0, 2, (300, 40), np.uint8), rng.normal(size=(300, 4))
    y = ((presence[:, 0] + presence[:, 1] + rng.random(300)) > 1.5).astype(float)
    weight = rng.integers(1, 5, 300)
    again = np.repeat(np.arange(300), weight)
    model = toxicity.fit_linear(presence, rest, y, weight.astype(float))
    plain = toxicity.fit_linear(presence[again], rest[again], y[again], np.ones(len(again)))
    assert len(model.terms) and model.terms.tolist() == plain.terms.tolist()
    assert model.predict(presence, rest) == pytest.approx(plain.predict(presence, rest), abs=1e-8)


def test_toxicity_chain_matches_a_plain_one():
    """Category after category: out-of-fold probabilities while fitting, the chain's own while scoring."""
    rng = np.random.default_rng(12)
    presence, dense = rng.integers(0, 2, (240, 30), np.uint8), rng.normal(size=(240, 3))
    first = (presence[:, 0] + 0.5 * dense[:, 0] + 0.3 * rng.normal(size=240) > 0.6).astype(float)
    second = ((first > 0) & (presence[:, 1] > 0)).astype(float)
    labels, folds, weight = np.column_stack([first, second]), rng.integers(0, toxicity.FOLDS, 240), rng.integers(1, 3, 240).astype(float)
    chain = toxicity.fit_chain({}, presence, dense, labels, folds, ["a", "b"], weight)

    def probability(m, terms, rest):
        z = m.bias + sum(w * terms[t] for t, w in zip(m.terms.tolist(), m.term_weights.tolist()))
        z += sum((v - a) / s * w for v, a, s, w in zip(rest, m.mean, m.scale, m.weights))
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))

    out_of_fold = np.empty(240)
    for k in range(toxicity.FOLDS):
        out = folds != k
        m = toxicity.fit_linear(presence[out], dense[out], first[out], weight[out])
        for i in np.flatnonzero(~out):
            out_of_fold[i] = probability(m, presence[i], dense[i])
    plain = [toxicity.fit_linear(presence, dense, first, weight),
             toxicity.fit_linear(presence, np.column_stack([dense, out_of_fold]), second, weight)]
    for got, want in zip(chain.models, plain):
        assert got.terms.tolist() == want.terms.tolist() and got.bias == pytest.approx(want.bias, abs=1e-9)
        assert got.term_weights == pytest.approx(want.term_weights, abs=1e-9)
        assert got.weights == pytest.approx(want.weights, abs=1e-9)
    in_sample = np.array([probability(plain[0], presence[i], dense[i]) for i in range(240)])
    assert np.abs(in_sample - out_of_fold).max() > 0.01  # the folds matter
    assert len(chain.models[1].weights) == 4  # the first probability is a feature of the second model
