"""Documents that every operator must survive, and what the tests share."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, fp string, sha string, kept string, "
          "r string, p string, words string, m string, spans string, block_id string, slice string, n_rows string, "
          "rank string, length string")
EXTRA = ("x",) * 13


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def messy_rows() -> list[tuple]:
    """(doc_id, text): nulls, empties, blanks, ties, repeats, shared passages, one very long text."""
    rng = random.Random(5)
    passage = prose(rng, 90)
    long_text = prose(rng, 30_000, 5000)
    base = prose(rng, 300)
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "alone without id"), (None, None), (None, base), (4, base),
            (5, base), (5, base), (6, base + " tail"), (7, "short text"), (7, "other text, same id"),
            (8, passage + " and " + prose(rng, 40)), (9, prose(rng, 50) + " " + passage), (10, long_text),
            (11, prose(rng, 60) + " " + passage + " " + passage), (12, "é" * 900), (13, "漢字 \U0001F600 ▁ \x00 z"),
            (14, "a" * 5000), (15, "  \n\n " + long_text[:4000] + " \n"), (16, "same words " * 60)]
    return rows


def messy(spark):
    return spark.createDataFrame([(i, t, None, "s", None, *EXTRA) for i, t in messy_rows()], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df, *columns):
    """Rows as a sorted list of tuples, nulls included."""
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
