"""Quality rules: a threshold table compiled into one native Spark projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolytics.llm.common import WORD_BREAK, let

# Frequent function words of the four corpus languages.
STOP_WORDS = (
    "a an and are as at be been by for from had has have he her his in is it its not of on or that the "
    "their they this to was were which will with you "
    "als auch auf aus bei das dem den der des die ein eine einer es für ich im ist mit nicht sich sie "
    "und von war wird zu zum zur über "
    "au aux avec ce ces dans de du elle en est et il ils la le les leur mais ne par pas plus pour qui "
    "que se ses son sur un une "
    "al como con del el ella es esta este han las lo los más muy no o para pero por ser sin su sus también "
    "una y").split()
#: Words per repeated window, and the base limits of the contract.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


@dataclass(frozen=True)
class Rule:
    """A document passes while ``low <= metric <= high`` (None: no bound)."""
    metric: str
    low: float | None = None
    high: float | None = None


# The threshold table. Ratios are per word or per line with a word.
RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("shout_ratio", None, 0.3),
    Rule("stop_word_ratio", 0.01, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("ellipsis_line_ratio", None, 0.3),
)


def _repeat_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text.

    A 64-bit hash per window settles the common case (all hashes distinct means
    no repeat); only texts with an equal pair compare the windows themselves,
    sorted with their positions, and add up the union of the repeated ones.
    """
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def union(positions: Column) -> Column:
        gaps = F.transform(positions, lambda p, k: F.least(
            F.lit(WINDOW), F.coalesce(F.get(positions, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def exact() -> Column:
        keyed = F.sort_array(F.transform(starts, lambda i: F.struct(
            F.array_join(F.slice(words, i, WINDOW), " ").alias("w"), i.alias("at"))))
        repeated = let(keyed, lambda k: F.filter(k, lambda x, j: F.coalesce(
            (F.get(k, j - 1)["w"] == x["w"]), F.lit(False)) | F.coalesce((F.get(k, j + 1)["w"] == x["w"]), F.lit(False))))
        return let(F.sort_array(F.transform(repeated, lambda x: x["at"])), union)

    some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).when(some, exact()).otherwise(F.lit(0).cast("long"))


def _ratio(n: Column, of: Column) -> Column:
    return F.when(of > 0, n.cast("double") / of.cast("double")).otherwise(F.lit(0.0))


def quality_metrics(text: Column) -> Column:
    """Struct of all counts of one text; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, WORD_BREAK), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(w: Column) -> Column:
        return let(lines, lambda ln: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.length(F.regexp_replace(text, r"[^!?]+", "")).cast("long").alias("n_shouts"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(ln).cast("long").alias("n_lines"),
            F.size(F.filter(ln, lambda x: x.rlike(r"^\s*[-*•]\s"))).cast("long").alias("n_bullet_lines"),
            F.size(F.filter(ln, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long").alias("n_ellipsis_lines"),
        ))

    return let(words, of)


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The rule table as one boolean over the metric columns."""
    n, lines = F.col("n_words"), F.col("n_lines")
    metric = {
        "mean_word_chars": _ratio(F.col("word_chars"), n),
        "symbol_ratio": _ratio(F.col("n_symbols"), n),
        "shout_ratio": _ratio(F.col("n_shouts"), n),
        "stop_word_ratio": _ratio(F.col("n_stop_words"), n),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), lines),
        "bullet_line_ratio": _ratio(F.col("n_bullet_lines"), lines),
        "ellipsis_line_ratio": _ratio(F.col("n_ellipsis_lines"), lines),
    }
    out = F.lit(True)
    for r in rules:
        if r.low is not None:
            out = out & (metric[r.metric] >= r.low)
        if r.high is not None:
            out = out & (metric[r.metric] <= r.high)
    return out


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: id, counts, base verdict, kept.

    A null or empty text has zero words and fails the base rule. Repeated rows
    and null ids are judged row by row; no other column is read. One map-only
    projection, no shuffle and no user functions.
    """
    m = docs.select(F.col(f"`{id_col}`").alias("doc_id"), quality_metrics(F.col(f"`{text_col}`")).alias("m"))
    flat = m.select("doc_id", "m.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return flat.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
