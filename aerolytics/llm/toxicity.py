"""Toxicity by a classifier chain of logistic models.

Categories are predicted one after another; each model also sees the earlier
categories' probabilities. In training those are out-of-fold predictions, so a
later model learns from probabilities as honest as the ones it meets in use.
Models are fitted on a bounded sample of labelled rows; scoring is one map over
all documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolytics.llm.common import fold_words, raw_bytes, stored

#: Labelled rows the models are fitted on at most; equal rows are one row with a weight.
SAMPLE_ROWS = 12000
#: Terms considered at most (those furthest off in any category) and their least document count.
CANDIDATE_TERMS = 4096
MIN_DOCUMENTS = 12
#: A term enters a model if its count in the category is this many standard errors off.
MIN_Z = 7.0
MAX_TERMS = 160
FOLDS = 5
RIDGE = 0.3
#: Probability from which a category is given.
THRESHOLD = 0.5

#: The chain, in order, as SQL over the label columns. Low quality comes first:
#: junk text hides or mimics insults, which the toxicity models then know.
CATEGORIES = (
    ("low_quality", "1 - quality"),
    ("toxic", "toxic"),
    ("toxic_low_quality", "toxic * (1 - quality)"),
)
#: Categories that reject a document.
REJECTING = ("toxic", "toxic_low_quality")

_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#*$%&|<>!?=+~^{}[]"
N_DENSE = 4


def terms_of(words: set[bytes]) -> set[bytes]:
    """The words and their openings of 4 to 6 bytes, which inflected forms share."""
    return words.union(*[[b"^" + w[:n] for w in words if len(w) >= n] for n in (4, 5, 6)])


def dense_features(text: bytes, words: list[bytes], distinct: int) -> list[float]:
    """Length and form of a text: log words, capitals, symbols, distinct words."""
    n = max(1, len(text))
    return [math.log1p(len(words)), 1 - len(text.translate(None, _UPPER)) / n,
            1 - len(text.translate(None, _SYMBOLS)) / n, distinct / max(1, len(words))]


@dataclass
class LinearModel:
    """Logistic regression over some terms, the dense features and earlier probabilities."""
    terms: np.ndarray
    term_weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def predict(self, presence: np.ndarray, rest: np.ndarray) -> np.ndarray:
        z = presence[:, self.terms] @ self.term_weights + (rest - self.mean) / self.scale @ self.weights + self.bias
        return _sigmoid(z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _counts(presence: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted column sums, in slices: only these are widened to doubles."""
    return sum((weight[i:i + 1024] @ presence[i:i + 1024] for i in range(0, len(weight), 1024)),
               np.zeros(presence.shape[1]))


def _telling_terms(presence: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Columns whose count among the positives deviates from chance by MIN_Z errors."""
    n, p = weight.sum(), np.average(y, weights=weight)
    df = _counts(presence, weight)
    hits = _counts(presence[y > 0], weight[y > 0])
    error = np.sqrt(np.maximum(df * p * (1 - p) * (1 - df / n), 1e-9))
    z = np.where((df >= MIN_DOCUMENTS) & (df < n), np.abs(hits - df * p) / error, 0)
    found = np.flatnonzero(z >= MIN_Z)
    return np.sort(found[np.argsort(-z[found], kind="stable")[:MAX_TERMS]])


def fit_linear(presence: np.ndarray, rest: np.ndarray, y: np.ndarray, weight: np.ndarray) -> LinearModel:
    """Ridge logistic regression by Newton steps; one class only gives its constant.

    A row of weight n counts as n equal rows.
    """
    mean = np.average(rest, axis=0, weights=weight)
    scale = np.maximum(np.sqrt(np.average((rest - mean) ** 2, axis=0, weights=weight)), 1e-6)
    if y.min() == y.max():
        return LinearModel(np.empty(0, int), np.empty(0), mean, scale, np.zeros(rest.shape[1]),
                           12.0 if y.max() > 0 else -12.0)
    terms = _telling_terms(presence, y, weight)
    x = np.column_stack([presence[:, terms].astype(np.float64), (rest - mean) / scale, np.ones(len(y))])
    ridge = np.append(np.full(x.shape[1] - 1, RIDGE), 1e-6)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x + np.diag(ridge),
                               x.T @ (weight * (y - p)) - ridge * w)
        w += step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    k = len(terms)
    return LinearModel(terms, w[:k], mean, scale, w[k:-1], float(w[-1]))


@dataclass
class ChainModel:
    """The vocabulary and one linear model per category, in chain order."""
    vocabulary: dict[bytes, int]
    categories: list[str]
    models: list[LinearModel] = field(default_factory=list)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """Probabilities, one row per text and one column per category."""
        used = set().union(*[m.terms.tolist() for m in self.models])
        known = {w: i for w, i in self.vocabulary.items() if i in used}
        tables = [dict(zip(m.terms.tolist(), m.term_weights.tolist())) for m in self.models]
        out = np.empty((len(texts), len(self.models)))
        for r, text in enumerate(texts):
            words = fold_words(text or b"")
            distinct = set(words)
            present = [known[w] for w in known.keys() & terms_of(distinct)]
            rest = dense_features(text or b"", words, len(distinct))
            for c, (m, table) in enumerate(zip(self.models, tables)):
                z = m.bias + sum(table.get(i, 0.0) for i in sorted(present))
                z += sum((v - a) / s * w for v, a, s, w in zip(rest, m.mean, m.scale, m.weights))
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
                out[r, c] = p
                rest.append(p)
        return out


def fit_chain(vocabulary: dict[bytes, int], presence: np.ndarray, dense: np.ndarray, labels: np.ndarray,
              folds: np.ndarray, categories: list[str], weight: np.ndarray) -> ChainModel:
    """Fits the chain; probabilities handed on in training come from the other folds' models."""
    chain, rest = ChainModel(vocabulary, categories), dense
    for c in range(len(categories)):
        y = labels[:, c].astype(np.float64)
        honest = np.empty(len(y))
        for k in range(FOLDS):
            held = folds == k
            if held.any():
                model = (fit_linear(presence[~held], rest[~held], y[~held], weight[~held]) if (~held).any() else None)
                honest[held] = (model.predict(presence[held], rest[held]) if model
                                else np.average(y, weights=weight))
        chain.models.append(fit_linear(presence, rest, y, weight))
        rest = np.column_stack([rest, honest])
    return chain


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int,
                    categories=CATEGORIES) -> DataFrame:
    """At most ``rows`` labelled documents, the first by a hash of their id: id, text, y, n.

    Rows with a null id, text or label take no part. Repeated ids in either
    table give the rows that a join gives; equal ones are one row, ``n`` times.
    If ids repeat with more than ``rows`` different rows, the first by a hash
    of the whole row stay.
    """
    y = F.array(*[F.expr(sql).cast("double") for _, sql in categories])
    chosen = (labels.select(F.col(f"`{id_col}`").alias("doc_id"), y.alias("y"))
              .where("doc_id is not null and not exists(y, v -> v is null)")
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    text = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # Broadcast of at most ``rows`` ids.
    joined = text.where("text is not null").join(F.broadcast(chosen), "doc_id")
    different = stored(joined.groupBy("doc_id", "text", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
                       .withColumn("h", F.xxhash64("doc_id", "text", "y")), "labelled")
    if different.count() > rows:
        last = different.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
        different = different.where(F.col("h") <= last)
    return different.drop("h")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          rows: int = SAMPLE_ROWS, categories=CATEGORIES) -> ChainModel:
    """The chain fitted on a bounded sample; without labelled rows it gives probability ~0."""
    sample = labelled_sample(docs, labels, id_col, text_col, rows, categories)

    @F.arrow_udf("array<binary>")
    def distinct_terms(column: pa.Array) -> pa.Array:
        return pa.array([sorted(terms_of(set(fold_words(t)))) for t in raw_bytes(column)], pa.list_(pa.binary()))

    k = range(len(categories))
    total = sample.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("rows"),
                       *[F.sum(F.get("y", F.lit(i)) * F.col("n")).alias(f"all{i}") for i in k]).first()
    per_term = (sample.select("y", "n", F.explode(distinct_terms("text")).alias("term")).groupBy("term")
                .agg(F.sum("n").alias("n"),
                     *[F.sum(F.get("y", F.lit(i)) * F.col("n")).alias(f"hits{i}") for i in k])
                .where(F.col("n") >= MIN_DOCUMENTS))

    def off(i: int) -> Column:
        rows, p = max(1, total["rows"]), (total[f"all{i}"] or 0.0) / max(1, total["rows"])
        error = F.sqrt(F.greatest(F.col("n") * (p * (1 - p)) * (1 - F.col("n") / rows), F.lit(1e-9)))
        return F.abs(F.col(f"hits{i}") - F.col("n") * p) / error

    telling = (per_term.select("term", F.greatest(F.lit(0.0), *[off(i) for i in k]).alias("z"))
               .where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "term").limit(CANDIDATE_TERMS).collect())
    vocabulary = {bytes(r["term"]): i for i, r in enumerate(telling)}

    @F.arrow_udf("struct<present:array<int>,dense:array<double>>")
    def features(column: pa.Array) -> pa.Array:
        out = []
        for text in raw_bytes(column):
            words = fold_words(text)
            distinct = set(words)
            out.append({"present": sorted(vocabulary[w] for w in vocabulary.keys() & terms_of(distinct)),
                        "dense": dense_features(text, words, len(distinct))})
        return pa.array(out, pa.struct([("present", pa.list_(pa.int32())), ("dense", pa.list_(pa.float64()))]))

    found = (sample.select(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).alias("fold"), "y", "n",
                           features("text").alias("f"), "doc_id", F.xxhash64("text", "y").alias("h"))
             .orderBy(F.xxhash64("doc_id"), "doc_id", "h").collect())
    presence = np.zeros((len(found), max(1, len(vocabulary))), np.uint8)
    for r, row in enumerate(found):
        presence[r, row["f"]["present"]] = 1
    names = [n for n, _ in categories]
    if not found:
        never = LinearModel(np.empty(0, int), np.empty(0), np.zeros(0), np.ones(0), np.zeros(0), -12.0)
        return ChainModel({}, names, [never] * len(names))
    return fit_chain(vocabulary, presence, np.array([r["f"]["dense"] for r in found]),
                     np.array([r["y"] for r in found]), np.array([r["fold"] for r in found]), names,
                     np.array([r["n"] for r in found]))


def probabilities(text: Column, model: ChainModel) -> Column:
    """Struct of one probability per category; null and empty texts score as no words."""
    names = [f"p_{c}" for c in model.categories]

    @F.arrow_udf("struct<" + ",".join(f"{n}:double" for n in names) + ">")
    def chain(column: pa.Array) -> pa.Array:
        p = model.score(raw_bytes(column))
        return pa.StructArray.from_arrays([pa.array(np.round(p[:, i], 9)) for i in range(len(names))], names)

    return chain(text)


def _rejected(model: ChainModel, threshold: float) -> Column:
    return F.greatest(*[F.col(f"p.p_{c}") for c in model.categories if c in REJECTING], F.lit(0.0)) >= threshold


def toxicity_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, a probability per category, toxic, kept.

    Null and empty texts are kept. Repeated rows and null ids are scored row by
    row; no other column of ``docs`` is read.
    """
    model = train(docs, labels, id_col, text_col)
    scored = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                         probabilities(F.col(f"`{text_col}`"), model).alias("p"))
    blank = F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0
    toxic = ~blank & _rejected(model, threshold)
    return scored.select("doc_id", "p.*", toxic.alias("toxic"), (~toxic).alias("kept"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (all columns, any names) that ``toxicity_report`` keeps."""
    model = train(docs, labels, id_col, text_col)
    text = F.col(f"`{text_col}`")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                      probabilities(text, model).alias("p"),
                      (F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0).alias("blank"))
    return row.where(F.col("blank") | ~_rejected(model, threshold)).select("row.*")
