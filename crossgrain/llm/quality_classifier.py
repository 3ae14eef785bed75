"""A quality classifier: regularised quadratic discriminant analysis over document statistics.

Each document gives a vector of transformed statistics (logarithms and square roots of shares, so
that classes are nearer to normal). For each class, the mean and a covariance shrunk towards its
diagonal and towards the pooled covariance are fitted; the covariances' Cholesky factors are computed
once and kept in the model. A score is the logistic of the difference of the classes' log densities
and log priors, each a Mahalanobis distance by forward substitution with the kept factor.

Spark: the statistics are one native pass over the texts, kept as a narrow table in the shared folder
(a few doubles a document, never a text). The fit is one aggregation of sums and products over all
labelled rows for training; the driver gets one row a class. Scoring is a map over the narrow table.

Defined results: a null text counts as empty and an empty text has a score like any other; every row
gives one row, repeated rows and null ids included (a null doc_id is never labelled and counts as not
held out); labels that are null or neither 0 nor 1 are ignored; a label that is repeated counts as
often as it stands; other columns are ignored; an empty table gives an empty result. Without training rows
of both classes there is nothing to tell apart: every score is (n1 + 1) / (n0 + n1 + 2), 0.5 without any.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgrain.llm import text as T
from crossgrain.sources.scratch import materialize
from crossgrain.sources.tables import table

#: Weight of the diagonal in each class's covariance, then of the pooled covariance.
DIAGONAL_SHRINKAGE = 0.1
POOLED_SHRINKAGE = 0.1
#: Added to every variance.
RIDGE = 1e-4
ACCEPT = 0.7
#: Labelled rows, about, that the pipeline's stage fits to; with more labels, a part of them by a hash of doc_id.
TRAIN_ROWS, TRAIN_SEED = 50_000, 11
#: Added to what shares are taken of, so that a few words say little for or against a document.
PRIOR_WORDS, PRIOR_CHARS, PRIOR_LINES = 30, 200, 5

_SYMBOLS = "#*$%&|<>"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = ("log_words", "word_length", "log_line_words", "distinct_words", "repeated_lines", "symbols", "capitals", "digits", "bangs", "stops", "commas", "bars")


def _count(chars: str) -> Column:
    return F.length("doc_text") - F.length(F.translate("doc_text", chars, ""))


def statistics(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns `carry` and FEATURES of each row of `docs` (doc_id, text)."""
    df = docs.select("doc_id", *carry, F.coalesce("text", F.lit("")).alias("doc_text"))
    df = df.select("*", T.words(F.col("doc_text")).alias("w"), F.array_remove(F.split("doc_text", "\n"), "").alias("lines"))
    n, chars = F.size("w"), F.length("doc_text") + PRIOR_CHARS
    share = lambda c: F.sqrt(c / chars)
    return df.select(
        "doc_id",
        *carry,
        F.log(n + PRIOR_WORDS).alias("log_words"),
        F.log((F.length("doc_text") + 7 * PRIOR_WORDS) / (n + PRIOR_WORDS)).alias("word_length"),
        F.log((n + PRIOR_WORDS) / (F.size("lines") + PRIOR_LINES)).alias("log_line_words"),
        F.log((F.size(F.array_distinct("w")) + PRIOR_WORDS) / (n + PRIOR_WORDS)).alias("distinct_words"),
        F.sqrt((F.size("lines") - F.size(F.array_distinct("lines"))) / (F.size("lines") + PRIOR_LINES)).alias("repeated_lines"),
        share(_count(_SYMBOLS)).alias("symbols"),
        share(_count(_LETTERS)).alias("capitals"),
        share(_count("0123456789")).alias("digits"),
        share(_count("!?")).alias("bangs"),
        share(_count(".")).alias("stops"),
        share(_count(",;:")).alias("commas"),
        share(_count("|/\\_=@")).alias("bars"),
    )


@dataclass(frozen=True)
class Gaussian:
    """A class's log prior, mean and covariance's Cholesky factor, with half of the covariance's log determinant taken once."""

    log_prior: float
    mean: np.ndarray
    factor: np.ndarray
    log_scale: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Of each row of `x`, up to a constant: the Mahalanobis distance comes from L z = x - mean."""
        z = np.empty_like(x)
        d, low = x - self.mean, self.factor
        for j in range(low.shape[0]):
            z[:, j] = (d[:, j] - z[:, :j] @ low[j, :j]) / low[j, j]
        return self.log_prior - self.log_scale - 0.5 * (z * z).sum(axis=1)


@dataclass(frozen=True)
class Model:
    """Without `classes`, every score is `constant`."""

    classes: tuple[Gaussian, ...]
    constant: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.constant)
        difference = self.classes[1].log_density(x) - self.classes[0].log_density(x)
        return 1 / (1 + np.exp(-np.clip(difference, -700, 700)))


def fit(labelled: DataFrame, features: tuple[str, ...] = FEATURES, diagonal: float = DIAGONAL_SHRINKAGE, pooled: float = POOLED_SHRINKAGE, ridge: float = RIDGE) -> Model:
    """Fits to all rows of `labelled` (label 0 or 1, features); one row a class reaches the driver."""
    p = len(features)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(features)] + [F.sum(F.col(features[i]) * F.col(features[j])).alias(f"q{i}_{j}") for i, j in pairs]
    rows = {r["label"]: r for r in labelled.groupBy("label").agg(F.count("*").alias("n"), *sums).collect()}
    if not {0, 1} <= rows.keys():
        n0, n1 = (rows[c]["n"] if c in rows else 0 for c in (0, 1))
        return Model((), (n1 + 1) / (n0 + n1 + 2))
    total = rows[0]["n"] + rows[1]["n"]
    means, covs = {}, {}
    for c in (0, 1):
        r, q = rows[c], np.empty((p, p))
        for i, j in pairs:
            q[i, j] = q[j, i] = r[f"q{i}_{j}"]
        means[c] = np.array([r[f"s{i}"] for i in range(p)]) / r["n"]
        covs[c] = q / r["n"] - np.outer(means[c], means[c])
    both = sum(rows[c]["n"] * covs[c] for c in (0, 1)) / total
    gaussians = []
    for c in (0, 1):
        shrunk = (1 - pooled) * covs[c] + pooled * both
        shrunk = (1 - diagonal) * shrunk + diagonal * np.diag(np.diag(shrunk)) + ridge * np.eye(p)
        factor = np.linalg.cholesky(shrunk)
        gaussians.append(Gaussian(float(np.log(rows[c]["n"] / total)), means[c], factor, float(np.log(np.diag(factor)).sum())))
    return Model(tuple(gaussians))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_statistics(stats: DataFrame, model: Model, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """doc_id and score of each row of `stats`."""

    def scored(batches):
        import pyarrow as pa

        for b in batches:
            x = np.column_stack([np.asarray(b.column(f)) for f in features])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return stats.mapInArrow(scored, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def fitted(stats: DataFrame, labels: DataFrame) -> Model:
    """The model of all labelled rows of `stats` that are not held out."""
    train = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("label_id"), F.col("quality").alias("label"))
    return fit(stats.where(~held_out(F.col("doc_id"))).join(train, F.col("doc_id") == F.col("label_id")))


def classify(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of `docs` (doc_id, text); `labels`: doc_id, quality."""
    stats = materialize(statistics(docs), "quality-statistics")
    model = fitted(stats, labels)
    return score_statistics(stats, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def score_column(model: Model, features: tuple[str, ...] = FEATURES) -> Column:
    """The score as a column of `features`: those alone go through Arrow, what else a row holds stays in the JVM."""
    def scored(x: pd.DataFrame) -> pd.Series:
        return pd.Series(model.score(x.to_numpy(np.float64)))

    return F.pandas_udf(scored, "double")(F.struct(*features))


def some_labels(labels: DataFrame, rows: int = TRAIN_ROWS, seed: int = TRAIN_SEED) -> DataFrame:
    """doc_id and quality of all usable rows of `labels` that are not held out or, if there are more than `rows`, of about so many."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    n = usable.count()
    if n <= rows:
        return usable
    return usable.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(rows / n * (1 << 30)))


def accept_documents(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of `docs` whose score is at least `accept`, with all their columns; texts are mapped over, never shuffled.

    The statistics of all texts are computed once, where they are scored; the fit computes those of its labelled rows, about
    `train_rows`, whose ids are broadcast. A null text counts as empty; repeated rows and null ids are scored like any other.
    """
    some = materialize(some_labels(labels, train_rows), "quality-labels")
    train = docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id").distinct()), "doc_id", "left_semi")
    model = fitted(materialize(statistics(train), "quality-statistics"), some)
    scored = statistics(docs.select("doc_id", "text", F.struct("*").alias("doc_row")), ("doc_row",))
    return scored.where(score_column(model) >= accept).select("doc_row.*")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
