"""Quality classifier: regularised quadratic discriminant over document statistics.

``document_statistics`` counts over every whole text; ``transformed`` makes statistics of the counts. ``fit`` sums the statistics and their
products for each class and fold in the tasks (a bounded number of sums leaves Spark), shrinks each class covariance towards the pooled one and a
multiple of the identity, and keeps the Cholesky factors. How far it shrinks, and how much ordinary prose is counted in with each text, is chosen by
cross-validation inside the rows that it learns from: a model for each fold and choice is learned from the other folds' sums, one pass sums the log losses
of the fold's rows, and the choice with the least loss is then learned from all of them. A score is the logistic function of the
difference of the classes' log densities plus that of their log priors.

Edge cases: null and empty texts have the statistics of an empty text and get a score as others do. Texts are taken whole, however long, one at a time.
Repeated rows count as often as they occur. Rows with a null label are not learned from; if a class
has no labelled row, every score is the share of label 1 (0.5 without any labels). Labels that
repeat a key count once; a key with two different labels isn't learned from, nor a null key. Columns of other names, whatever they are, aren't read,
and ``keep_quality`` gives them back. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import small_batches, written

STATISTICS = (
    "chars", "words", "word_length", "upper", "symbols", "marks", "digits", "lines", "line_length", "distinct_words",
    "distinct_lines", "wide",
)
#: Counts of a text.
COUNTS = 11
#: Shares of the pooled covariance and of the scaled identity in a class covariance, to choose from by cross-validation.
POOLED, IDENTITY = (0.0, 0.25, 0.5, 0.75, 0.9), (0.001, 0.01, 0.1)
FOLDS = 4
#: A name that no caller's column has.
REJECTED = "_rejected_2f6b1d"
#: (characters, share): so many characters of ordinary prose, of which a share are capitals, a share punctuation marks and a share bytes of wide
#: characters, are counted in with each text, so that a few words don't look extreme. To choose from by cross-validation; the first is the usual one.
PRIORS = ((64, 0.02), (16, 0.02), (256, 0.02), (64, 0.0), (64, 0.05))


def _table(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_UPPER = _table(bytes(range(65, 91)))
_DIGIT = _table(bytes(range(48, 58)))
_MARK = _table(b".,;:?'-")
_SYMBOL = _table(bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in b".,;:?'-"))


def counts(text: bytes) -> list[int]:
    """Counts over one text (UTF-8): bytes, words, letters, capitals, symbols, marks, digits, lines, distinct words, distinct lines, bytes of wide characters."""
    words, lines = text.split(), text.split(b"\n")
    n = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper = n[_UPPER].sum()
    found = (len(text), len(words), upper + n[97:123].sum(), upper, n[_SYMBOL].sum(), n[_MARK].sum(), n[_DIGIT].sum(), len(lines), len(set(words)), len(set(lines)), n[128:].sum())
    return [int(x) for x in found]


def transformed(found: np.ndarray, prior: tuple[int, float] = PRIORS[0]) -> np.ndarray:
    """The statistics (rows of STATISTICS) of rows of counts: logarithms of sizes, square roots of shares."""
    size, words, letters, upper, symbols, marks, digits, lines, distinct_words, distinct_lines, wide = np.asarray(found, float).reshape(-1, COUNTS).T
    prose, usual = prior
    n_words = np.maximum(words, 1)

    def share(part: np.ndarray, of: np.ndarray, expected: float = 0.0) -> np.ndarray:
        return np.sqrt((part + prose * expected) / (of + prose))

    return np.column_stack(
        [
            np.log1p(size),
            np.log1p(words),
            np.log1p((size + prose) / (n_words + prose / 8)),
            share(upper, letters, usual),
            share(symbols, size),
            share(marks, size, usual),
            share(digits, size),
            np.log1p(lines),
            np.log1p(size / lines),
            # distinct words fall with length: the exponent of growth hardly does
            np.log1p(distinct_words) / np.log1p(n_words),
            (distinct_lines + prose / 8) / (lines + prose / 8),
            share(wide, size, usual),
        ]
    )


def statistics(text: bytes, prior: tuple[int, float] = PRIORS[0]) -> np.ndarray:
    """The statistics of one text (UTF-8)."""
    return transformed(np.array(counts(text)), prior)[0]


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, x): the counts of every row, of which ``fit`` and ``score`` make statistics."""
    small_batches(docs.sparkSession)

    def measure(batches):
        for batch in batches:
            x = pa.array([counts(t) for t in batch.column(1).cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], [key, "x"])

    rows = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("x", T.ArrayType(T.LongType()))]
    return rows.mapInArrow(measure, T.StructType(fields))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), COUNTS)


@dataclass(frozen=True)
class Discriminant:
    """log priors, means and inverse Cholesky factors of the classes 0 and 1; ``constant`` if one of them is missing."""

    prior: np.ndarray
    mean: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    constant: float | None = None
    prose: tuple[int, float] = PRIORS[0]

    def score(self, found: np.ndarray) -> np.ndarray:
        """Scores of rows of counts."""
        return self.judged(transformed(found, self.prose))

    def judged(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of statistics."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        log_density = []
        for c in (0, 1):
            z = (x - self.mean[c]) @ self.whiten[c].T
            log_density.append(self.prior[c] - 0.5 * (z * z).sum(axis=1) - 0.5 * self.log_det[c])
        gap = np.clip(log_density[1] - log_density[0], -500, 500)
        return 1 / (1 + np.exp(-gap))


@dataclass(frozen=True)
class Sums:
    """Rows of the classes 0 and 1, and the sums of their statistics and of the products of these."""

    n: np.ndarray
    total: np.ndarray
    square: np.ndarray

    @staticmethod
    def nothing() -> Sums:
        d = len(STATISTICS)
        return Sums(np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d)))

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.n + other.n, self.total + other.total, self.square + other.square)

    def model(self, prose: tuple[int, float], pooled: float, identity: float) -> Discriminant:
        n = self.n
        if n.min() == 0:
            share = n[1] / n.sum() if n.sum() else 0.5
            return Discriminant(np.zeros(2), self.total, np.zeros_like(self.square), np.zeros(2), float(share), prose)
        mean = self.total / n[:, None]
        scatter = self.square - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
        shared = scatter.sum(axis=0) / n.sum()
        # scale of each statistic, so that the identity's share means the same for all
        scale = np.diag(np.maximum(np.diag(shared), 1e-6))
        whiten, log_det = [], []
        for c in (0, 1):
            own = (1 - pooled) * scatter[c] / n[c] + pooled * shared
            factor = np.linalg.cholesky((1 - identity) * own + identity * scale)
            whiten.append(np.linalg.inv(factor))
            log_det.append(2 * np.log(np.diag(factor)).sum())
        return Discriminant(np.log(n / n.sum()), mean, np.array(whiten), np.array(log_det), prose=prose)


def _sums(taught: DataFrame, label: str, priors: Sequence[tuple[int, float]]) -> list[list[Sums]]:
    """Sums of (x, label, fold) rows by way of counting prose in and by fold."""
    d = len(STATISTICS)
    lower = np.tril_indices(d)

    def added(batches):
        total = np.zeros((len(priors), FOLDS, 2, 1 + d + len(lower[0])))
        for batch in batches:
            found = _rows(batch.column(0))
            y, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for at, prior in enumerate(priors):
                x = transformed(found, prior)
                for f in range(FOLDS):
                    for c in (0, 1):
                        own = x[(fold == f) & (y == c)]
                        total[at, f, c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own)[lower]])
        total = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "v"])

    # a bounded number of sums, whatever the table
    total = np.zeros((len(priors), FOLDS, 2, 1 + d + len(lower[0])))
    for row in taught.select("x", label, "fold").mapInArrow(added, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        total.flat[row["at"]] = row["v"]
    square = np.zeros((len(priors), FOLDS, 2, d, d))
    square[..., lower[0], lower[1]] = square[..., lower[1], lower[0]] = total[..., 1 + d :]
    return [[Sums(total[p, f, :, 0], total[p, f, :, 1 : 1 + d], square[p, f]) for f in range(FOLDS)] for p in range(len(priors))]


def fit(stats: DataFrame, label: str = "quality", pooled: Sequence[float] = POOLED, identity: Sequence[float] = IDENTITY, priors: Sequence[tuple[int, float]] = PRIORS[:1]) -> Discriminant:
    """Learn from (x, label) rows with label 0 or 1; the shares and the prose counted in are chosen by cross-validation among the given ones."""
    taught = stats.filter(F.col(label).isin(0, 1)).select("x", F.col(label).cast("int").alias(label), F.pmod(F.xxhash64("x"), F.lit(FOLDS)).cast("int").alias("fold"))
    priors = [tuple(p) for p in priors]
    parts = _sums(taught, label, priors)
    every = [sum(own, Sums.nothing()) for own in parts]
    choices = [(q, p, i) for q in range(len(priors)) for p in pooled for i in identity]

    def learned(sums: Sums, choice: tuple[int, float, float]) -> Discriminant:
        return sums.model(priors[choice[0]], *choice[1:])

    if every[0].n.min() == 0 or len(choices) == 1:
        return learned(every[0], choices[0])
    # models of each fold, learned from the others
    models = [[learned(sum((s for g, s in enumerate(parts[c[0]]) if g != f), Sums.nothing()), c) for c in choices] for f in range(FOLDS)]

    def losses(batches):
        total = np.zeros(len(choices))
        for batch in batches:
            found = _rows(batch.column(0))
            y, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            stats_of = [transformed(found, p) for p in priors]
            for f in np.unique(fold):
                here = fold == f
                for at, model in enumerate(models[f]):
                    p = np.clip(model.judged(stats_of[choices[at][0]][here]), 1e-9, 1 - 1e-9)
                    total[at] -= np.log(np.where(y[here] == 1, p, 1 - p)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(choices))), pa.array(total)], ["choice", "loss"])

    found = taught.select("x", label, "fold").mapInArrow(losses, "choice bigint, loss double").groupBy("choice").agg(F.sum("loss").alias("loss")).collect()
    # equal to nine digits: the first of them, whatever the order of a sum
    best = choices[min(found, key=lambda r: (float(f"{r['loss']:.9g}"), r["choice"]))["choice"]]
    return learned(every[best[0]], best)


def score(stats: DataFrame, model: Discriminant, key: str = "doc_id") -> DataFrame:
    """(key, score, predicted) of (key, x) rows."""

    def judge(batches):
        for batch in batches:
            s = model.score(_rows(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [key, "score", "predicted"])

    fields = [T.StructField(key, stats.schema[key].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return stats.select(key, "x").mapInArrow(judge, T.StructType(fields))


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves the remainder ``part``; false for null keys."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def classify_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every document, learned from the labelled rows that aren't held out."""
    stats = written(document_statistics(docs, key, text), "quality-statistics")
    known = labels.groupBy(F.col(key).alias("_key")).agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
    known = known.filter("quality = _most").select("_key", "quality")
    taught = stats.filter(~held_out(F.col(key), 3, 1)).join(known, F.col(key) == F.col("_key"))
    scored = score(stats, fit(taught, priors=PRIORS), key)
    return scored.select(key, held_out(F.col(key), 3, 1).alias("held_out"), "score", "predicted")


def keep_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, columns as they are."""
    verdicts = classify_quality(docs, labels, key, text).filter("predicted = 0").select(F.struct(F.col(key).alias("key")).alias(REJECTED))
    return docs.join(verdicts.distinct(), F.struct(docs[key].alias("key")) == F.col(REJECTED), "left_anti")
