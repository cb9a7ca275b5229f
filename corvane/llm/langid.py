"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased whole text (runs of other characters than letters are one
blank) are hashed into ``BUCKETS``. Only taught rows are learned from: those that aren't held out and have a text and a language. Document
frequencies are counted over all of them. The weights are trained with the follow-the-regularised-leader rule with L1 and L2 penalties on a bounded
sample: of each language the distinct rows with the smallest seeded hashes, ``SAMPLE_ROWS`` over all languages (one row of each language at least, so that a
rare language is learned at any size). Their n-grams are counted in tasks; only ``SAMPLE_ROWS`` rows of at most BUCKETS counts reach the
driver, never texts. A temperature is then fitted on a part of the sample that training didn't see.

Edge cases: a text that is null or has no letter (``str.isalpha``) is ``und`` with score 0. Rows with a null language are
not learned from; without any labelled row every text is ``und`` with score 0; with one language that
one is predicted with score 1. Texts are taken whole, however long, one at a time. Repeated rows are predicted alike, and count once in the sample, however often
they repeat. Of equal probabilities the first language in order is predicted. A row with a null key is not held out. Columns of other names, whatever they are, aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import small_batches

BUCKETS = 1 << 14
#: Bound of the labelled rows that leave Spark for training.
SAMPLE_ROWS = 3000
#: A language gives about so many times its share of them to the last choice.
SURPLUS = 4
SEED = 29
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
EPOCHS, BATCH = 4, 32

_OTHER = re.compile(r"[\W\d_]+")


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of hashed character n-grams by bucket; None if the text has no letter."""
    clean = _OTHER.sub(" ", text.lower())
    if not clean.isascii():
        # numerals that aren't digits, such as fractions: word characters to ``re``, but no letters
        other = [c for c in set(clean) if c != " " and not c.isalpha()]
        if other:
            clean = re.sub(f"[ {''.join(other)}]+", " ", clean)
    if clean in ("", " "):
        return None
    codes = np.frombuffer(f" {clean.strip()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    grams = [codes, (codes[:-1] << np.uint64(21)) | codes[1:]]
    grams.append((grams[1][:-1] << np.uint64(21)) | codes[2:])
    buckets = [(((g + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64) for n, g in enumerate(grams)]
    return np.bincount(np.concatenate(buckets), minlength=BUCKETS)


def _bucket_counts(batches, names: list[str]):
    """The (buckets, counts) of the first column's texts, beside the other columns; null where a text has no letter."""
    for batch in batches:
        at, n = [], []
        for text in batch.column(0).to_pylist():
            counts = gram_counts(text)
            found = None if counts is None else np.flatnonzero(counts)
            at.append(found)
            n.append(None if counts is None else counts[found])
        columns = [pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32())), *batch.columns[1:]]
        yield pa.RecordBatch.from_arrays(columns, ["at", "n", *names])


def document_frequencies(taught: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Documents that hold each bucket, and documents with letters, over all rows of ``taught``.

    Tasks add up their own vectors; Spark sums BUCKETS + 1 pairs from each.
    """

    def count(batches):
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                counts = gram_counts(value)
                if counts is not None:
                    total += counts > 0
                    n += 1
        found = np.append(np.flatnonzero(total), BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.append(total[found[:-1]], n))], ["bucket", "n"])

    rows = taught.filter(F.col(text).isNotNull()).select(F.col(text).alias("_text"))
    sums = rows.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1, np.int64)
    df[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return df[:-1], int(df[-1])


@dataclass(frozen=True)
class Model:
    """Weights by bucket and language, the inverse document frequencies and the temperature."""

    langs: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def features(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weights, of length 1, of the buckets ``at``."""
        x = (1 + np.log(counts)) * self.idf[at]
        return x / max(np.sqrt((x * x).sum()), 1e-12)

    def margins(self, counts: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(counts)
        return self.features(at, counts[at]) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = gram_counts(text) if text is not None and self.langs else None
        if counts is None:
            return "und", 0.0
        p = softmax(self.margins(counts) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(sample: list[tuple[np.ndarray, np.ndarray, str]], df: np.ndarray, n_docs: int) -> Model:
    """Follow the regularised leader over (buckets, counts, lang) rows, in the order given, the last fifth kept for the temperature."""
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    langs = tuple(sorted({lang for _, _, lang in sample}))
    k = len(langs)
    model = Model(langs, idf, np.zeros((BUCKETS, k)), np.zeros(k), 1.0)
    rows = [((at, model.features(at, counts)), langs.index(lang)) for at, counts, lang in sample]
    if k < 2 or not rows:
        return model
    kept = rows[len(rows) * 4 // 5 :]
    rows = rows[: len(rows) * 4 // 5] or kept
    # one row of z and n for each bucket, the last for the bias, which has no L1 penalty
    z, n, w = (np.zeros((BUCKETS + 1, k)) for _ in range(3))
    l1 = np.full((BUCKETS + 1, 1), L1)
    l1[-1] = 0
    for _ in range(EPOCHS):
        for start in range(0, len(rows), BATCH):
            part = rows[start : start + BATCH]
            touched = np.unique(np.concatenate([at for (at, _), _ in part] + [[BUCKETS]]))
            zt, nt = z[touched], n[touched]
            shrunk = np.sign(zt) * l1[touched] - zt
            w[touched] = np.where(np.abs(zt) <= l1[touched], 0, shrunk / ((BETA + np.sqrt(nt)) / ALPHA + L2))
            grad = np.zeros((len(touched), k))
            for (at, x), label in part:
                p = softmax(x @ w[at] + w[-1])
                p[label] -= 1
                grad[np.searchsorted(touched, at)] += x[:, None] * p
                grad[-1] += p
            sigma = (np.sqrt(nt + grad * grad) - np.sqrt(nt)) / ALPHA
            z[touched] += grad - sigma * w[touched]
            n[touched] += grad * grad
    w = np.where(np.abs(z) <= l1, 0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    margins = np.array([x @ w[at] + w[-1] for (at, x), _ in kept])
    labels = np.array([label for _, label in kept])
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 120))
    loss = [-np.log(np.maximum(softmax(margins / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return Model(langs, idf, w[:-1], w[-1], float(grid[int(np.argmin(loss))]))


def held_out(key: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    small_batches(docs.sparkSession)
    taught = docs.filter(~held_out(F.col(key)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    taught = taught.select(F.xxhash64(F.lit(SEED), F.col(key), F.col(text)).alias("_order"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    df, n_docs = document_frequencies(taught, "_text")
    # distinct rows, as the choice is among them; a row a language, as the weights have a column each
    counts = taught.select("_lang", "_order").distinct().groupBy("_lang").agg(F.count("*").alias("_n")).collect()
    each = max(1, sample_rows // max(1, len(counts)))
    # hashes under a bound that some SURPLUS times ``each`` rows of a language pass, all of them if they are fewer; then the smallest of these
    bounds = docs.sparkSession.createDataFrame([(r["_lang"], SURPLUS * each / r["_n"]) for r in counts], "_lang string, _bound double")
    low = taught.select("_lang", "_order").join(F.broadcast(bounds), "_lang").filter(F.col("_order") / 2.0**64 + 0.5 <= F.col("_bound"))
    line = Window.partitionBy("_lang").orderBy("_order")
    chosen = low.select("_lang", "_order").distinct().withColumn("_at", F.row_number().over(line)).filter(F.col("_at") <= each).select("_lang", "_order")
    # bounded by ``sample_rows``, or by the languages if they are more
    sample = taught.join(F.broadcast(chosen), ["_lang", "_order"]).select("_text", "_lang", "_order")
    sample = sample.mapInArrow(lambda b: _bucket_counts(b, ["l", "o"]), "at array<int>, n array<int>, l string, o bigint").filter("at is not null")
    # rows that repeat id and text are one
    rows = sample.groupBy("l", "o").agg(F.first("at").alias("at"), F.first("n").alias("n")).toPandas().sort_values(["o", "l"])
    return train(list(zip(rows["at"], rows["n"], rows["l"], strict=True)), df, n_docs)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row."""
    small_batches(docs.sparkSession)
    # plain values, which workers read without this module
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.idf, model.weights, model.bias, model.temperature))

    def predict(batches):
        known = Model(*shared.value)
        for batch in batches:
            found = [known.predict(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "lang_pred", "score"])

    rows = docs.select(F.col(key).alias(key), F.col(text).alias("_text"))
    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return rows.mapInArrow(predict, T.StructType(fields))


def identify_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score): fit on the rows that aren't held out, predict every row."""
    found = identify(docs, fit(docs, key, text, lang), key, text)
    return found.select(key, held_out(F.col(key)).alias("held_out"), "lang_pred", "score")
