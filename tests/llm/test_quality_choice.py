"""The choice of shrinkage and of the prose counted in, against a plain cross-validation."""

import random

import numpy as np
from pyspark.sql import functions as F

from corvane.llm import quality


def test_choice_against_plain_cross_validation(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["Alpha", "beta,", "gamma.", "12", "$$", "é"]) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    y = np.array([int((len(t) + rng.randint(0, 60)) > 90) for t in texts])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id bigint, quality int")
    stats = quality.document_statistics(docs).join(labels, "doc_id")
    folds = {r[0]: r[1] for r in stats.select("doc_id", F.pmod(F.xxhash64("x"), F.lit(quality.FOLDS)).alias("fold")).collect()}
    fold = np.array([folds[i] for i in range(len(texts))])
    pooled, identity, priors = (0.0, 0.75), (0.001, 0.1), ((64, 0.02), (4, 0.2), (900, 0.0))
    model = quality.fit(stats, pooled=pooled, identity=identity, priors=priors)

    def plain(x, c, p, i):
        """Log density differences of all rows by a model of the rows ``c``."""
        parts = [x[c & (y == k)] for k in (0, 1)]
        shared = sum(np.cov(q.T, bias=True) * len(q) for q in parts) / c.sum()
        log = []
        for q in parts:
            s = (1 - i) * ((1 - p) * np.cov(q.T, bias=True) + p * shared) + i * np.diag(np.maximum(np.diag(shared), 1e-6))
            gap = x - q.mean(axis=0)
            log.append(np.log(len(q) / c.sum()) - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(s), gap) - 0.5 * np.linalg.slogdet(s)[1])
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -500, 500)))

    losses = {}
    for prior in priors:
        x = np.array([quality.statistics(t.encode(), prior) for t in texts])
        for p in pooled:
            for i in identity:
                loss = 0.0
                for f in range(quality.FOLDS):
                    s = np.clip(plain(x, fold != f, p, i), 1e-9, 1 - 1e-9)[fold == f]
                    loss -= np.log(np.where(y[fold == f] == 1, s, 1 - s)).sum()
                losses[prior, p, i] = loss
    prior, p, i = min(losses, key=losses.get)
    assert model.prose == prior
    want = plain(np.array([quality.statistics(t.encode(), prior) for t in texts]), np.ones(len(y), bool), p, i)
    got = {r["doc_id"]: r["score"] for r in quality.score(quality.document_statistics(docs), model).collect()}
    assert all(abs(got[n] - w) < 1e-6 for n, w in enumerate(want))
