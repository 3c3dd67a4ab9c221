"""Quality classifier by positive-unlabelled learning (operator 3).

Trusted positives are labelled documents of quality 1; the unlabelled are documents of all kinds, labels unseen.
The linear model minimises the non-negative unbiased risk with logistic loss:
prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)); where the second part is below 0, steps go against it.
The class prior is estimated from positives and unlabelled alone: a classifier of the one against the
other is fitted on half of each, and of the other halves the shares above thresholds are compared, where
negatives are rare. At last the bias is moved so that the mean score of the unlabelled sample is the prior.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import map_text
from threadloom.llm.linear import DIGIT, SYMBOLS, UPPER, Group, Rows, by_text, descend, fetch, fit_logistic, held_out, linear_scores, mean_group, repeated_words, sample, sigmoid, slot
from threadloom.llm.vectext import SPACE, Block, sums

BITS, BINS = 16, 24
DENSE = 8
SIZE = (1 << BITS) + DENSE * BINS
#: Training takes at most this many positives and as many unlabelled documents, by the least hashes of their ids.
MAX_ROWS = 3000
THRESHOLD = 0.7


def featurise(texts) -> list[Group]:
    """Hashed words, averaged over the text, and the text's shares (repetition, symbols, case, ...) by bins."""
    block = Block(texts)
    starts, ends = block.words()
    doc, counts = block.doc_of(starts)
    h = block.hashes(starts, ends)
    words = np.maximum(counts, 1)
    size = np.maximum(np.diff(block.bounds) - 1, 1)
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    kinds = np.bincount(doc[order][new], minlength=block.n)
    shares = [
        repeated_words(h, doc, block.n) / words,
        repeated_words(h, doc, block.n, 2) / words,
        np.sqrt(by_text(SYMBOLS[block.buf], block.bounds) / size),
        np.sqrt(by_text(UPPER[block.buf], block.bounds) / size),
        np.sqrt(by_text(DIGIT[block.buf], block.bounds) / size),
        np.sqrt(by_text((block.buf > 32) & (block.buf < 65) & ~DIGIT[block.buf], block.bounds) / size),
        1 - kinds / words,
        np.log1p(counts) / 12,
    ]
    bins = np.stack([np.clip((s * BINS).astype(np.int64), 0, BINS - 1) + k * BINS for k, s in enumerate(shares)], axis=1) + (1 << BITS)
    return [mean_group(slot(h, BITS, 21), counts), Group(bins.ravel(), np.full(block.n, DENSE), np.full(block.n, 1.0))]


class Model:
    def __init__(self, w: np.ndarray, bias: float):
        self.w, self.bias = w.astype(np.float32), bias

    def probability(self, groups) -> np.ndarray:
        return sigmoid(linear_scores(groups, self.w, self.bias))


def nnpu(pos: Rows, unl: Rows, prior: float, epochs: int = 20, batch: int = 64, rate: float = 0.05, l2: float = 1e-4) -> Model:
    w, state, bias, bias_state = np.zeros(SIZE), np.zeros(SIZE), 0.0, 0.0
    rng = np.random.default_rng(3)
    steps = max(1, max(len(pos), len(unl)) // batch)
    for _ in range(epochs):
        p_order, u_order = rng.permutation(len(pos)), rng.permutation(len(unl))
        for i in range(steps):
            p, u = (np.take(o, np.arange(i * batch, (i + 1) * batch), mode="wrap") for o in (p_order, u_order))
            zp, zu = (sums(w[x] * v, c) + bias for x, v, c in (pos.batch(p), unl.batch(u)))
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if negative >= 0:
                gp, gu = np.full(len(p), -prior / len(p)), sigmoid(zu) / len(u)
            else:
                gp, gu = prior * sigmoid(zp) / len(p), -sigmoid(zu) / len(u)
            descend(pos, p, gp, w, state, rate, l2)
            descend(unl, u, gu, w, state, rate, l2)
            g = gp.sum() + gu.sum()
            bias_state += g * g
            bias -= rate * g / np.sqrt(bias_state + 1e-8)
    z, low, high = unl.scores(w, bias), -40.0, 40.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if sigmoid(z + mid).mean() < prior else (low, mid)
    return Model(w, bias + low)


def class_prior(pos: Rows, unl: Rows) -> float:
    """The share of positives among the unlabelled.

    A threshold that a share q of the positives passes is passed by prior * q of the unlabelled and by the
    negatives among these, so the ratio of both shares is never below the prior but by chance. The answer is
    the ratio at the threshold where it is least with two standard errors on top; of two such answers, each
    half having been fitted on for the other, the lesser.
    """
    halves = [(pos.pick(np.arange(k, len(pos), 2)), unl.pick(np.arange(k, len(unl), 2))) for k in (0, 1)]
    if not all(len(rows) for half in halves for rows in half):
        return 0.5
    found = []
    for fit, held in (halves, halves[::-1]):
        both = Rows.joined(*fit)
        both.label = np.repeat([1.0, 0.0], [len(rows) for rows in fit])
        w, bias = fit_logistic(both, SIZE)
        zp, zu = (np.sort(rows.scores(w, bias)) for rows in held)
        cuts = np.concatenate((zp, zu))
        p, u = (1 - np.searchsorted(z, cuts) / len(z) for z in (zp, zu))
        p, u = p[p > 0], u[p > 0]
        error = [np.sqrt(np.maximum(q * (1 - q), 1 / len(z)) / len(z)) for q, z in ((p, zp), (u, zu))]
        ratio = u / p
        found.append(ratio[(ratio + 2 * (error[1] + ratio * error[0]) / p).argmin()])
    return float(np.clip(min(found), 0.05, 0.99))


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", max_rows: int = MAX_ROWS) -> Model:
    """``docs`` and ``labels`` hold what may be learned from; of the labels only those of quality 1 are read.

    The unlabelled are sampled from all documents. Without positives or documents, all scores are 0.5.
    """
    positives = sample(docs, labels.where(F.col(label_col) == 1), id_col, label_col, max_rows)
    unlabelled = sample(docs, docs.select(id_col, F.lit(0).alias("label")), id_col, "label", max_rows, "u")
    pos = fetch(docs, positives, id_col, text_col, featurise, distinct=False)
    unl = fetch(docs, unlabelled, id_col, text_col, featurise, distinct=False)
    if not len(pos) or not len(unl):
        return Model(np.zeros(SIZE), 0.0)
    return nnpu(pos, unl, class_prior(pos, unl))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score, the probability of quality; null counts as empty, which has a score as well.

    Other columns pass through; a column named score is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_text(docs, text_col, lambda texts: [shared.value.probability(featurise(texts))], [T.StructField("score", T.DoubleType())])


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs.where(~held_out("doc_id")), labels.where(~held_out("doc_id")))
    rows = score(docs, model)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (rows.score >= THRESHOLD).cast("int").alias("predicted"))
