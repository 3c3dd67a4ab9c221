"""Linear models over hashed features: sparse rows, bounded training samples, scoring in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import crc_mod, map_text
from threadloom.llm.vectext import SPACE, U, Block, mix, ngrams, sums

#: Training takes at most this many labelled documents (whole texts), those with the least hashes of their ids.
MAX_ROWS = 4000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
#: Marks what is no part of a bare word: ASCII other than letters and digits.
BARE = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


class Group:
    """Features of one kind of a block of texts: indices in text order, how many each text has, and the value of each text's features."""

    def __init__(self, index: np.ndarray, counts: np.ndarray, value: np.ndarray):
        self.index, self.counts, self.value = index, counts, value


def mean_group(index: np.ndarray, counts: np.ndarray) -> Group:
    return Group(index, counts, 1.0 / np.maximum(counts, 1))


def slot(h: np.ndarray, bits: int, salt: int) -> np.ndarray:
    return (mix(h + U(salt)) >> U(64 - bits)).astype(np.int64)


def repeated_words(h: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 5) -> np.ndarray:
    """Words of each text in ``width``-word windows that the text has twice or more, the first included."""
    grams, first = ngrams(h, doc, width)
    if not len(grams):
        return np.zeros(n_docs, np.int64)
    owner = doc[first]
    order = np.lexsort((grams, owner))
    same = (grams[order][1:] == grams[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(grams), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = first[order[twice]]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.bincount(doc[np.cumsum(edge)[:-1] > 0], minlength=n_docs)


def by_text(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(marks)))
    return total[bounds[1:]] - total[bounds[:-1]]


def sparse_rows(groups: list[Group], n: int, distinct: bool) -> tuple[list[bytes], list[bytes]]:
    """Each text's indices (unsigned 32-bit) and values (float): summed, or 1 for each distinct index."""
    rows, values = [], []
    ends = [np.cumsum(g.counts) for g in groups]
    for i in range(n):
        idx = np.concatenate([g.index[e[i] - g.counts[i] : e[i]] for g, e in zip(groups, ends)])
        own, back = np.unique(idx, return_inverse=True)
        if distinct:
            val = np.ones(len(own), np.float32)
        else:
            w = np.concatenate([np.full(g.counts[i], g.value[i]) for g in groups])
            val = np.bincount(back, w, len(own)).astype(np.float32)
        rows.append(own.astype(np.uint32).tobytes())
        values.append(val.tobytes())
    return rows, values


def sample(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, limit: int, seed: str = "") -> DataFrame:
    """At most ``limit`` rows (id, label) of the labels, one for each id, by the least hash of the id."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("label"))
    return one.orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(limit)


class Rows:
    """Sparse training rows."""

    def __init__(self, table: pa.Table):
        order = np.argsort(np.array(table.column("key").to_pylist(), dtype=object).astype(str), kind="stable") if table.num_rows else np.zeros(0, int)
        table = table.take(pa.array(order))
        self.label = table.column("label").to_numpy().astype(float)
        self.index = [np.frombuffer(x, np.uint32).astype(np.int64) for x in table.column("idx").to_pylist()]
        self.value = [np.frombuffer(x, np.float32) for x in table.column("val").to_pylist()]

    def __len__(self) -> int:
        return len(self.label)

    def pick(self, at: np.ndarray) -> Rows:
        out = Rows.__new__(Rows)
        out.label, out.index, out.value = self.label[at], [self.index[i] for i in at], [self.value[i] for i in at]
        return out

    @staticmethod
    def joined(a: Rows, b: Rows) -> Rows:
        out = Rows.__new__(Rows)
        out.label, out.index, out.value = np.concatenate((a.label, b.label)), a.index + b.index, a.value + b.value
        return out

    def batch(self, at: np.ndarray):
        return np.concatenate([self.index[i] for i in at]), np.concatenate([self.value[i] for i in at]), np.array([len(self.index[i]) for i in at])

    def scores(self, w: np.ndarray, bias: float) -> np.ndarray:
        return np.array([float(w[i] @ v) if len(i) else 0.0 for i, v in zip(self.index, self.value)]) + bias


def fetch(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, featurise: Callable, distinct: bool) -> Rows:
    """Features of the chosen (id, label) rows; ``chosen`` is bounded, so that it may be broadcast and collected."""
    base = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    rows = base.join(F.broadcast(chosen.select(F.col(id_col).alias("key"), F.col("label").cast("double").alias("label"))), "key")
    fields = [T.StructField("idx", T.BinaryType()), T.StructField("val", T.BinaryType())]
    made = map_text(rows, "text", lambda texts: list(sparse_rows(featurise(texts), len(texts), distinct)), fields)
    return Rows(made.drop("text").toArrow())


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def descend(rows: Rows, at: np.ndarray, gradient: np.ndarray, w: np.ndarray, state: np.ndarray, rate: float, l2: float) -> None:
    """One AdaGrad step for the given rows, whose losses have these derivatives by the score."""
    idx, val, counts = rows.batch(at)
    g = np.repeat(gradient, counts) * val
    own, back = np.unique(idx, return_inverse=True)
    g = np.bincount(back, g, len(own)) + l2 * w[own]
    state[own] += g * g
    w[own] -= rate * g / np.sqrt(state[own] + 1e-8)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make sigmoid(slope * z + shift) a probability of y = 1."""
    if len(y) < 10 or y.min() == y.max():
        return 1.0, 0.0
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = sigmoid(a * z + b)
        r, v = p - t, p * (1 - p) + 1e-9
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, [(r * z).sum(), r.sum()])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit_logistic(rows: Rows, size: int, epochs: int = 12, batch: int = 32, rate: float = 0.3, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias (the last weight) of a logistic regression by AdaGrad."""
    w, state, bias, bias_state = np.zeros(size), np.zeros(size), 0.0, 0.0
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            idx, val, counts = rows.batch(at)
            r = (sigmoid(sums(w[idx] * val, counts) + bias) - rows.label[at]) / len(at)
            descend(rows, at, r, w, state, rate, l2)
            bias_state += r.sum() ** 2
            bias -= rate * r.sum() / np.sqrt(bias_state + 1e-8)
    return w, bias


def held_out(id_col: str, n: int = 4, which: int = 2) -> Column:
    return crc_mod(id_col, n) == which


def linear_scores(groups: list[Group], w: np.ndarray, bias: float) -> np.ndarray:
    return sum((sums(w[g.index], g.counts) * g.value for g in groups), np.full(len(groups[0].counts), bias, float))
