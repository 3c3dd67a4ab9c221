"""Quality rules: hashed n-gram logistic regression beside fixed counts (operator 6)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import map_text
from threadloom.llm.linear import MAX_ROWS, SYMBOLS, by_text, fetch, fit_logistic, held_out, linear_scores, mean_group, platt, repeated_words, sample, sigmoid, slot
from threadloom.llm.vectext import SPACE, U, Block, ngrams

BITS = 18
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: A document stays if its calibrated probability of quality is at least this.
KEEP = 0.5


def features(block: Block, h: np.ndarray, doc: np.ndarray, counts: np.ndarray):
    """Hashed word 1- and 2-grams and 4-byte character grams; each kind is averaged over the text.

    The last character gram of a text ends with its line feed.
    """
    pairs, first = ngrams(h, doc, 2)
    groups = [mean_group(slot(h, BITS, 1), counts), mean_group(slot(pairs, BITS, 2), np.bincount(doc[first], minlength=block.n))]
    b = block.buf.astype(U)
    m = max(len(b) - 3, 0)
    chars = (b[:m] | (b[1 : m + 1] << U(8)) | (b[2 : m + 2] << U(16)) | (b[3 : m + 3] << U(24))) * U(0x9E3779B97F4A7C15)
    inside = np.ones(len(b), bool)
    for k in range(1, 4):  # the starts from which a gram would run into the next text
        inside[np.maximum(block.bounds[1:] - k, block.bounds[:-1])] = False
    groups.append(mean_group((chars[inside[:m]] >> U(64 - BITS)).astype(np.int64), np.maximum(np.diff(block.bounds) - 3, 0)))
    return groups


def featurise(texts):
    block = Block(texts)
    starts, ends = block.words()
    doc, counts = block.doc_of(starts)
    return features(block, block.hashes(starts, ends), doc, counts)


class Model:
    def __init__(self, w: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.w, self.bias, self.slope, self.shift = w.astype(np.float32), bias, slope, shift

    def probability(self, groups) -> np.ndarray:
        return sigmoid(self.slope * linear_scores(groups, self.w, self.bias) + self.shift)


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", max_rows: int = MAX_ROWS) -> Model:
    """Fits on at most ``max_rows`` labelled documents, four fifths for the weights and one for calibration."""
    rows = fetch(docs, sample(docs, labels, id_col, label_col, max_rows), id_col, text_col, featurise, distinct=False)
    if not len(rows):
        return Model(np.zeros(1 << BITS), 0.0)
    last = np.arange(len(rows)) % 5 == 4
    part = [rows.pick(np.flatnonzero(x)) for x in (~last, last)]
    w, bias = fit_logistic(part[0], 1 << BITS)
    return Model(w, bias, *platt(part[1].scores(w, bias), part[1].label))


FIELDS = [*(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), T.StructField("probability", T.DoubleType())]
BLANK = " \t\n\x0b\x0c\r"


def repeated_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in (text or "").split("\n") if x.strip(BLANK)]
    return len(lines) - len(set(lines))


def measure(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts and the calibrated probability of quality.

    Null counts as empty: all counts are 0, and the probability is that of a text without features.
    Other columns pass through; columns with the names of the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        block = Block(texts)
        starts, ends = block.words()
        doc, counts = block.doc_of(starts)
        h = block.hashes(starts, ends)
        chars = by_text(~SPACE[block.buf] & ((block.buf & 0xC0) != 0x80), block.bounds)
        lines = np.array([repeated_lines(t) for t in texts], np.int64)
        p = shared.value.probability(features(block, h, doc, counts))
        return [counts.astype(np.int64), chars, by_text(SYMBOLS[block.buf], block.bounds), lines, repeated_words(h, doc, block.n), p]

    return map_text(docs, text_col, run, FIELDS)


def judged(rows: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("probability") >= KEEP))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id"))
    rows = judged(measure(docs, train(docs, labels)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")
