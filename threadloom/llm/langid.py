"""Language identification with interpolated Kneser-Ney character models (operator 10).

For each language a 4-gram model over normalised characters (letters in lower case; everything else
is one space). All n-grams that occur in any language are kept in sorted arrays, each with a row of
log probabilities, one for each language, in which the interpolation is already done; the same arrays
have the back-off weights of n-grams as contexts. A text goes to the language with the lowest
cross-entropy per character. It is rejected if it has no letter, or if that cross-entropy is beyond a
limit, which is wider for short texts. The limit and the scale of the scores are calibrated on held-back
training documents by a model that has not seen them: the limit is where an exponential tail of their
excess leaves one in a million, and the scale is that with the least log loss.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import Scratch, blocks, crc_mod, filter_text, map_text

ORDER = 4
U = np.uint64
SPACE = 32
#: Training reads at most this many documents of each language, those with the least hashes of their ids.
TRAIN_DOCS = 1500
#: Of documents in a learned language so many may be rejected.
REJECTED = 1e-6
#: Texts with fewer symbols are too short to be rejected for their cross-entropy; chance evens out up to LONG symbols.
SHORT, LONG = 20, 400
UND = "und"
_table = None


def char_table() -> np.ndarray:
    """Code point below 0x3000 -> lower case letter, or space for what is no letter."""
    global _table
    if _table is None:
        t = np.full(0x10000, SPACE, np.uint16)
        for c in range(0x10000):
            if chr(c).isalpha():
                low = chr(c).lower()
                t[c] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
        _table = t
    return _table


def normalise(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of 16-bit symbols, each after three spaces, runs of spaces single; and where each begins.

    Letters beyond the basic plane share one symbol; what is no letter there is a space, as elsewhere.
    """
    joined = "\n".join(t or "" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = points > 0xFFFF
    sym = char_table()[np.where(high, 0xAC00, points).astype(np.uint16)]
    if high.any():
        distinct, back = np.unique(points[high], return_inverse=True)
        sym[high] = np.where([chr(c).isalpha() for c in distinct], 0xAC00, SPACE)[back]
    length = np.array([len(t or "") for t in texts], np.int64)
    begin = np.cumsum(length + 1) - (length + 1)
    keep = sym != SPACE
    keep[1:] |= keep[:-1]  # the first space after a letter
    place = np.cumsum(keep) - keep
    first = place[np.minimum(begin, len(sym) - 1)] if len(sym) else begin
    first = np.where(begin < len(sym), first, int(keep.sum()))
    return sym[keep], first


def windows(sym: np.ndarray, n: int) -> np.ndarray:
    """All runs of n symbols, 16 bits each, packed in 64 bits; the last symbol is lowest."""
    m = len(sym) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    s = sym.astype(U)
    out = s[:m].copy()
    for k in range(1, n):
        out = (out << U(16)) | s[k : k + m]
    return out


def padded(sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with ORDER - 1 spaces before each text, the places to score and how many each text has."""
    counts = np.diff(np.append(first, len(sym)))
    pad = ORDER - 1
    owner = np.repeat(np.arange(len(first)), counts)
    place = np.arange(len(sym)) + pad * (owner + 1)
    out = np.full(len(sym) + pad * len(first), SPACE, np.uint16)
    out[place] = sym
    return out, place, counts


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    sym, place, _ = padded(*normalise(texts))
    grams = windows(sym, ORDER)[place - (ORDER - 1)] if len(place) else np.zeros(0, U)
    return np.unique(grams, return_counts=True)


class Model:
    """Sorted arrays of n-grams of each order with rows of log probabilities and back-off weights."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        n = len(self.languages)
        self.middle, self.slack = np.full(n, np.inf), 0.0  # a language's usual cross-entropy, and what may come on top
        self.scale = 1.0
        vocabulary = np.unique(np.concatenate([np.unique(g & U(0xFFFF)) for g, _ in counts.values()]) if n else np.zeros(0, U))
        self.floor = np.full(n, -np.log(max(len(vocabulary), 1) + 1.0))
        per: list[list] = []  # of each order: (grams, counts) by language; lower orders count distinct left extensions
        grams = [counts[x] for x in self.languages]
        per.append(grams)
        for order in range(ORDER - 1, 0, -1):
            mask = U((1 << (16 * order)) - 1)
            grams = [np.unique(g & mask, return_counts=True) for g, _ in grams]
            per.append(grams)
        per.reverse()  # per[k] is order k + 1
        self.keys, self.logp, self.loglam, self.contexts = [], [], [], []
        lower = None
        for k, own in enumerate(per):
            keys = np.unique(np.concatenate([g for g, _ in own])) if n else np.zeros(0, U)
            contexts = np.unique(keys >> U(16))
            prob, lam = np.zeros((len(keys), n)), np.ones((len(contexts), n))
            for i, (g, c) in enumerate(own):
                ones, twos = (c == 1).sum(), (c == 2).sum()
                d = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9)
                ctx = np.searchsorted(contexts, g >> U(16))
                total, kinds = np.bincount(ctx, c, len(contexts)), np.bincount(ctx, minlength=len(contexts))
                seen = total > 0
                lam[seen, i] = d * kinds[seen] / total[seen]
                prob[np.searchsorted(keys, g), i] = (c - d) / total[ctx]
            below = np.exp(self.floor)[None, :] if lower is None else np.exp(self.lookup(k - 1, keys & U((1 << (16 * k)) - 1)))
            prob += lam[np.searchsorted(contexts, keys >> U(16))] * below
            self.keys.append(keys)
            self.logp.append(np.log(np.maximum(prob, 1e-12)).astype(np.float32))
            self.contexts.append(contexts)
            self.loglam.append(np.log(lam).astype(np.float32))
            lower = prob

    def lookup(self, order: int, grams: np.ndarray) -> np.ndarray:
        """Rows of log probabilities of n-grams of ``order`` + 1 symbols; unseen ones back off."""
        keys = self.keys[order]
        out = np.empty((len(grams), len(self.languages)), np.float32)
        at = self.find(order, grams)
        hit = keys[at] == grams if len(keys) else np.zeros(len(grams), bool)
        out[hit] = self.logp[order][at[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            g = grams[miss]
            if order == 0:
                low = np.broadcast_to(self.floor, (len(g), len(self.languages))).astype(np.float32)
            else:
                low = self.lookup(order - 1, g & U((1 << (16 * order)) - 1))
            contexts = self.contexts[order]
            if len(contexts):
                c = np.minimum(np.searchsorted(contexts, g >> U(16)), len(contexts) - 1)
                low = low + np.where((contexts[c] == g >> U(16))[:, None], self.loglam[order][c], 0)
            out[miss] = low
        return out

    def find(self, order: int, grams: np.ndarray) -> np.ndarray:
        """Where each n-gram is in the sorted keys, if it is there. Repeated n-grams are looked up once."""
        top = max(len(self.keys[order]) - 1, 0)
        return np.minimum(np.searchsorted(self.keys[order], grams), top)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol of each text (rows) in each language, and the number of symbols."""
        sym, place, counts = padded(*normalise(texts))
        out = np.zeros((len(texts), len(self.languages)))
        if len(place) and self.languages:
            grams = windows(sym, ORDER)[place - (ORDER - 1)]
            distinct, back = np.unique(grams, return_inverse=True)
            logs = self.lookup(ORDER - 1, distinct).astype(np.float64)
            full = counts > 0
            begin = (np.cumsum(counts) - counts)[full]
            for i in range(len(self.languages)):
                out[full, i] = -np.add.reduceat(logs[back, i], begin) / counts[full]
        return out, counts

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score (0 to 1), cross-entropy and whether it is rejected."""
        h, counts = self.entropies(texts)
        if not self.languages:
            return [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        best = h.argmin(axis=1)
        low = h[np.arange(len(h)), best]
        weight = -(h - low[:, None]) * np.sqrt(counts)[:, None] * self.scale
        score = 1 / np.exp(np.maximum(weight, -700)).sum(axis=1)
        none = counts == 0
        rejected = none | ((counts >= SHORT) & (low > self.middle[best] * (1 + self.slack / np.sqrt(np.clip(counts, 1, LONG)))))
        return [UND if x else self.languages[b] for x, b in zip(none, best)], np.where(none, 0.0, score), np.where(none, 0.0, low), rejected


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = TRAIN_DOCS, target: float = REJECTED) -> Model:
    """A model of the languages in ``docs``, whose every row may be learned from.

    Of each language at most ``max_docs`` documents are read, whole; one is enough to learn it. Rows
    with null text or language are left out. A tenth of them is held back for calibration: ``target`` is the
    share of documents of the learned languages to be rejected. Without held-back documents nothing is
    rejected but texts without letters.
    """
    from pyspark.sql.window import Window

    named = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    order = F.xxhash64(F.col(id_col))
    # pre-select by a hash threshold at which each language has enough, so that no language is sorted whole
    sizes = {r[0]: r[1] for r in named.groupBy(lang_col).count().collect()}
    rate = F.coalesce(F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, 3 * max_docs / v + 0.001))])[F.col(lang_col)], F.lit(0.0)) if sizes else F.lit(0.0)
    near = named.where(F.pmod(order, F.lit(1_000_000)) < rate * 1_000_000)
    ids = near.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), order.alias("__h"))
    ids = ids.withColumn("__n", F.row_number().over(Window.partitionBy("__lang").orderBy(F.pmod("__h", F.lit(1_000_000)), "__h", "__id"))).where(F.col("__n") <= max_docs)
    ids = ids.select("__id").distinct()
    rows = near.join(F.broadcast(ids), F.col(id_col) == F.col("__id")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), (F.pmod(F.xxhash64(id_col, F.lit("held")), F.lit(10)) == 0).alias("held"))

    schema = "lang string, held boolean, gram long, n long"

    def count(batches):
        for batch in batches:
            langs, texts, held = (batch.column(i).to_pylist() for i in range(3))
            by: dict = {}
            for x, t, y in zip(langs, texts, held):
                by.setdefault((x, y), []).append(t)
            for (x, y), own in by.items():
                for i, j in blocks(own):
                    g, n = gram_counts(own[i:j])
                    yield pa.RecordBatch.from_arrays([pa.array([x] * len(g), pa.string()), pa.array([y] * len(g), pa.bool_()), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "held", "gram", "n"])

    scratch = Scratch(docs.sparkSession, "langid")
    rows = scratch.table(rows, "sample")
    table = rows.mapInArrow(count, schema).groupBy("lang", "held", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, grams, n = np.array(table.column("lang").to_pylist(), object), table.column("gram").to_numpy().view(U), table.column("n").to_numpy()
    counts = {}
    for x in sorted(set(lang)):
        own = lang == x
        g, back = np.unique(grams[own], return_inverse=True)
        counts[x] = (g, np.bincount(back, n[own]).astype(np.int64))
    model = Model(counts)
    calibrate(model, rows, counts, table, lang, grams, n, target)
    scratch.drop("sample")
    return model


def tail_limit(values: np.ndarray, target: float) -> float:
    """What a share ``target`` of such values exceeds, by an exponential tail beyond their upper tenth."""
    u = np.quantile(values, 0.9)
    over = values[values > u] - u
    return float(u + (over.mean() if len(over) else 0.0) * max(0.0, np.log(0.1 / target)))


def best_scale(h: np.ndarray, counts: np.ndarray, right: np.ndarray) -> float:
    """The scale of scores with the least log loss, of steps of a fifth; errors are given a share of one in the number of documents."""
    n, at = len(h), np.arange(len(h))
    gap = (h - h.min(axis=1)[:, None]) * np.sqrt(counts)[:, None]
    loss = []
    scales = 1.2 ** np.arange(-20, 30)
    for s in scales:
        p = np.exp(np.maximum(-gap * s, -700))
        p = p[at, right] / p.sum(axis=1)
        loss.append(-np.log((p * (n - 1) + 1 / h.shape[1]) / n).sum())
    return float(scales[int(np.argmin(loss))])


def calibrate(model: Model, rows: DataFrame, counts: dict, table, lang, grams, n, target: float) -> None:
    """Limits of rejection and the scale of scores, from a model that has not seen the held documents."""
    if not model.languages:
        return
    held = table.column("held").to_numpy(zero_copy_only=False)
    part = {}
    for x in model.languages:
        own = (lang == x) & ~held
        g, back = np.unique(grams[own], return_inverse=True)
        part[x] = (g, np.bincount(back, n[own]).astype(np.int64)) if own.any() else counts[x]
    blind = Model(part)
    at = {x: i for i, x in enumerate(model.languages)}

    def measure(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in blocks(texts):
                h, size = blind.entropies(texts[i:j])
                own = np.flatnonzero([x in at and n > 0 for x, n in zip(langs[i:j], size)])
                yield pa.RecordBatch.from_arrays([pa.array([langs[i + k] for k in own], pa.string()), pa.array(size[own]), pa.array([h[k].tobytes() for k in own], pa.binary())], names=["lang", "size", "h"])

    # a tenth of the bounded sample: a number for each language and document
    found = rows.where("held").select("lang", "text").mapInArrow(measure, "lang string, size long, h binary").toArrow()
    if not found.num_rows:
        return
    right, size = np.array([at[x] for x in found.column("lang").to_pylist()]), found.column("size").to_numpy()
    h = np.stack([np.frombuffer(x) for x in found.column("h").to_pylist()])
    model.scale = best_scale(h, size, right)
    own = h[np.arange(len(h)), right]
    whole = size >= SHORT
    if not whole.any():
        return
    middle = np.array([np.median(own[whole & (right == i)]) if (whole & (right == i)).any() else np.nan for i in range(len(at))])
    middle = np.where(np.isnan(middle), np.nanmax(middle), middle)
    model.middle = middle
    model.slack = max(0.0, tail_limit((own[whole] / middle[right[whole]] - 1) * np.sqrt(np.minimum(size[whole], LONG)), target))


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, cross_entropy (nats per symbol) and rejected.

    A null text or one without a letter is 'und', with score 0, and rejected. Without training data
    all texts are. Ties go to the language first by name. Other columns pass through; columns with
    the names of the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        pred, score, h, rejected = shared.value.decide(texts)
        return [pa.array(pred, pa.string()), pa.array(score), pa.array(h), pa.array(rejected)]

    return map_text(docs, text_col, run, FIELDS)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_text(docs, text_col, lambda texts: list(~shared.value.decide(texts)[3]))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(crc_mod("doc_id", 5) != 0))
    rows = identify(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
