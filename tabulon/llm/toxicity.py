"""Toxicity: a logistic classifier on words and word beginnings, regularised by swapped identity terms."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import balanced_sample, cut, discard, id_of, remainder, unwrapped, wrapped
from .tokens import groups, parts, slices

#: Identity terms; each of a row can stand for the others of its row.
IDENTITY = (
    ("women", "men", "girls", "boys"), ("woman", "man"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual"), ("immigrants", "refugees", "citizens", "tourists"), ("deaf", "blind", "disabled"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "deutsche"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("noirs", "blancs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("negros", "blancos"),
)
SWAPS = {t: tuple(x for x in group if x != t) for group in IDENTITY for t in group}
#: Bytes that are not part of words: all but letters and bytes of other characters.
APART = np.array([not (b >= 128 or chr(b).isalpha()) for b in range(256)])
PREFIXES = (4, 5, 6)


def _low(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def features(texts: list[bytes], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash), each once and in order, of every text's words and of the beginnings of longer ones; only those
    that the bit table `known` may hold, if there is one."""
    whole, at = [], []
    for first, held in groups(texts):
        h, of, _ = parts(held, APART, PREFIXES)
        if known is not None:
            keep = known[h >> np.uint64(44)]
            h, of = h[keep], of[keep]
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        whole.append(h[new])
        at.append(of[new] + first)
    return np.concatenate(at or [np.zeros(0, np.int64)]), np.concatenate(whole or [np.zeros(0, np.uint64)])


_TERM = re.compile(r"[^\W\d_]+")


def swapped(text: str) -> list[str]:
    """For each identity term in the text, the text with another term of its group for it (each other one in turn)."""
    out = []
    for term in sorted(SWAPS.keys() & set(_TERM.findall(text.lower()))):
        out += [re.sub(rf"(?i)(?<![^\W\d_]){term}(?![^\W\d_])", other, text) for other in SWAPS[term]]
    return out


def _examples(batches):
    """Each labelled text's features; for each swap in it the features that go and those that come."""
    names = ["y", "own", "gone", "come", "n_gone", "n_come"]
    kinds = [pa.int32(), *[pa.binary()] * 5]
    for batch in slices(batches):
        rows = []
        for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own = features([_low(text)])[1]
            others = [features([_low(x)])[1] for x in swapped(text)]
            gone, come = [np.setdiff1d(own, h, assume_unique=True) for h in others], [np.setdiff1d(h, own, assume_unique=True) for h in others]
            join = lambda x: b"".join(h.tobytes() for h in x)
            rows.append((label, own.tobytes(), join(gone), join(come), *(np.array([len(h) for h in x], np.int32).tobytes() for x in (gone, come))))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


class Model:
    """Weights of feature hashes, and a bias."""

    def __init__(self, h: np.ndarray, weights: np.ndarray, bias: float):
        self.h, self.weights, self.bias = h, weights, bias
        self.bits = np.zeros(1 << 20, bool)
        self.bits[h >> np.uint64(44)] = True

    def scores(self, texts: list[str]) -> np.ndarray:
        """The probability of each text, summed over its features in order of their hashes."""
        z = np.full(len(texts), self.bias)
        if len(self.h):
            of, h = features([_low(t) for t in texts], self.bits)
            i = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            hit = self.h[i] == h
            z += np.bincount(of[hit], self.weights[i[hit]], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def score(self, text: str) -> float:
        return float(self.scores([text])[0])


class Sparse:
    """Rows of few entries: products with a vector from either side."""

    def __init__(self, n_rows: int, n_cols: int, row: np.ndarray, col: np.ndarray, value: np.ndarray | None = None):
        self.shape, self.row, self.col, self.value = (n_rows, n_cols), row, col, value

    def times(self, v: np.ndarray) -> np.ndarray:
        x = v[self.col] if self.value is None else v[self.col] * self.value
        return np.bincount(self.row, x, self.shape[0])

    def turned(self, u: np.ndarray) -> np.ndarray:
        x = u[self.row] if self.value is None else u[self.row] * self.value
        return np.bincount(self.col, x, self.shape[1])


def train(x: Sparse, d: Sparse, y: np.ndarray, swap_weight: float = 1.0, l1: float = 2e-4, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Logistic loss (each class weighs half), plus swap_weight times the mean squared change of the logit under each
    swap, plus L1, by accelerated proximal gradient steps. x: a row of features a text; d: for each swap its text's
    features less the swapped text's."""
    n, swaps = x.shape[1], max(d.shape[0], 1)
    cost = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    v, size = np.ones(n + 1), 1.0
    for _ in range(15):  # power iteration for the step length
        u = cost * (x.times(v[:n]) + v[n])
        v = np.append(x.turned(u) + swap_weight * 8 / swaps * d.turned(d.times(v[:n])), u.sum())
        size = float(np.linalg.norm(v)) or 1.0
        v /= size
    step = 4 / size
    w = w0 = np.zeros(n + 1)
    for k in range(rounds):
        z = w + (k / (k + 3)) * (w - w0)
        g = cost * (1 / (1 + np.exp(-np.clip(x.times(z[:n]) + z[n], -50, 50))) - y)
        grad = np.append(x.turned(g) + swap_weight * 2 / swaps * d.turned(d.times(z[:n])), g.sum())
        w0, w = w, z - step * grad
        w[:n] = np.sign(w[:n]) * np.maximum(np.abs(w[:n]) - step * l1, 0)
    return w[:n], float(w[n])


def _trained(swap_weight: float):
    """The model of all examples, in one task, as rows (hash, weight) in order of the hashes; the one without a hash is the
    bias. No examples, no rows."""

    def run(batches):
        rows = pa.Table.from_batches(held) if (held := [b for b in batches if b.num_rows]) else None
        if rows is None:
            return
        h, weights, bias = _learned(rows, swap_weight)
        names = ["hash", "weight"]
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([bias], pa.float64())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(weights, pa.float64())], names=names)

    return run


def _learned(rows: pa.Table, swap_weight: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature hashes with weights other than 0, their weights, and the bias."""
    y = rows.column("y").to_numpy().astype(float)
    if y.min() == y.max():
        return np.zeros(0, np.uint64), np.zeros(0), 20.0 if y[0] else -20.0
    own, gone, come = ([np.frombuffer(b.as_py(), np.uint64) for b in rows.column(c)] for c in ("own", "gone", "come"))
    order = sorted(range(len(y)), key=lambda i: (y[i], rows.column("own")[i].as_py()))  # whatever order they came in
    known, col = np.unique(np.concatenate([own[i] for i in order] + [come[i] for i in order]), return_inverse=True)
    n = sum(map(len, own))
    x = Sparse(len(y), len(known), np.repeat(np.arange(len(y)), [len(own[i]) for i in order]), col[:n])
    n_gone, n_come = (np.concatenate([np.frombuffer(rows.column(c)[i].as_py(), np.int32) for i in order]) for c in ("n_gone", "n_come"))
    at = np.searchsorted(known, np.concatenate([gone[i] for i in order]))
    swap = np.arange(len(n_gone))
    d = Sparse(len(swap), len(known), np.concatenate([np.repeat(swap, n_gone), np.repeat(swap, n_come)]), np.concatenate([at, col[n:]]), np.concatenate([np.ones(len(at)), -np.ones(len(col) - n)]))
    weights, bias = train(x, d, y[order], swap_weight)
    return known[weights != 0], weights[weights != 0], bias


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, swap_weight: float = 1.0) -> Model:
    """Learns from labelled rows (doc_id, toxic): at most max_rows documents, half of them of each class, in order of their
    ids' hash (the sample is this bound). Every word and beginning of the sample's whole texts is a feature; L1 sets most
    weights to 0. One task learns; only the weights come to the driver. No labelled rows: every score is 0; of one class
    only: that class."""
    ids = cut(balanced_sample(labels, "toxic", max_rows), "sample")
    sample = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(id_of().alias("doc"), F.col("text").cast("string").alias("text"))
    sample = sample.join(F.broadcast(ids), "doc").select("doc", "text", "y")  # max_rows ids at most
    rows = sample.mapInArrow(_examples, "y int, own binary, gone binary, come binary, n_gone binary, n_come binary")
    found = rows.repartition(1).mapInArrow(_trained(swap_weight), "hash long, weight double").toArrow()
    discard(ids)
    weights, bias = found.filter(found.column("hash").is_valid()), found.filter(found.column("hash").is_null())
    # copies: Arrow's buffers go
    h, w = (np.array(weights.column(c).to_numpy()) for c in ("hash", "weight"))
    return Model(h.view(np.uint64), w, float(bias.column("weight")[0].as_py()) if bias.num_rows else -20.0)


def _scores(shared, width: int):
    def run(batches):
        model = shared.value
        for batch in slices(batches):
            score = model.scores(batch.column(width).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(score, pa.float64())], names=[*batch.schema.names[:width], "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds `score`, the probability that the whole text is toxic, and `predicted` (1 at 0.5 or more). Null texts count
    as empty. Columns of docs with these names are replaced. Every row gets a score of its text alone, so rows that
    repeat a text tie; an empty table gives an empty one."""
    docs = docs.drop("score", "predicted")
    rows = wrapped(docs, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInArrow(_scores(shared, 1), StructType([rows.schema["_row"], StructField("score", DoubleType())]))
    return out.select(*unwrapped(docs.columns), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(remainder(F.col("doc_id"), 5) != 0)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    model = fit(docs, training_labels(labels.select("doc_id", "toxic")))
    return score(docs, model).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
