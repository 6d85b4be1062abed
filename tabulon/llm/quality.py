"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import balanced_sample, cut, id_of, remainder, unwrapped, wrapped

CHUNK, HOP = 256, 192
EMBED, WIDTH, STRIDE, FILTERS = 6, 8, 2, 48
PAD = 0


def chunks(data: bytes) -> np.ndarray:
    """Overlapping chunks that cover the whole text; the last is filled up with zero bytes."""
    n = max(0, -(-(len(data) - CHUNK) // HOP)) + 1
    held = np.zeros((n - 1) * HOP + CHUNK, np.uint8)
    held[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(held, (n, CHUNK), (HOP, 1))


class Net:
    """Bytes are embedded; filters of WIDTH bytes slide by STRIDE over each chunk, are rectified and max-pooled. Mean and
    maximum of the chunks' values are combined into one logit."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embed = (r.standard_normal((256, EMBED)) * 0.5).astype(np.float32)
        self.filters = (r.standard_normal((WIDTH * EMBED, FILTERS)) / np.sqrt(WIDTH * EMBED)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.out = (r.standard_normal(2 * FILTERS) * 0.05).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def parts(self):
        return [self.embed, self.filters, self.shift, self.out, self.bias]

    def windows(self, x: np.ndarray) -> np.ndarray:
        e = np.ascontiguousarray(self.embed[x].reshape(len(x), -1))
        n = (CHUNK - WIDTH) // STRIDE + 1
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (len(x), n, WIDTH * EMBED), (s[0], STRIDE * EMBED * 4, 4))

    def pooled(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), FILTERS), np.float32)
        for at in range(0, len(x), 64):
            w = self.windows(x[at : at + 64])
            out[at : at + 64] = (w.reshape(-1, WIDTH * EMBED) @ self.filters).reshape(len(w), -1, FILTERS).max(axis=1)
        return np.maximum(out + self.shift, 0)

    def logits(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """x: chunks of several texts; first: the number of each text's first chunk."""
        h = self.pooled(x)
        n = np.diff(np.append(first, len(x)))
        both = np.concatenate([np.add.reduceat(h, first) / n[:, None], np.maximum.reduceat(h, first)], axis=1)
        return both @ self.out + self.bias[0]

    def gradients(self, x, first, y, weight):
        at, h = np.empty((len(x), FILTERS), np.int64), np.empty((len(x), FILTERS), np.float32)
        blocks = [slice(low, low + 128) for low in range(0, len(x), 128)]  # a long text's windows don't fit at once
        for k in blocks:
            w = self.windows(x[k])
            z = (w.reshape(-1, WIDTH * EMBED) @ self.filters).reshape(len(w), -1, FILTERS)
            at[k] = z.argmax(axis=1)
            h[k] = np.maximum(np.take_along_axis(z, at[k][:, None], 1)[:, 0] + self.shift, 0)
        n = np.diff(np.append(first, len(x)))
        of = np.repeat(np.arange(len(first)), n)
        top = np.maximum.reduceat(h, first)
        both = np.concatenate([np.add.reduceat(h, first) / n[:, None], top], axis=1)
        g = ((1 / (1 + np.exp(-np.clip(both @ self.out + self.bias[0], -30, 30))) - y) * weight / len(y)).astype(np.float32)
        d_both = g[:, None] * self.out
        best = h == top[of]
        ties = np.add.reduceat(best.astype(np.float32), first)
        d = d_both[of, :FILTERS] / n[of, None] + d_both[of, FILTERS:] * best / ties[of]
        d = d * (h > 0)
        d_filters, d_embed = np.zeros_like(self.filters), np.zeros_like(self.embed)
        for k in blocks:
            w = self.windows(x[k])
            rows = w[np.arange(len(w))[:, None], at[k]]  # chunk, filter, window
            d_filters += np.einsum("cf,cfk->kf", d[k], rows, optimize=True)
            d_rows = (d[k][:, :, None] * self.filters.T[None]).reshape(len(w), FILTERS, WIDTH, EMBED)
            places = at[k][:, :, None] * STRIDE + np.arange(WIDTH)
            np.add.at(d_embed, x[k][np.arange(len(w))[:, None, None], places].ravel(), d_rows.reshape(-1, EMBED))
        return [d_embed, d_filters, d.sum(axis=0), both.T @ g, g.sum(keepdims=True)]


def batch_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    held = [chunks(t) for t in texts]
    return np.concatenate(held), np.concatenate([[0], np.cumsum([len(c) for c in held])[:-1]]).astype(int)


def train(texts: list[bytes], y: np.ndarray, epochs: int = 8, size: int = 32, rate: float = 4e-3, seed: int = 7) -> Net:
    """Adam on the logistic loss, both classes weighing the same; each step sees all chunks of its texts."""
    net, r = Net(seed), np.random.default_rng(seed)
    m, v = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)).astype(np.float32)
    step, steps = 0, epochs * -(-len(texts) // size)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for at in range(0, len(order), size):
            pick = order[at : at + size]
            x, first = batch_of([texts[i] for i in pick])
            step += 1
            now = rate * (1 - step / (steps + 1))
            for p, g, a, b in zip(net.parts(), net.gradients(x, first, y[pick], weight[pick]), m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    return net


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4000) -> Net | float:
    """Learns from labelled rows (doc_id, quality): at most max_rows documents, half of each class, in order of their
    ids' hash, and of each the whole text (max_rows bounds the fit alone; scores are of all rows). Without labelled rows of both classes, a constant score comes back."""
    ids = cut(balanced_sample(labels, "quality", max_rows), "sample")
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(id_of().alias("doc"), F.col("text").cast("string").alias("text"))
    found = rows.join(F.broadcast(ids), "doc").select("doc", "y", F.col("text").cast("binary").alias("b")).collect()  # max_rows rows at most
    found = sorted((r["doc"], r["y"], bytes(r["b"])) for r in found)
    y = np.array([r[1] for r in found], np.float32)
    if len(y) == 0 or y.min() == y.max():
        return float(y[0]) if len(y) else 0.5
    return train([r[2] for r in found], y)


def _scores(net, width: int):
    def run(batches):
        for batch in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(width).to_pylist()]
            if isinstance(net, float):
                score = [net] * len(texts)
            else:
                score, held, size = [], [], 0
                for i, t in enumerate(texts):
                    held.append(t)
                    size += len(t)
                    if size > 100_000 or i == len(texts) - 1:
                        z = net.logits(*batch_of(held))
                        score += (1 / (1 + np.exp(-np.clip(z.astype(float), -500, 500)))).tolist()
                        held, size = [], 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(score, pa.float64())], names=[*batch.schema.names[:width], "score"])

    return run


def score(docs: DataFrame, net: Net | float) -> DataFrame:
    """Adds `score`, the probability of label 1 by the whole text (null: empty), and `predicted` (1 at 0.5 or more).
    Columns of docs with these names are replaced. Every row gets a score of its text alone, so rows that repeat a text
    tie; an empty table gives an empty one."""
    docs = docs.drop("score", "predicted")
    rows = wrapped(docs, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    out = rows.mapInArrow(_scores(net, 1), StructType([rows.schema["_row"], StructField("score", DoubleType())]))
    return out.select(*unwrapped(docs.columns), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    net = fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality").where(remainder(F.col("doc_id"), 3) != 1))
    out = score(docs.select("doc_id", "text"), net)
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
