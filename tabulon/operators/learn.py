"""Scoring and learning: sparse logistic models, nearest neighbours, decisions, lessons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import sigmoid
from ..storage import cut

# Prior weights of the price model's features.
PRIOR = {
    "bias": -0.6, "kw:price": 3.0, "kw:code": -2.6, "kw:row": -3.0, "kw:qty": -2.6, "kw:date": -2.6, "kw:phone": -3.0,
    "grp:yes": 1.3, "grp:no": -1.3, "digits:1-3": -1.8, "digits:4-6": 0.3, "digits:7-9": 0.6, "digits:10+": -1.4,
    "tz:3+": 0.9, "tz:0": -0.5, "attached": -4.0, "yearlike": -1.2, "dec": -0.3, "col_code_like": -2.2, "col_seq": -4.0,
    "len_outlier": -0.6, "colgrp:hi": 0.8, "colgrp:lo": -0.4, "cur_adj": 1.5, "row_phone": -2.0, "unit_adj": -3.5,
}


def score(features: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """MA6, ML2: sum of prior and learnt weights of each row's features (array f), and its sigmoid. Features are summed
    on the map side after the join; an unknown feature weighs 0."""
    one = features.select(*keys, F.explode_outer("f").alias("feature"))
    z = one.join(weights, "feature", "left").groupBy(*keys).agg(F.coalesce(F.sum(F.col("prior") + F.col("w")), F.lit(0.0)).alias("z"))
    return z.withColumn("p", sigmoid(F.col("z")))


def fit_weights(lists: list[list[str]], labels: np.ndarray, prior: dict[str, float], epochs: int, rate: float, l2: float, limit: float, seed: int) -> pd.DataFrame:
    """AdaGrad on the logistic loss, a row a sample, over weights that are offsets of the priors; each feature is a
    number, and a sample the array of its features' numbers (each once). Offsets are kept within the limit; those that
    come to nothing (under 1e-6) are 0 and don't come back."""
    names, number = np.unique(np.concatenate([np.unique(x) for x in lists] or [np.zeros(0, str)]).astype(str), return_inverse=True)
    ends = np.cumsum([len(set(x)) for x in lists])
    rows = np.split(number, ends[:-1]) if lists else []
    base = np.array([prior.get(n, 0.0) for n in names])
    offset, squares = np.zeros(len(names)), np.zeros(len(names))
    order = np.random.default_rng(seed)
    for i in np.concatenate([order.permutation(len(rows)) for _ in range(epochs)]) if rows else ():
        at = rows[i]
        z = (base[at] + offset[at]).sum()
        slope = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i] + l2 * offset[at]
        squares[at] += slope * slope
        moved = offset[at] - rate * slope / (np.sqrt(squares[at]) + 1e-8)
        offset[at] = np.where(np.abs(moved) < 1e-6, 0, np.clip(moved, -limit, limit))
    found = np.flatnonzero(offset)
    return pd.DataFrame({"feature": names[found], "prior": base[found], "w": offset[found], "g2": squares[found]})


def _train(prior: dict[str, float], epochs: int, rate: float, l2: float, limit: float, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        found = fit_weights([list(f) for f in pdf.f], pdf.y.to_numpy(float), prior, epochs, rate, l2, limit, seed)
        return found.assign(model=pdf.model.iloc[0])[["model", "feature", "prior", "w", "g2"]]

    return run


def train(samples: DataFrame, prior: dict[str, float] | None = None, epochs: int = 4, rate: float = 0.5, l2: float = 1e-4, limit: float = 12.0, seed: int = 7, keep: int = 40_000) -> DataFrame:
    """ML3, ML4: weights of each model (model, seq, f, y) by AdaGrad steps on offsets of the priors, clipped; of the
    newest `keep` samples of a model, which is the size of its memory, so a group stays small. Seeded."""
    newest = samples.withColumn("_n", F.row_number().over(Window.partitionBy("model").orderBy(F.col("seq").desc()))).where(F.col("_n") <= keep).drop("_n")
    return newest.groupBy("model").applyInPandas(_train(prior or PRIOR, epochs, rate, l2, limit, seed), "model string, feature string, prior double, w double, g2 double")


def replay(samples: DataFrame, n: int, seed: int) -> DataFrame:
    """SO6: n samples at random, the same for the same seed: by the hash of their number, not by place."""
    return samples.orderBy(F.xxhash64(F.lit(seed), "seq"), "seq").limit(n)


def dot(a: Column, b: Column) -> Column:
    """AR5."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalised(a: Column) -> Column:
    """AR4: of length 1 (a zero vector stays)."""
    n = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


#: Shapes that go to every task at once; a larger library comes in blocks of as many.
LIBRARY_BLOCK = 20_000


def nearest(queries: DataFrame, library: DataFrame, k: int = 5, block: int = LIBRARY_BLOCK) -> DataFrame:
    """SO4, ML7: the k nearest shapes (id, vec, label) of each query by Euclidean distance; ties by id. The library is
    dealt to blocks by the hash of its ids, at most about `block` shapes each; a block goes to every task, which returns
    its k best a query, and the blocks' bests are merged. So what is broadcast at once doesn't grow with the library."""
    spark = queries.sparkSession
    blocks = -(-library.count() // block) or 1
    schema = "id long, rank int, near long, label int, d double"

    def search(held):
        def run(batches):
            ids, vecs, labels = held.value
            square = (vecs**2).sum(axis=1)
            for pdf in batches:
                rows = []
                for at in range(0, len(pdf), 256):
                    part = pdf.iloc[at : at + 256]
                    q = np.stack(part.vec.to_numpy()).astype(float)
                    d = np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] + square - 2 * q @ vecs.T, 0))
                    d[part.id.to_numpy()[:, None] == ids[None, :]] = np.inf
                    for i, row in zip(part.id, d, strict=True):
                        near = np.lexsort((ids, row))[:k]
                        rows += [(i, n + 1, ids[j], labels[j], row[j]) for n, j in enumerate(near) if np.isfinite(row[j])]
                yield pd.DataFrame(rows, columns=["id", "rank", "near", "label", "d"])

        return run

    out = None
    for n in range(blocks):
        lib = library.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).select("id", "vec", "label").orderBy("id").toPandas()
        held = spark.sparkContext.broadcast((lib.id.to_numpy(), np.stack(lib.vec.to_numpy()).astype(float) if len(lib) else np.zeros((0, 1)), lib.label.to_numpy()))
        if len(lib) or blocks == 1:
            found = queries.select("id", "vec").mapInPandas(search(held), schema)
            found = found if blocks == 1 else cut(found, "nearest")
            out = found if out is None else out.unionByName(found)
    if blocks == 1:
        return out
    w = Window.partitionBy("id").orderBy("d", "near")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vote(near: DataFrame, scale: float = 1.0) -> DataFrame:
    """ML7: label with the most weight 1/(0.05+d); read if the next has 60 % of it at most and the nearest lies within
    0.6, sure within 0.35 (in units of `scale`)."""
    w = near.groupBy("id", "label").agg(F.sum(1 / (0.05 + F.col("d") / scale)).alias("weight"), F.min("d").alias("d"))
    rank = Window.partitionBy("id").orderBy(F.col("weight").desc(), "label")
    w = w.withColumn("_k", F.row_number().over(rank)).withColumn("next", F.coalesce(F.lead("weight").over(rank), F.lit(0.0))).withColumn("least", F.min("d").over(Window.partitionBy("id")))
    read = (F.col("next") <= 0.6 * F.col("weight")) & (F.col("least") <= 0.6 * scale)
    return w.where("_k = 1").select("id", "label", "weight", "next", "least", read.alias("read"), (read & (F.col("least") <= 0.35 * scale)).alias("sure"))


def decide(n: Column, picked: Column, confident: Column, known: Column, streak: Column, disagree: Column, ready: Column, mode: str = "auto") -> Column:
    """ML1: struct(source, trusted): the known format's answer where one matches, else the model's. A format is trusted
    after two checks in a row, unless the sure model contradicts it on more than 5 % of the numbers (one at least); the
    model if it is sure and has proved itself. `teacher` trusts neither, `local` whatever picks something."""
    by_format = (streak >= 2) & (disagree <= F.greatest(F.lit(1.0), 0.05 * n)) & (picked > 0)
    by_model = confident & (picked > 0) & ready
    trusted = F.when(known, by_format).otherwise(by_model)
    if mode == "teacher":
        trusted = F.lit(False)
    elif mode == "local":
        trusted = trusted | (picked > 0) | (n == 0)
    return F.struct(F.when(known, "format").otherwise("model").alias("source"), trusted.alias("trusted"))


def learn_template(lessons: DataFrame, templates: DataFrame) -> DataFrame:
    """ML6, ML10, ML11: templates (template, streak, checks, agree, updated) after lessons (template, seq, ok): the streak
    is the true ones since the last false one, carried on from before if all are true."""
    w = Window.partitionBy("template").orderBy("seq")
    later_false = F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(w.rowsBetween(0, Window.unboundedFollowing))
    got = lessons.withColumn("_f", later_false).groupBy("template").agg(F.count("*").alias("_c"), F.count_if("ok").alias("_a"), F.count_if(F.col("_f") == 0).alias("_s"), F.max("seq").alias("_u"))
    j = templates.join(got, "template", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(
        "template",
        F.when(F.col("_c").isNull(), F.col("streak")).when(F.col("_a") == F.col("_c"), zero("streak") + F.col("_s")).otherwise(F.col("_s")).alias("streak"),
        (zero("checks") + zero("_c")).alias("checks"), (zero("agree") + zero("_a")).alias("agree"), F.greatest("updated", "_u").alias("updated"),
    )
