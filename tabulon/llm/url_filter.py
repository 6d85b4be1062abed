"""URL filters: host and path rules, and logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, unwrapped, wrapped

#: (verdict, rule); a rule is a host, then a path that starts with /.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: Labelled URLs (1: block) that the model learns from.
LABELLED = (
    ("https://en.encyclopedia.example/wiki/Stone_bridge", 0), ("https://news.daily.example/en/2021/05/story.html", 0),
    ("http://www.library.example.net/en/catalogue/88", 0), ("https://blog.garden.example.com/en/roses.html", 0),
    ("https://docs.compiler.example.org/de/manual/", 0), ("https://m.weather.example.net/fr/1402", 0),
    ("https://www.museum.example.com/es/salas/3", 0), ("http://blog.kitchen.example.net/en/bread?page=2", 0),
    ("https://university.example.edu/courses/history/", 0), ("https://forum.cycling.example.com/en/thread/512", 0),
    ("https://www.journal.example.org/fr/article/77.html", 0), ("https://m.recipes.example.com/de/suppe", 0),
    ("https://science.example.net/en/physics/9017", 0), ("http://archive.example.org/en/letters/1890/", 0),
    ("https://blog.travel.example.net/es/montes#top", 0), ("https://www.council.example.gov/en/minutes/12", 0),
    ("https://health.example.org/en/nutrition/401", 0), ("https://m.theatre.example.com/fr/programme", 0),
    ("https://wiki.sailing.example.net/de/knoten", 0), ("https://www.school.example.com/en/lessons/6.html", 0),
    ("http://poetry.example.org/es/poemas/31", 0), ("https://maps.example.net/en/rivers/204", 0),
    ("https://blog.tools.example.com/en/987?utm_source=feed", 0), ("https://m.birds.example.org/en/finch/3/", 0),
    ("https://ads.network.example.net/en/click?id=8", 1), ("https://ads-track.example.com/en/1187", 1),
    ("http://ads-track.example.net/fr/20", 1), ("https://track.clicks.example.com/redirect?to=shop", 1),
    ("https://casino-bonus.example.net/en/free-spins", 1), ("http://bet365win.example.com/en/jackpot/1", 1),
    ("https://cheap-pills.example.net/en/buy-now", 1), ("https://xxx-adult.example.com/video/412", 1),
    ("http://free-download-crack.example.net/keygen.exe", 1), ("https://banner-ads.example.org/en/pop/9", 1),
    ("https://popunder-ads.example.com/de/7", 1), ("https://spam-offers.example.net/en/win-prize", 1),
    ("http://adserver.example.com/track/pixel.gif", 1), ("https://poker-casino.example.org/es/bono", 1),
    ("https://viagra-cheap.example.com/fr/acheter", 1), ("http://porn-tube.example.net/en/55", 1),
    ("https://ads-click.example.com/es/3311", 1), ("https://tracker-ads.example.net/en/beacon?u=1", 1),
    ("https://win-lottery-prize.example.com/claim", 1), ("http://replica-watches-sale.example.net/en/buy", 1),
    ("https://adult-dating-xxx.example.org/join", 1), ("https://spam-link-farm.example.com/en/page/9", 1),
    ("http://ads-track.example.org/de/640", 1), ("https://payday-loan-fast.example.net/apply", 1),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ://."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    start = F.locate("://", u)
    rest = F.when(start > 0, F.substring(u, start + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. A policy's rules are given as a list and become one
    expression: suffixes of the host at its dots are looked up in a map of rules."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        at = rule.index("/")
        by_host.setdefault(rule[:at].translate(str.maketrans(UPPER, LOWER)), []).append((rule[at:], rule, verdict))
    if not by_host:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    labels = F.split(host, r"\.", -1)
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    table = F.create_map(*(x for h, found in by_host.items() for x in (F.lit(h), F.array(*(F.struct(F.lit(p).alias("path"), F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for p, r, v in found)))))
    found = F.flatten(F.transform(tails, lambda t: F.coalesce(table[t], F.array().cast("array<struct<path:string,rule:string,verdict:string>>"))))
    fits = F.filter(found, lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def _features(values: list[bytes], owner: np.ndarray, salt: int, dims: int, sizes=(3, 4, 5)) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every n-gram of the bytes values[i], of row owner[i]."""
    data = np.frombuffer(b"".join(b"^" + v + b"$" for v in values), np.uint8).astype(np.uint64)
    ends = np.cumsum([len(v) + 2 for v in values])
    row = np.repeat(np.arange(len(values)), np.diff(ends, prepend=0))
    rows, found = [], []
    for n in sizes:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, salt * 1000 + n, np.uint64)
        for k in range(n):
            h = (h ^ data[k : len(data) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        whole = row[: len(h)] == row[n - 1 :]
        rows.append(owner[row[: len(h)][whole]])
        found.append((h[whole] >> np.uint64(17)) % np.uint64(dims))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(rows or none).astype(np.int64), np.concatenate(found or none).astype(np.int64)


def url_features(hosts, paths, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Presence of the n-grams of hosts and of paths, in spaces of their own; each (row, feature) once."""
    owner = np.arange(len(hosts))
    a = _features([h.encode("utf-8", "surrogatepass") for h in hosts], owner, 1, dims)
    b = _features([p.encode("utf-8", "surrogatepass") for p in paths], owner, 2, dims)
    pair = np.unique(np.concatenate([a[0], b[0]]) * (2 * dims) + np.concatenate([a[1], b[1] + dims]))
    return pair // (2 * dims), pair % (2 * dims)


def fit(labelled, dims: int = 4096, rounds: int = 400, rate: float = 0.5, l2: float = 2e-3) -> tuple[np.ndarray, float]:
    """Weights and bias from (host, path, label) rows, by gradient descent; each row's features weigh 1/sqrt(count)."""
    y = np.array([x[2] for x in labelled], float)
    row, col = url_features([x[0] for x in labelled], [x[1] for x in labelled], dims)
    scale = 1 / np.sqrt(np.bincount(row, minlength=len(y)).clip(1))
    w, b = np.zeros(2 * dims), 0.0
    for _ in range(rounds):
        z = np.bincount(row, w[col] * scale[row], len(y)) + b
        g = 1 / (1 + np.exp(-z)) - y
        w -= rate * (np.bincount(col, g[row] * scale[row], 2 * dims) / len(y) * 8 + l2 * w)
        b -= rate * g.mean()
    return w, b


def scorer(w: np.ndarray, b: float):
    dims = len(w) // 2

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(host), 2000):
            h, p = host.iloc[at : at + 2000].tolist(), path.iloc[at : at + 2000].tolist()
            row, col = url_features(h, p, dims)
            n = np.bincount(row, minlength=len(h)).clip(1)
            z = np.bincount(row, w[col], len(h)) / np.sqrt(n) + b
            out.append(1 / (1 + np.exp(-z)))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELLED), "url string, label int")


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, url: str = "url", max_labelled: int = 10_000, dims: int = 4096) -> DataFrame:
    """Adds `host`, `path`, `rule`, `verdict` and `score` (the model's probability that the URL is to be blocked).

    The longest rule that fits decides; where none fits, the model does (block at 0.5 or more). The model is fitted on
    the labelled table (url, label; 1: block), at most `max_labelled` rows of it in order of their hash; rows with a null
    url or label aren't used, and with none left every score is 0.5 less a hair, so the verdict is allow. A null url, or
    one without ://, has an empty host and path. Rules of one length that both fit are the same rule; where a policy
    lists it with both verdicts, block wins. Rows that repeat a url get the same verdict; an empty table gives an empty
    one. Columns of pages with the added names are replaced; other names can't clash.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "score")
    host, path = split_url(F.col("url"))
    rows = labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull()).select(host.alias("h"), path.alias("p"), F.col("label").cast("int"))
    sample = rows.orderBy(F.xxhash64("h", "p"), "h", "p", "label").limit(max_labelled).collect()
    w, b = fit([tuple(r) for r in sample], dims) if sample else (np.zeros(2 * dims), -1e-9)
    host, path = split_url(F.col(url))
    out = wrapped(pages, host.alias("host"), path.alias("path"))
    out = out.withColumn("score", scorer(w, b)("host", "path")).withColumn("found", match_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return out.select(*unwrapped(pages.columns), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, labelled_urls(spark)).select("page_id", "host", "path", "rule", "verdict", "score")
