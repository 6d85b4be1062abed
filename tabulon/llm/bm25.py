"""Exact top-k search by BM25: an inverted index with block-max WAND pruning in each shard, merged exactly."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, scratch_path
from .tokens import PUNCTUATION, groups, runs, word_hashes

K1, B = 1.2, 0.75
#: Documents in a block that shares one maximum a term.
BLOCK = 8
#: Terms that one document in so many of a shard has, or more, are frequent there: their lists are read by block maxima.
FREQUENT = 8
#: One shard in so many is searched first and gives every query its first threshold.
WAVES = 16
#: Bounds are kept in single precision; this share of a threshold is left as margin.
MARGIN = 1e-4
#: Rare terms that together are worth no more than this share of a threshold are left to the scoring.
REST = 0.01


def _low(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def _counted(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term hash, times) of each distinct term of each text, in this order."""
    h, of, _ = word_hashes(held, PUNCTUATION)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    edge = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])) if len(h) else np.zeros(0, np.int64)
    return of[edge], h[edge], np.diff(np.append(edge, len(h)))


def _least_kind(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32)


def _numbers(raw: bytes, n: int) -> np.ndarray:
    """n numbers in the width that _least_kind chose."""
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32)


_SHARD = "pick int, words long, docs binary, size binary, known binary, df binary, post binary, times binary"


def _build(most: int):
    """Texts in shards of about `most` characters, each one row: postings by term, in an order of the documents that
    puts like ones (the same commonest word, then about the same length) next to each other."""

    def run(batches):
        for ids, held in runs(batches, ["doc", "text"], most, 64):
            low = [_low(t) for t in held]
            parts = [(of + at, h, n) for at, some in groups(low) for of, h, n in [_counted(some)]]
            of, h, times = (np.concatenate(x) for x in zip(*parts, strict=True))
            size = np.bincount(of, times, len(low)).astype(np.int64)
            known, term, df = np.unique(h, return_inverse=True, return_counts=True)
            if not len(known):
                continue
            common = np.argsort(-df, kind="stable")[:64]
            rank = np.zeros(len(known), np.int64)
            rank[common] = np.arange(1, len(common) + 1)
            top = np.zeros(len(low), np.int64)
            has = rank[term] > 0
            by = np.lexsort((times[has], of[has]))
            top[of[has][by]] = rank[term[has][by]]  # the last one written is the commonest in the text
            order = np.lexsort((np.arange(len(low)), size, top))
            order = order[size[order] > 0]
            place = np.zeros(len(low), np.int64)
            place[order] = np.arange(len(order))
            often = np.argsort(-df, kind="stable")  # terms in order of their frequency, so that common ones lie together
            number = np.empty(len(often), np.int64)
            number[often] = np.arange(len(often))
            known, df = known[often], df[often]
            by = np.argsort(number[term] * len(order) + place[of])
            docs = np.array(ids, np.int64)[order]
            cols = [docs, _least_kind(size[order]), known, _least_kind(df), _least_kind(place[of][by]), _least_kind(times[by])]
            pick = zlib.crc32(np.sort(docs).tobytes()) >> 1
            row = [pa.array([pick], pa.int32()), pa.array([int(size.sum())], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in cols)]
            yield pa.RecordBatch.from_arrays(row, names=[x.split()[0] for x in _SHARD.split(", ")])

    return run


def _frequencies(batches):
    """How many of a shard's documents have each term."""
    for batch in batches:
        for known, df in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = np.frombuffer(known, np.int64)
            df = _numbers(df, len(h)).astype(np.int64)
            for at in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(h[at : at + (1 << 16)]), pa.array(df[at : at + (1 << 16)])], names=["h", "df"])


def _asked(batches):
    """Each query's distinct terms, and a digest of them."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for at, held in groups(map(_low, batch.column(1).to_pylist())):
            of, h, _ = _counted(held)
            ends = np.searchsorted(of, np.arange(len(held) + 1))
            terms = [h[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            digest = [xxhash.xxh3_128_digest(x) for x in terms]
            yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + len(held)], pa.int64()), pa.array(terms, pa.binary()), pa.array(digest, pa.binary())], names=["query", "terms", "digest"])


def _terms(batches):
    """(block, term) of each batch's queries, each once."""
    for batch in batches:
        block, lists = batch.column(0).to_numpy(), [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        for k in np.unique(block):
            h = np.unique(np.concatenate([x for x, b in zip(lists, block, strict=True) if b == k] or [np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int32)), pa.array(h)], names=["block", "h"])


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (size[0] numbers), start[1], ..."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


class Shard:
    """Postings by term and by document, for one dictionary of terms with idf. Rare terms have lists of (document, score
    part); frequent ones a dense table of their parts, and of its maxima in blocks of documents. A part is idf times
    (k1+1) tf / (tf + k1 (1 - b + b size / mean size))."""

    def __init__(self, row: dict, mean: float, h: np.ndarray, idf: np.ndarray):
        self.docs, known = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["known"], np.uint64)
        n = len(self.docs)
        size, df = _numbers(row["size"], n), _numbers(row["df"], len(known)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(df)])
        total = int(self.first[-1])
        post, times = _numbers(row["post"], total), _numbers(row["times"], total).astype(np.float64)
        # the dictionary's terms here, and the idf of this shard's terms (0: not asked for)
        by_hash = np.argsort(known)
        at = by_hash[np.minimum(np.searchsorted(known, h, sorter=by_hash), len(known) - 1)]
        self.number = np.where(known[at] == h, at, -1)
        weigh = np.zeros(len(known))
        weigh[at[self.number >= 0]] = idf[self.number >= 0]
        length = K1 * (1 - B + B * size.astype(np.float64) / mean)
        part = times * (K1 + 1) / (times + length[post]) * np.repeat(weigh, df)
        by = np.argsort(post, kind="stable")
        self.term = np.repeat(np.arange(len(known), dtype=np.int32), df)[by]
        self.own = part[by]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(post, minlength=n))])
        self.df = df
        # a posting as one number, its place and its part in single precision, so that lists are read in one piece
        pair = np.empty((total, 2), np.int32)
        pair[:, 0], pair[:, 1] = post, part.astype(np.float32).view(np.int32)
        self.pair = pair.view(np.int64).ravel()
        self.most = np.maximum.reduceat(part, self.first[:-1])
        self.blocks = -(-n // BLOCK)
        self.frequent = int(np.searchsorted(-df, -n / FREQUENT, "right"))  # terms stand by their frequency
        end = int(self.first[self.frequent])
        self.dense = np.zeros((self.blocks * BLOCK, self.frequent), np.float32)
        self.dense[post[:end], np.repeat(np.arange(self.frequent), df[: self.frequent])] = part[:end]
        self.maxima = np.ascontiguousarray(self.dense.reshape(self.blocks, BLOCK, -1).max(axis=1).T) if n else np.zeros((self.frequent, 0), np.float32)
        self.asked = np.zeros(len(known), bool)
        self.read = self.whole = self.scored = 0  # postings read, those of all terms asked for, documents scored

    def scores(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Exact scores: sums over the documents' own terms of the parts of those asked for, the smallest first, so that
        documents with equal parts get equal scores in whatever shard."""
        if not len(docs):
            return np.zeros(0)
        self.asked[terms] = True
        size = self.at[docs + 1] - self.at[docs]
        i = _spans(self.at[docs], size)
        some = self.asked[self.term[i]]
        self.asked[terms] = False
        of, part = np.repeat(np.arange(len(docs)), size)[some], self.own[i[some]]
        order = np.lexsort((part, of))
        self.scored += len(docs)
        return np.bincount(of[order], part[order], len(docs))

    def top(self, lists: list[np.ndarray], k: int, least: np.ndarray):
        """For each list of terms (numbers of this shard's) the (places, scores) of the documents that are among the k best
        and reach `least`; ties at the end all come.

        Frequent terms count by their maxima in blocks of documents: one product of the queries with the maxima gives each
        block's bound for a batch of queries. Rare terms stand in order of their bounds; their postings are read up to the
        pivot, from which on the rest is worth next to nothing, and count by that bound. A block none of whose documents
        can reach the threshold by these bounds is skipped; of the others, documents that still can are scored, best bound
        first, which raises the threshold: with their own parts of the frequent terms, then, if still in reach, in full."""
        for low in range(0, len(lists), 256):
            batch = lists[low : low + 256]
            asked = np.zeros((len(batch), self.frequent), np.float32)
            for i, t in enumerate(batch):
                asked[i, t[t < self.frequent]] = 1
            bounds = asked @ self.maxima
            for i, t in enumerate(batch):
                yield self._top(t, k, float(least[low + i]), asked[i], bounds[i])

    def _top(self, t: np.ndarray, k: int, least: float, asked: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.docs)
        rare = t[t >= self.frequent]
        rare = rare[np.argsort(-self.most[rare], kind="stable")]
        rest = np.append(np.cumsum(self.most[rare][::-1])[::-1], 0.0)
        pivot = int(np.searchsorted(-rest, -REST * least, "left")) if least else len(rare)
        reached = np.zeros(self.blocks * BLOCK)
        if pivot:
            a, b = self.first[rare[:pivot]].tolist(), self.first[rare[:pivot] + 1].tolist()
            read = np.concatenate([self.pair[x:y] for x, y in zip(a, b, strict=True)]).view(np.int32)
            reached = np.bincount(read[::2], read.view(np.float32)[1::2], self.blocks * BLOCK)
            self.read += len(read) // 2
        self.whole += int(self.df[t].sum())
        upto = reached.reshape(self.blocks, BLOCK) + (bound + rest[pivot])[:, None]
        if not least:  # the first shard of all: a threshold from the documents with the best bounds
            some = np.argpartition(upto.ravel()[:n], -4 * k)[-4 * k :] if n > 4 * k else np.arange(n)
            score = self.scores(some, t)
            least = float(np.partition(score, -k)[-k]) if len(some) >= k else 0.0
        found = np.flatnonzero(upto >= max(least * (1 - MARGIN), 1e-300))
        found = found[found < n]
        got, score = np.zeros(0, np.int64), np.zeros(0)
        found = found[np.argsort(-upto.ravel()[found], kind="stable")] if len(found) > 8 * k else found
        for low, high in ((0, 8 * k), (8 * k, len(found))):
            part = found[low:high]
            part = part[upto.ravel()[part] >= least * (1 - MARGIN)]
            if not len(part):
                continue
            near = reached[part] + self.dense[part] @ asked + rest[pivot]
            part = part[near >= least * (1 - MARGIN)]
            if len(part) > k and not rest[pivot]:  # these are nearly the scores: what lies clearly behind the k-th goes
                near = near[near >= least * (1 - MARGIN)]
                part = part[near >= np.partition(near, -k)[-k] * (1 - MARGIN)]
            got, score = np.concatenate([got, part]), np.concatenate([score, self.scores(part, t)])
            if len(got) >= k:
                least = max(least, float(np.partition(score, -k)[-k]))
            stay = (score >= least) & (score > 0)
            got, score = got[stay], score[stay]
        return got, score


class Block:
    """Some queries: their terms with idf, each once, and each query's terms as numbers of these."""

    def __init__(self, keys: list[tuple[int, bytes]], lists: list[np.ndarray], h: np.ndarray, idf: np.ndarray):
        self.keys = keys
        wanted = np.unique(np.concatenate(lists))
        own = np.isin(h, wanted)
        self.h, self.idf = h[own], idf[own]
        order = np.argsort(self.h)
        self.h, self.idf = self.h[order], self.idf[order]
        self.lists = []
        for x in lists:  # terms that no document has go
            i = np.searchsorted(self.h, x)
            i = i[self.h[np.minimum(i, len(self.h) - 1)] == x] if len(self.h) else i[:0]
            self.lists.append(i.astype(np.int32))
        self.least = np.zeros(len(keys))


def _search(shared, k: int, mean: float):
    """The k best of a task's shards for each query, each shard starting from the threshold of those before it."""

    def run(batches):
        block = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(block.keys)
        least = block.least.copy()
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard({name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}, mean, block.h, block.idf)
                lists = [t[t >= 0] for t in (shard.number[own] for own in block.lists)]
                for q, (found, score) in enumerate(shard.top(lists, k, least)):
                    if len(found):
                        docs, score = np.concatenate([best[q][0], shard.docs[found]]), np.concatenate([best[q][1], score])
                        order = np.lexsort((docs, -score))[:k]
                        best[q] = docs[order], score[order]
                        if len(order) == k:
                            least[q] = max(least[q], float(score[order[-1]]))
        n = [len(d) for d, _ in best]
        cols = [pa.array(np.repeat(np.array([key[0] for key in block.keys], np.int64), n)), pa.array([key[1] for key, m in zip(block.keys, n, strict=True) for _ in range(m)], pa.binary())]
        cols += [pa.array(np.concatenate([d for d, _ in best])), pa.array(np.concatenate([s for _, s in best]))]
        yield pa.RecordBatch.from_arrays(cols, names=["query", "digest", "doc", "score"])

    return run


def _blocks(asked: DataFrame, idf: DataFrame, n: int, most: int):
    """Blocks of queries of at most `most` bytes of terms; a larger query is a block of its own."""
    for k in range(n):
        told = idf.where(F.col("block") == k).select("h", "idf").toArrow()
        h, weight = told.column("h").to_numpy().view(np.uint64), told.column("idf").to_numpy()
        keys, lists, size = [], [], 0
        for r in asked.where(F.col("block") == k).select("query", "digest", "terms").toLocalIterator():
            if size and size + len(r["terms"]) > most:
                yield Block(keys, lists, h, weight)
                keys, lists, size = [], [], 0
            keys.append((r["query"], bytes(r["digest"])))
            lists.append(np.frombuffer(bytes(r["terms"]), np.uint64))
            size += len(r["terms"])
        if keys:
            yield Block(keys, lists, h, weight)


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, shard_chars: int = 32 << 20, block_bytes: int = 8 << 20) -> DataFrame:
    """(query_id, rank, doc_id, score): for each row of queries (query_id, text) the k documents with the highest BM25
    score (k1 1.2, b 0.75, idf ln(1 + (N - df + 0.5) / (df + 0.5)), each distinct query term once) among those with a
    common term; ties by smaller doc_id.

    Terms are lower-cased runs of letters, digits and non-ASCII characters; N, mean size and df are of all documents.
    The documents of a partition make shards of about shard_chars characters, each an inverted index of about half its
    text's size, written once. Queries go to the tasks in blocks of at most block_bytes of terms, block after block; a
    task takes each block through its shards by block-max WAND (`Shard.top`), the threshold going on from shard to
    shard, and returns at most k rows a query. One shard in WAVES is searched first: a query's k-th best score there is
    the threshold that all other tasks start from, so what tasks return together doesn't grow with their number.
    Weights don't depend on the shard, so neither do the scores, and the merge is exact.

    Rows with null ids are left out on both sides; null or empty texts have no terms: they find nothing and aren't
    found. Rows that repeat a doc_id are documents of their own. Rows that repeat a query_id with the same terms are one
    query, with other terms another query with ranks of its own. Without documents or queries the result is empty.
    """
    spark = docs.sparkSession
    take = lambda df, i: df.where(F.col(i).isNotNull()).select(F.col(i).cast("long").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    taken = take(docs, "doc_id")
    index = cut(taken.mapInArrow(_build(shard_chars), _SHARD), "index")
    lists = take(queries, "query_id").mapInArrow(_asked, "query long, terms binary, digest binary").where(F.length("terms") > 0)
    lists = cut(lists.dropDuplicates(["query", "digest"]), "asked")
    n, (words, first) = taken.count(), index.agg(F.sum("words"), F.min("pick")).first()
    first = max(first or 0, 2**31 // WAVES)  # shards up to here are searched first: at least one
    mean = max((words or 0) / max(n, 1), 1e-9)
    size = lists.agg(F.sum(F.length("terms"))).first()[0] or 0
    n_blocks = -(-size // block_bytes)
    path = scratch_path(spark, "blocks")
    lists.withColumn("block", F.pmod(F.xxhash64("query", "digest"), F.lit(max(n_blocks, 1))).cast("int")).repartition("block").write.partitionBy("block").parquet(path)
    asked = spark.read.schema("query long, terms binary, digest binary, block int").parquet(path)
    df = index.select("known", "df").mapInArrow(_frequencies, "h long, df long").groupBy("h").agg(F.sum("df").alias("df"))
    wanted = asked.select("block", "terms").mapInArrow(_terms, "block int, h long").distinct()
    idf = wanted.join(df.hint("merge"), "h").select("block", "h", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    idf = cut(idf.repartition("block").sortWithinPartitions("block"), "idf")
    schema, out = "query long, digest binary, doc long, score double", scratch_path(spark, "found")
    shards = index.drop("words")

    def search(block: Block, some: Column, at: str) -> str:
        shared = spark.sparkContext.broadcast(block)
        shards.where(some).drop("pick").mapInArrow(_search(shared, k, mean), schema).write.parquet(at)
        shared.destroy()
        return at

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("query", "digest").orderBy(F.col("score").desc(), "doc"))).where(F.col("rank") <= k)

    for i, block in enumerate(_blocks(asked, idf, n_blocks, block_bytes)):
        at = search(block, F.col("pick") <= first, f"{out}/part={i}-0")
        known = best(spark.read.schema(schema).parquet(at)).where(F.col("rank") == k).select("query", "digest", "score").collect()  # one row a query of the block
        number = {key: j for j, key in enumerate(block.keys)}
        for r in known:
            block.least[number[r["query"], bytes(r["digest"])]] = r["score"]
        search(block, F.col("pick") > first, f"{out}/part={i}-1")
    discard(index, lists, idf, path)
    if not n_blocks:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    found = best(spark.read.schema(schema).parquet(out))
    return found.select(F.col("query").alias("query_id"), "rank", F.col("doc").alias("doc_id"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return top_k(docs, docs.where(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "text"))
