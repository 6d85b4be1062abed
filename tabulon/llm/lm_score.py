"""LM scoring: the marginal likelihood of a lattice of subword pieces."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_back, id_of, partitions, remainder
from .tokens import mix, runs, word_hashes

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
_P = 0x9E3779B97F4A7C15
#: Frequent words of more bytes aren't summed by themselves, so that the list of these stays small.
LONGEST_HOT = 256


def read_pieces(path: str = VOCABULARY) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (a word's start is a space) and their log weights. The vocabulary's scores are ranks, not
    logarithms of probabilities; a piece starts at 1 / (rank + 30). All 256 single bytes are pieces, so that every word has a segmentation."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    score = {bytes([b]): 1e-7 for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i):
            continue
        piece = model.id_to_piece(i)
        raw = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode().lower()
        if b" " in raw[1:]:
            continue
        score[raw] = score.get(raw, 0) + (1e-6 if model.is_byte(i) else 1 / (30 + max(0.0, -model.get_score(i))))
    pieces = sorted(score)
    w = np.array([score[p] for p in pieces])
    return pieces, np.log(w / w.sum())


class Lattice:
    """All segmentations of words into pieces, for many words of one length at once."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.pieces, self.logp, self.most = pieces, logp, max(map(len, pieces))
        n = self.most + 1
        h = np.zeros(len(pieces), np.uint64)
        for i, p in enumerate(pieces):
            v = 0
            for k, b in enumerate(p):
                v = (v + (b + 1) * pow(_P, k, 1 << 64)) & (2**64 - 1)
            h[i] = v
        self.hash, self.bits = mix(h), 20
        assert len(np.unique(self.hash)) == len(h) and n
        self.slots = [np.full(1 << self.bits, -1, np.int32) for _ in range(3)]
        left = np.arange(len(h))
        for k, slot in enumerate(self.slots):
            at = self._slot(self.hash[left], k)
            slot[at[::-1]] = left[::-1]
            left = left[slot[at] != left]
        assert not len(left)

    def _slot(self, h, k):
        return ((h >> np.uint64(3 + 20 * k)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece with this hash, or -1."""
        h = mix(h)
        out = np.full(h.shape, -1, np.int32)
        for k, slot in enumerate(self.slots):
            i = slot[self._slot(h, k)]
            out = np.where((i >= 0) & (self.hash[i] == h), i, out)
        return out

    def arcs(self, x: np.ndarray) -> list[np.ndarray]:
        """For each end j = 1..L the pieces x[:, j-l:j], l = 1..min(j, most), in columns."""
        n, length = x.shape
        power = np.full(length, _P, np.uint64)
        power[:1] = 1
        power = np.multiply.accumulate(power)
        inverse = np.full(length, pow(_P, -1, 1 << 64), np.uint64)
        inverse[:1] = 1
        inverse = np.multiply.accumulate(inverse)
        total = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power, axis=1, dtype=np.uint64)], axis=1)
        out = []
        for j in range(1, length + 1):
            low = max(0, j - self.most)
            h = (total[:, j : j + 1] - total[:, low:j]) * inverse[low:j]
            out.append(self.find(h[:, ::-1]))
        return out

    def forward(self, arcs: list[np.ndarray]) -> np.ndarray:
        """Log-space forward recursion: alpha[:, j] is the log probability of all segmentations of the first j bytes."""
        n = len(arcs[0])
        alpha = np.full((n, len(arcs) + 1), -np.inf)
        alpha[:, 0] = 0
        for j, arc in enumerate(arcs, 1):
            z = np.where(arc >= 0, self.logp[arc], -np.inf) + alpha[:, j - arc.shape[1] : j][:, ::-1]
            top = z.max(axis=1)
            alpha[:, j] = top + np.log(np.exp(z - top[:, None]).sum(axis=1))
        return alpha

    @staticmethod
    def by_length(words: list[bytes], most: int = 1 << 15):
        """Numbers of words and their bytes (with the space before), equal lengths together."""
        length = np.array([len(w) + 1 for w in words])
        order = np.argsort(length, kind="stable")
        ends = np.flatnonzero(np.diff(length[order], append=0))
        low = 0
        for end in ends + 1:
            step = max(1, most // int(length[order[low]]))
            for at in range(low, end, step):
                pick = order[at : min(at + step, end)]
                yield pick, np.frombuffer(b"".join(b" " + words[i] for i in pick), np.uint8).reshape(len(pick), -1)
            low = end

    def marginal(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's probability, summed over all segmentations."""
        out = np.zeros(len(words))
        for pick, x in self.by_length(words):
            out[pick] = self.forward(self.arcs(x))[:, -1]
        return out

    def expected(self, words: list[bytes], times: np.ndarray | None = None) -> np.ndarray:
        """How often each piece is used, in expectation over the segmentations, each word once or as often as `times` says."""
        used = np.zeros(len(self.pieces))
        times = np.ones(len(words)) if times is None else times
        for pick, x in self.by_length(words):
            arcs = self.arcs(x)
            alpha = self.forward(arcs)
            beta = np.full_like(alpha, -np.inf)
            beta[:, -1] = 0
            for j in range(len(arcs), 0, -1):
                arc = arcs[j - 1]
                back = np.where(arc >= 0, self.logp[arc], -np.inf) + beta[:, j : j + 1]
                low = j - arc.shape[1]
                post = np.exp(alpha[:, low:j][:, ::-1] + back - alpha[:, -1:]) * times[pick][:, None]
                used += np.bincount(arc[arc >= 0], post[arc >= 0], len(used))
                beta[:, low:j] = np.logaddexp(beta[:, low:j], back[:, ::-1])
        return used


def _low(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def _frequent(part: int):
    """Words that hold 1/part or more of a run of texts, with their counts there; the empty word counts the bytes."""

    def run(batches):
        for (texts,) in runs(batches, ["text"], 1 << 20):
            word, n = [], []
            held = [_low(t) for t in texts]
            h, _, start = word_hashes(held)
            data = b"\n".join(held)
            if len(h):
                _, at, count = np.unique(h, return_index=True, return_counts=True)
                for i, c in zip(at[count * part >= len(h)], count[count * part >= len(h)], strict=True):
                    found = _word_at(data, start[i])
                    if len(found) <= LONGEST_HOT:  # a longer one goes to its bucket like any other
                        word.append(found)
                        n.append(int(c))
            word.append(b"")
            n.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])

    return run


_RUN = "run string, bucket int, words binary, times binary, doc binary, train binary, tokens binary, pd binary, pw binary, pn binary"


def _words_of(blob: bytes) -> list[bytes]:
    return blob.split(b" ") if blob else []


def _word_at(data: bytes, at: int) -> bytes:
    word = data[at : at + 64].split(None, 1)[0]
    return word if len(word) < 64 else data[at:].split(None, 1)[0]


def _runs_of(buckets: int, hot: list[bytes]):
    """Texts in runs. For each bucket of word hashes a row with the run's distinct words there and how often its training
    texts have each; and one row (bucket -1) with the run's documents and (document, word, count) triples, in which words
    are numbered in order of their buckets, frequent words first."""
    names = [x.split()[0] for x in _RUN.split(", ")]
    kinds = [pa.string(), pa.int32()] + [pa.binary()] * 8

    def run(batches):
        hot_hash = word_hashes(list(hot))[0] if hot else np.zeros(0, np.uint64)
        rank = np.argsort(hot_hash)
        for ids, trains, texts in runs(batches, ["doc", "train", "text"], 2 << 20):
            held = [_low(t) for t in texts]
            train = np.array(trains).astype(np.uint8)
            h, of, start = word_hashes(held)
            data = b"\n".join(held)
            tokens = np.bincount(of, minlength=len(held)).astype(np.int64)
            distinct, at, number = np.unique(h, return_index=True, return_inverse=True)
            size = max(len(distinct), 1)
            pair, count = np.unique(of.astype(np.int64) * size + number, return_counts=True)
            pd, pw = pair // size, pair % size
            bucket = ((distinct >> np.uint64(11)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            place = np.zeros(len(distinct), np.int64)
            place[order] = np.arange(len(distinct)) + len(hot)
            if len(hot):
                near = np.minimum(np.searchsorted(hot_hash[rank], distinct), len(hot) - 1)
                is_hot = hot_hash[rank][near] == distinct
                place[is_hot] = rank[near[is_hot]]
                order = order[~is_hot[order]]
                place[order] = np.arange(len(order)) + len(hot)
            learnt = np.bincount(place[pw], count * train[pd], len(hot) + len(order)).astype(np.uint32)
            name = uuid.uuid4().hex
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            cols = [[] for _ in names]
            for k in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[k] : edges[k + 1]]
                text = b" ".join(_word_at(data, i) for i in start[at[own]].tolist())
                row = (name, k, text, learnt[len(hot) + edges[k] : len(hot) + edges[k + 1]].tobytes())
                for c, v in zip(cols, row + (None,) * 6, strict=True):
                    c.append(v)
            whole = [np.array(ids, np.int64), train, tokens, pd.astype(np.uint32), place[pw].astype(np.uint32), count.astype(np.uint32)]
            for c, v in zip(cols, (name, -1, b"", learnt[: len(hot)].tobytes(), *(x.tobytes() for x in whole)), strict=True):
                c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


_BUCKET = "bucket int, words binary, c binary, run array<string>, idx array<binary>"


def _merge(key, table):
    """One row a bucket: its distinct words, how often training texts have each, and where each run's words stand."""
    number: dict[bytes, int] = {}
    names, places, times = table.column("run").to_pylist(), [], []
    for i in range(table.num_rows):
        words = _words_of(table.column("words")[i].as_py())
        places.append(np.array([number.setdefault(w, len(number)) for w in words], np.uint32))
        times.append(np.frombuffer(table.column("times")[i].as_py(), np.uint32))
    c = np.zeros(len(number), np.int64)
    for p, n in zip(places, times, strict=True):
        c[p] += n  # a run has each word once
    row = [[key[0].as_py()], [b" ".join(number)], [c.tobytes()], [names], [[p.tobytes() for p in places]]]
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.binary())]
    return pa.table([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in _BUCKET.split(", ")])


def _stats(batches):
    """Totals of the words' counts, of the frequent words', and of training documents."""
    for batch in batches:
        k, v = [], []
        for i in range(batch.num_rows):
            r = {n: batch.column(n)[i].as_py() for n in ("bucket", "c", "train")}
            c = np.frombuffer(r["c"], np.int64 if r["bucket"] >= 0 else np.uint32)
            if r["bucket"] < 0:
                k += [f"h{j}" for j in np.flatnonzero(c)] + ["docs"]
                v += [*c[c > 0].tolist(), int(np.frombuffer(r["train"], np.uint8).sum())]
            else:
                k += ["total", "distinct"]
                v += [int(c.sum()), int((c > 0).sum())]
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(v, pa.int64())], names=["k", "v"])


def _expect(shared):
    def run(batches):
        lattice = Lattice(*shared.value)
        for batch in batches:
            used = np.zeros(len(lattice.pieces))
            for i in range(batch.num_rows):
                c = np.frombuffer(batch.column("c")[i].as_py(), np.int64)
                words = [w for w, n in zip(_words_of(batch.column("words")[i].as_py()), c, strict=True) if n]
                if words:
                    used += lattice.expected(words, c[c > 0])
            at = np.flatnonzero(used)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(used[at], pa.float64())], names=["piece", "used"])

    return run


def _value(lattice: Lattice, words: list[bytes], end: float) -> np.ndarray:
    """log10 probability of each word where one token in 1 / `end` is a document's end."""
    return (lattice.marginal(words) + math.log1p(-end)) / math.log(10) if words else np.zeros(0)


def _tell(shared, end: float):
    """For each run of a bucket the counts and probabilities of its words there."""

    def run(batches):
        lattice = Lattice(*shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                c = np.frombuffer(batch.column("c")[i].as_py(), np.int64)
                value = _value(lattice, _words_of(batch.column("words")[i].as_py()), end)
                names, places = batch.column("run")[i], batch.column("idx")[i]
                for low in range(0, len(names), 64):
                    part = [np.frombuffer(places[j].as_py(), np.uint32) for j in range(low, min(low + 64, len(names)))]
                    cols = [pa.array([names[low + j].as_py() for j in range(len(part))], pa.string()), pa.array([batch.column("bucket")[i].as_py()] * len(part), pa.int32())]
                    cols += [pa.array([c[p].astype(np.uint32).tobytes() for p in part], pa.binary()), pa.array([value[p].tobytes() for p in part], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["run", "bucket", "c", "value"])

    return run


_SCORES = "doc long, n_tokens long, n_known long, base double, score double"


def _sum(hot_c: np.ndarray, hot_value: np.ndarray, n_docs: int, end: float):
    def run(key, texts, told):
        """Each document's sums over its words and its end."""
        order = np.argsort(told.column("bucket").to_numpy(), kind="stable").tolist()
        c = np.concatenate([hot_c.astype(np.float64), *(np.frombuffer(told.column("c")[i].as_py(), np.uint32) for i in order)])
        value = np.concatenate([hot_value, *(np.frombuffer(told.column("value")[i].as_py(), np.float64) for i in order)])
        base, known = np.log10(c + 0.5), c > 0
        out = []
        for i in range(texts.num_rows):
            read = {k: np.frombuffer(texts.column(k)[i].as_py(), t) for k, t in (("doc", np.int64), ("tokens", np.int64), ("pd", np.uint32), ("pw", np.uint32), ("pn", np.uint32))}
            size, times = len(read["doc"]), read["pn"].astype(float)
            sums = [np.bincount(read["pd"], times * v[read["pw"]], size) if len(times) else np.zeros(size) for v in (base, value, known)]
            cols = [read["doc"], read["tokens"] + 1, np.rint(sums[2]).astype(np.int64) + (n_docs > 0), sums[0] + math.log10(n_docs + 0.5), sums[1] + math.log10(end)]
            out.append(pa.table([pa.array(x) for x in cols], names=[x.split()[0] for x in _SCORES.split(", ")]))
        if not out:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=[x.split()[0] for x in _SCORES.split(", ")])
        return pa.concat_tables(out)

    return run


def score_texts(docs: DataFrame, train, pieces: tuple[list[bytes], np.ndarray], rounds: int = 2, bucket_bytes: int = 16 << 20, n_hot: int = 1000) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of docs; `train` is the condition of the
    rows to learn from.

    Tokens are words (A-Z lower-cased, white space between) and one end. Training words are counted over all training
    texts, by buckets of word hashes; the vocabulary's piece weights are then fitted to all training words, as often as
    they come, by `rounds` steps of expectation maximisation over all segmentations; without training words they stay. A
    word's probability, seen or not, is the lattice's marginal; the end's is its share of the training tokens, which is
    also what it gets as one more piece of the lattice that follows a whole word.

    Texts lie in runs of 2 MB, written once. Runs send their distinct words to the buckets and get back each word's count
    and probability; documents' own counts stay in their runs, so what moves follows the input whatever the number of
    buckets, and a frequent word goes to its bucket once a run. The most frequent words (at most n_hot) are summed by
    themselves.

    Null texts are empty, having only the end. Rows that repeat an id get a row each; a null doc_id stays null.
    """
    spark = docs.sparkSession
    rows = docs.select(id_of().alias("doc"), train.alias("train"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seen = rows.select("text").mapInArrow(_frequent(2000), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    seen = seen.orderBy((F.length("word") > 0), F.col("n").desc(), "word").limit(n_hot + 1).collect()
    size = sum(r["n"] for r in seen if not r["word"])
    hot = sorted(bytes(r["word"]) for r in seen if r["word"])
    buckets = max(-(-size // bucket_bytes), min(6, partitions(spark)))
    held = cut(rows.mapInArrow(_runs_of(buckets, hot), _RUN), "runs")
    words = held.where("bucket >= 0").select("run", "bucket", "words", "times")
    merged = cut(words.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_merge, _BUCKET), "buckets")
    counted = merged.select("bucket", "c", F.lit(None).cast("binary").alias("train")).unionByName(held.where("bucket < 0").select("bucket", F.col("times").alias("c"), "train"))
    stats = {r["k"]: r["v"] for r in counted.mapInArrow(_stats, "k string, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    hot_c = np.array([stats.get(f"h{i}", 0) for i in range(len(hot))], np.int64)
    n_docs = stats.get("docs", 0)
    n = int(stats.get("total", 0) + hot_c.sum() + n_docs)
    distinct = int(stats.get("distinct", 0) + (hot_c > 0).sum() + (n_docs > 0))
    end = (n_docs + 0.5) / (n + 1)
    names, logp = pieces
    for _ in range(rounds):
        used = merged.select("words", "c").mapInArrow(_expect(spark.sparkContext.broadcast((names, logp))), "piece int, used double")
        lattice, own = Lattice(names, logp), np.flatnonzero(hot_c)
        count = lattice.expected([hot[i] for i in own], hot_c[own]) if len(own) else np.zeros(len(names))
        for r in used.groupBy("piece").agg(F.sum("used").alias("u")).collect():  # at most one row a piece
            count[r["piece"]] += r["u"]
        if not count.any():
            break
        count += 1e-3
        logp = np.log(count / count.sum())
    shared = spark.sparkContext.broadcast((names, logp))
    told = merged.mapInArrow(_tell(shared, end), "run string, bucket int, c binary, value binary")
    value = _value(Lattice(names, logp), hot, end)
    texts = held.where("bucket < 0").select("run", "doc", "tokens", "pd", "pw", "pn")
    out = texts.groupBy("run").cogroup(told.groupBy("run")).applyInArrow(_sum(hot_c, value, n_docs, end), _SCORES)
    base = F.col("base") - F.col("n_tokens") * F.lit(math.log10(n + 0.5 * (distinct + 1)))
    return out.select(id_back("doc").alias("doc_id"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def query(spark, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_texts(docs, remainder(F.col("doc_id"), 5) != 1, read_pieces(vocabulary))
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
