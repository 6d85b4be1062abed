"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, join_hot, join_salted, unwrapped, wrapped
from .tokens import PUNCTUATION, groups, mix, word_hashes

#: Fixed masks by the number of tokens they span: positions marked 0 are ignored. Items shorter than the longer span
#: are found by the shorter one.
MASKS = {12: ("111111110000", "111011010011", "110110101101", "101101110110", "110011011110", "100111101011"), 6: ("111100", "110110", "101011", "100111")}
SHORTEST = min(MASKS)
#: Bits of the table that tells which seeds the benchmark may have; each seed sets two.
BITS = 24


def _low(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def span_of(n: int) -> int:
    """The longest span that an item of n tokens fills; 0: none."""
    return max((s for s in MASKS if s <= n), default=0)


def seeds(h: np.ndarray, span: int, k: int) -> np.ndarray:
    """The hash under mask k of each window of `span` tokens."""
    out = np.full(max(len(h) - span + 1, 0), 16 * span + k, np.uint64)
    for at, c in enumerate(MASKS[span][k]):
        if c == "1" and len(out):
            out = (out ^ h[at : at + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return mix(out)


def _items(batches):
    """Each item's tokens and the span of its seeds."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        tokens = [word_hashes([_low(t)], PUNCTUATION)[0] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([h.tobytes() for h in tokens], pa.binary()), pa.array([span_of(len(h)) for h in tokens], pa.int32())], names=["item_id", "tokens", "span"])


def _item_seeds(batches):
    for batch in batches:
        for key, raw, span in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            h = np.frombuffer(raw, np.uint64)
            found = [seeds(h, span, k) for k in range(len(MASKS[span]))]
            place = np.concatenate([np.arange(len(s)) for s in found]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.full(len(place), key)), pa.array(place)], names=["seed", "item", "place"])


def _slots(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return s >> np.uint64(64 - BITS), (s >> np.uint64(8)) & np.uint64((1 << BITS) - 1)


def _known(seed: DataFrame) -> np.ndarray:
    """The bit table of the seeds: at most 2**BITS bits, whatever the benchmark's size; put together by the executors,
    one row a word of 64 bits."""
    high, low = F.shiftrightunsigned("seed", 64 - BITS), F.shiftrightunsigned("seed", 8).bitwiseAND(F.lit((1 << BITS) - 1))
    bit = seed.select(F.explode(F.array(high, low)).alias("at")).select((F.col("at") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
    rows = bit.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (BITS - 6), np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return np.unpackbits(words.view(np.uint8), bitorder="little").view(bool)


_MATCHED = "doc long, digest long, tokens binary, seed array<long>, at array<int>"


def _match(shared, spans: list[int]):
    """Documents with windows whose seeds the benchmark may have: their tokens, and these seeds with their places."""

    def run(batches):
        known = shared.value
        names = [x.split()[0] for x in _MATCHED.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, held in groups(map(_low, batch.column(1).to_pylist())):
                h, of, _ = word_hashes(held, PUNCTUATION)
                ends = np.searchsorted(of, np.arange(len(held) + 1))
                seed, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for span in spans:
                    for k in range(len(MASKS[span])):
                        s = seeds(h, span, k)
                        a, b = _slots(s)
                        i = np.flatnonzero(known[a])
                        i = i[known[b[i]]]
                        i = i[of[i] == of[i + span - 1]]  # windows don't cross texts
                        seed.append(s[i])
                        place.append(i)
                seed, place = np.concatenate(seed), np.concatenate(place)
                order = np.argsort(place, kind="stable")
                seed, place = seed[order], place[order]
                edges = np.searchsorted(place, ends)
                rows = [[] for _ in names]
                for i in np.flatnonzero(np.diff(edges)).tolist():
                    own = h[ends[i] : ends[i + 1]]
                    part = slice(edges[i], edges[i + 1])
                    digest = int(mix(np.array([len(own)], np.uint64) + np.bitwise_xor.reduce(mix(own + np.arange(len(own), dtype=np.uint64))))[0].view(np.int64))
                    for r, v in zip(rows, (ids[at + i], digest, own.tobytes(), seed[part].view(np.int64), (place[part] - ends[i]).astype(np.int32)), strict=True):
                        r.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=names)

    return run


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, width: int, share: float) -> tuple[int, int, int] | None:
    """(equal tokens, tokens compared, first place) where the item's token 0 lies at `shift` of the document; none if no
    window of `width` tokens (or of the whole item, if shorter) has `share` of its tokens equal."""
    low, high = max(0, shift), min(len(doc), shift + len(item))
    same = doc[low:high] == item[low - shift : high - shift]
    need = min(width, len(item))
    if len(same) < need:
        return None
    total = np.concatenate([[0], np.cumsum(same)])
    if (total[need:] - total[:-need]).max() < share * need:
        return None
    return int(total[-1]), len(same), low


_FOUND = "doc_id long, item_id long, n_equal long, n_compared long, position long"


def _verify(width: int, share: float):
    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for doc, tokens, item_id, item, shifts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc_tokens, item_tokens = np.frombuffer(tokens, np.uint64), np.frombuffer(item, np.uint64)
                found = [x for s in shifts if (x := overlap(doc_tokens, item_tokens, s, width, share))]
                if found:
                    equal, compared, low = max(found, key=lambda x: (x[0], x[1], -x[2]))
                    for o, v in zip(out, (doc, item_id, equal, compared, low), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=[x.split()[0] for x in _FOUND.split(", ")])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 16, share: float = 0.75) -> DataFrame:
    """(doc_id, item_id, n_equal, n_compared, position): documents that hold a passage of a benchmark item.

    Tokens are lower-cased runs of letters, digits and non-ASCII characters. Windows of 12 tokens (6 for items of 6 to 11)
    are hashed under fixed masks that ignore some positions, so that a hit survives substitutions there. A bit table of
    fixed size tells which hashes the benchmark may have; documents' windows that pass it are joined with the test hashes
    (both distributed; hashes that very many documents have are salted). For each item and diagonal that a hit lies on,
    the two texts are compared: the pair counts if some window of `width` tokens (or of the whole item, if shorter) has
    at least `share` of its tokens equal. n_equal and n_compared are of the whole overlap on the best diagonal, position
    is its first token in the document; ties go to the diagonal with more tokens, then to the first.

    Items under 6 tokens are no passages and match nothing. Null texts and ids on either side, and empty texts, match
    nothing. Repeated rows of a document each give their rows; repeated items are compared once each. An empty table on
    either side gives an empty result.
    """
    spark = docs.sparkSession
    tests = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = tests.mapInArrow(_items, "item_id long, tokens binary, span int").where("span > 0").dropDuplicates(["item_id", "tokens"])
    items = cut(items.withColumn("item", F.xxhash64("item_id", "tokens")), "items")
    seed = cut(items.select("item", "tokens", "span").mapInArrow(_item_seeds, "seed long, item long, place int"), "seeds")
    spans = [r["span"] for r in items.select("span").distinct().collect()]
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    if not spans:
        return spark.createDataFrame([], _FOUND)
    matched = cut(rows.mapInArrow(_match(spark.sparkContext.broadcast(_known(seed)), spans), _MATCHED), "matched")
    hits = matched.select("doc", "digest", F.explode(F.arrays_zip("seed", "at")).alias("hit")).select("doc", "digest", "hit.seed", "hit.at")
    pairs = join_salted(hits, seed, "seed").select("doc", "digest", "item", (F.col("at") - F.col("place")).alias("shift")).distinct()
    pairs = cut(pairs.groupBy("doc", "digest", "item").agg(F.collect_list("shift").alias("shifts")), "pairs")
    counts = pairs.groupBy("item").agg(F.count("*").alias("n")).join(items, "item")
    told = join_hot(pairs, cut(counts, "asked"), ["item"], "n", pairs.count())
    both = matched.select("doc", "digest", "tokens").join(told.select("doc", "digest", "item_id", F.col("tokens").alias("own"), "shifts").hint("merge"), ["doc", "digest"])
    found = cut(both.select("doc", "tokens", "item_id", "own", "shifts").mapInArrow(_verify(width, share), _FOUND), "overlaps")
    discard(items, seed, matched, pairs)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the contaminated ones; rows without an id, which can't be told apart, are compared one by one under
    ids of their own and go or stay by their own text."""
    numbered = docs.where(F.col("doc_id").isNull())
    bad = contaminated(docs, benchmark, **how).select("doc_id").distinct()
    known = docs.where(F.col("doc_id").isNotNull()).join(bad.hint("merge"), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    texts = numbered.select(F.xxhash64("text").alias("doc_id"), "text").where(F.col("text").isNotNull()).dropDuplicates(["doc_id"])
    gone = contaminated(texts, benchmark, **how).select("doc_id").distinct()
    own = wrapped(numbered, F.coalesce(F.xxhash64("text"), F.lit(0)).alias("doc_id")).join(gone.hint("merge"), "doc_id", "left_anti")
    return known.unionByName(own.select(*unwrapped(docs.columns)))


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs.select("doc_id", "text"), items.select("item_id", "text"))
