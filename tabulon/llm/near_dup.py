"""N-gram Jaccard join: MinHash LSH forest, then exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, join_hot
from .graph import components
from .tokens import groups, mix, shingles, slices

TRIES, DEPTH = 16, 8


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    a = mix(np.arange(1, TRIES * DEPTH + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return (a | np.uint64(1))[:, None], mix(a + np.uint64(7))[:, None]


_A, _B = _seeds()


def signature(found: np.ndarray) -> np.ndarray:
    """16 bits of the least of each of TRIES * DEPTH permutations of the shingle hashes."""
    least = np.full(len(_A), np.uint64(2**64 - 1))
    for at in range(0, len(found), 4096):
        least = np.minimum(least, (found[None, at : at + 4096] * _A + _B).min(axis=1))
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def shared_prefix(threshold: float, depth: int) -> float:
    """The chance that two sets of this similarity share a prefix of this length in some trie."""
    return 1 - (1 - threshold**depth) ** TRIES


def _low(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def _profile(n: int):
    """Each text's set of shingles: a digest, its size and its signature."""

    def run(batches):
        for batch in slices(batches):
            ids = batch.column(0).to_pylist()
            for at, held in groups(map(_low, batch.column(1).to_pylist())):
                c1, c2, size, sig = [], [], [], []
                for found in shingles(held, n):
                    d = xxhash.xxh3_128_digest(found.tobytes())
                    c1.append(int.from_bytes(d[:8], "big", signed=True))
                    c2.append(int.from_bytes(d[8:], "big", signed=True))
                    size.append(len(found))
                    sig.append(signature(found).astype(">u2").tobytes() if len(found) else b"")
                doc = ids[at : at + len(held)]
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(size, pa.int32()), pa.array(sig, pa.binary())], names=["rep", "c1", "c2", "size", "sig"])

    return run


#: A class as one number: its least doc_id, then 62 bits of its digest, so that numbers stand in order of the ids.
_STEP = 1 << 62


def _node(prefix: str = "") -> Column:
    low = F.shiftrightunsigned(prefix + "c1", 2).cast("decimal(19,0)")
    return (F.col(prefix + "rep").cast("decimal(20,0)") * F.lit(_STEP).cast("decimal(19,0)") + low).cast("decimal(38,0)")


def _rep(node: str) -> Column:
    return F.expr(f"({node} - pmod({node}, cast({_STEP} as decimal(38,0)))) div cast({_STEP} as decimal(38,0))")


def _agreement(sample: np.ndarray, threshold: float):
    """For pairs of a sampled signature and any other whose minima agree in `threshold` or more: how long a prefix they
    share in the best trie, and how many there are."""

    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u2").astype(np.uint16).reshape(-1, TRIES * DEPTH)
            found = np.zeros(DEPTH + 1, np.int64)
            for one in sample:
                same = sig == one
                near = same[same.sum(axis=1) >= threshold * TRIES * DEPTH]
                near = near[~near.all(axis=1)].reshape(-1, TRIES, DEPTH)
                found += np.bincount(np.minimum.accumulate(near, axis=2).sum(axis=2).max(axis=1, initial=0), minlength=DEPTH + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(DEPTH + 1, dtype=np.int32)), pa.array(found)], names=["depth", "n"])

    return run


def choose_depth(classes: DataFrame, threshold: float, recall: float, sample: int = 256, prior: int = 32) -> int:
    """How long matched prefixes have to be: shortened from the whole depth until the measured recall reaches the
    target. It is measured by brute force: `sample` signatures (those with the least hashes of their digest; a bounded
    number) against all signatures. Of the pairs that agree in `threshold` of the minima, it is the share that has a
    prefix of this length in common in some trie; `prior` more pairs at the threshold itself count by their expected
    share, so that few pairs, or only closer ones, shorten it no less than the formula for the threshold would."""
    some = classes.orderBy(F.xxhash64("c1", "c2"), "c1", "c2").limit(sample).select("sig").collect()
    read = np.frombuffer(b"".join(bytes(r["sig"]) for r in some), ">u2").astype(np.uint16).reshape(-1, TRIES * DEPTH)
    found = np.zeros(DEPTH + 1)
    for r in classes.select("sig").mapInArrow(_agreement(read, threshold), "depth int, n long").groupBy("depth").agg(F.sum("n").alias("n")).collect():
        found[r["depth"]] = r["n"]
    for depth in range(DEPTH, 1, -1):
        if found[depth:].sum() + prior * shared_prefix(threshold, depth) >= recall * (found.sum() + prior):
            return depth
    return 1


_EDGE = "kind int, part int, trie int, prefix binary, " + ", ".join(f"{side}_{c} long" for side in ("u", "v") for c in ("rep", "c1", "c2"))


def _nodes(depth: int):
    """Nodes of the sorted tries: neighbours that share their first `depth` values. Each member of a node (kind 0) comes
    with the first one in this partition; the partition's first and last entries (kinds 1 and 2) come too, as a node may
    go on in the next."""
    names = [x.split()[0] for x in _EDGE.split(", ")]

    def run(batches):
        part, head, tail, before = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            tries, keys = batch.column("trie").to_numpy(), batch.column("key").to_pylist()
            who = np.stack([batch.column(c).to_numpy() for c in ("rep", "c1", "c2")], axis=1)
            prefix = [k[: 2 * depth] for k in keys]
            value = np.frombuffer(b"".join(p.ljust(16, b"\0") for p in prefix), np.uint64).reshape(-1, 2)
            new = np.ones(len(keys), bool)
            new[1:] = (tries[1:] != tries[:-1]) | (value[1:] != value[:-1]).any(axis=1)
            if before and before[:2] == (int(tries[0]), prefix[0]):
                new[0] = False
            first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
            of = np.where(first[:, None] >= 0, who[np.maximum(first, 0)], before[2] if before else who[:1])
            last_of_run = np.append(new[1:], False)  # a node of one member here; the batch's last one may go on
            alone = new & last_of_run
            at = np.flatnonzero(~alone)
            yield _edges(names, 0, part, tries[at], [prefix[i] for i in at], who[at], of[at])
            head = head or (int(tries[0]), prefix[0], who[0])
            before = (int(tries[-1]), prefix[-1], of[-1])
            tail = (int(tries[-1]), prefix[-1], who[-1])
        for kind, (trie, own, entry) in ((1, head), (2, tail)) if head else ():
            yield _edges(names, kind, part, [trie], [own], entry[None], entry[None])

    return run


def _edges(names, kind: int, part: int, tries, prefix, u, v):
    n = len(tries)
    cols = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(np.asarray(tries, np.int32)), pa.array(prefix, pa.binary())]
    cols += [pa.array(np.ascontiguousarray(x[:, k])) for x in (u, v) for k in range(3)]
    return pa.RecordBatch.from_arrays(cols, names=names)


def forest(classes: DataFrame, depth: int) -> DataFrame:
    """(trie, prefix, u, v): members u of the nodes at `depth` of the prefix tries, each with another member v (the first
    one that its partition holds; two parts of a node in neighbouring partitions are linked by their ends). One
    range-partitioned sort of the signatures, trie by trie; a node with very many members spreads over partitions."""
    spark = classes.sparkSession
    entries = classes.select("rep", "c1", "c2", "sig", F.explode(F.sequence(F.lit(0), F.lit(TRIES - 1))).alias("trie"))
    entries = entries.select("trie", F.expr(f"substring(sig, trie * {2 * DEPTH} + 1, {2 * DEPTH})").alias("key"), "rep", "c1", "c2")
    by = ["trie", "key", "rep", "c1", "c2"]
    found = cut(entries.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_nodes(depth), _EDGE), "forest")
    ends = sorted(found.where("kind > 0").collect(), key=lambda r: (r["part"], r["kind"]))  # two rows a partition
    links, entry = [], lambda r: (r["u_rep"], r["u_c1"], r["u_c2"])
    for last, first in zip(ends[1::2], ends[2::2], strict=False):
        if (last["trie"], last["prefix"]) == (first["trie"], first["prefix"]):
            links += [(last["trie"], bytes(last["prefix"]), entry(x), entry(last)) for x in (first, last)]
    members = found.where("kind = 0").select("trie", "prefix", *(f"{side}_{c}" for side in ("u", "v") for c in ("rep", "c1")))
    if links:
        members = members.unionByName(spark.createDataFrame([(t, p, *a[:2], *b[:2]) for t, p, a, b in links], members.schema))
    return members.select("trie", "prefix", _node("u_").alias("u"), _node("v_").alias("v"))


def _sets(n: int):
    def run(batches):
        for batch in slices(batches):
            rest = batch.column_names.index("text")
            for at, held in groups(map(_low, batch.column(rest).to_pylist())):
                part = batch.slice(at, len(held))
                raw = [x.tobytes() for x in shingles(held, n)]
                halves = zip(part.column("c1").to_pylist(), part.column("c2").to_pylist(), strict=True)
                # a row that repeats the id may have another class's text
                own = pa.array([xxhash.xxh3_128_digest(x) == b"".join(c.to_bytes(8, "big", signed=True) for c in of) for x, of in zip(raw, halves, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*part.columns[:rest], pa.array(raw, pa.binary())], names=[*batch.schema.names[:rest], "found"]).filter(own)

    return run


def _intersections(rows: list[np.ndarray], cols: list[np.ndarray], step: int = 1 << 22) -> np.ndarray:
    """Sizes of the intersections of each row's set with each column's, exact: products of 0/1 matrices over the
    values that both sides hold."""
    a, b = np.concatenate(rows), np.concatenate(cols)
    shared = np.intersect1d(a, b)
    ra, rb = np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.repeat(np.arange(len(cols)), [len(x) for x in cols])
    ia, ib = np.searchsorted(shared, a), np.searchsorted(shared, b)
    ka, kb = np.flatnonzero((ia < len(shared)) & (shared[np.minimum(ia, len(shared) - 1)] == a)) if len(shared) else [], np.flatnonzero((ib < len(shared)) & (shared[np.minimum(ib, len(shared) - 1)] == b)) if len(shared) else []
    out = np.zeros((len(rows), len(cols)), np.float32)
    if not len(shared):
        return out
    ra, ia, rb, ib = ra[ka], ia[ka], rb[kb], ib[kb]
    oa, ob = np.argsort(ia, kind="stable"), np.argsort(ib, kind="stable")
    ra, ia, rb, ib = ra[oa], ia[oa], rb[ob], ib[ob]
    width = max(256, step // (len(rows) + len(cols)))
    for low in range(0, len(shared), width):
        x, y = np.zeros((len(rows), width), np.float32), np.zeros((len(cols), width), np.float32)
        sa, sb = slice(*np.searchsorted(ia, [low, low + width])), slice(*np.searchsorted(ib, [low, low + width]))
        x[ra[sa], ia[sa] - low] = 1
        y[rb[sb], ib[sb] - low] = 1
        out += x @ y.T
    return out


_LINKS = "rep long, c1 long, c2 long, links long, p_rep long, p_c1 long, p_c2 long"


def _verify(threshold: float):
    def run(key, table):
        """Links in one pair of blocks of a candidate group: for each class, how many documents it is linked to, and
        the least class of the part it falls into by these links."""
        a, b = key[1].as_py(), key[2].as_py()
        who = [table.column(c).to_numpy() for c in ("c2", "c1", "rep")]
        once = np.lexsort(who)
        who = np.stack(who[::-1], axis=1)
        new = np.ones(len(once), bool)
        new[1:] = (who[once][1:] != who[once][:-1]).any(axis=1)
        once = once[new]  # one of the rows that repeat an id
        who, copies, block = who[once], table.column("copies").to_numpy()[once].astype(np.float64), table.column("block").to_numpy()[once]
        found = [np.frombuffer(table.column("found")[i].as_py(), np.uint64) for i in once.tolist()]
        size = np.array([len(x) for x in found], np.float64)
        rows, cols = np.flatnonzero(block == a), np.flatnonzero(block == b)
        links, part = np.zeros(len(who)), np.arange(len(who))
        pairs = []
        for low in range(0, len(rows), 128):
            r = rows[low : low + 128]
            both = _intersections([found[i] for i in r], [found[i] for i in cols]) if len(cols) else np.zeros((len(r), 0))
            # Jaccard >= threshold, up to rounding
            hit = both * (1 + threshold) >= threshold * (size[r][:, None] + size[cols][None, :]) - 1e-6
            if a == b:
                hit &= r[:, None] != cols[None, :]
            links[r] += hit @ copies[cols]
            if a != b:
                links[cols] += copies[r] @ hit
            i, j = np.nonzero(hit)
            pairs.append(np.stack([r[i], cols[j]]))
        p = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), int)
        while p.shape[1]:  # least label over the links, until it is stable
            before = part.copy()
            np.minimum.at(part, p[0], part[p[1]])
            np.minimum.at(part, p[1], part[p[0]])
            part = part[part]
            if (before == part).all():
                break
        keep = links > 0
        cols = [*who[keep].T, links[keep].astype(np.int64), *who[part[keep]].T]
        return pa.table([pa.array(np.ascontiguousarray(c), pa.int64()) for c in cols], names=[x.split()[0] for x in _LINKS.split(", ")])

    return run


def _dealt(members: DataFrame, label: DataFrame, block: int) -> DataFrame:
    """(node, label, block, pairs): each class's place in its candidate group, and the pairs of blocks it has to go to.
    A group of one block has one pair; of a larger one, the blocks that some node has members in both of."""
    total = label.count()
    sizes = label.groupBy("label").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = join_hot(label, cut(sizes, "sizes"), ["label"], "n", total).select("node", "label", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    placed = cut(placed, "placed")
    one = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    near = placed.where("blocks = 1").select("node", "label", "block", one.alias("pairs"))
    if not placed.where("blocks > 1").limit(1).count():
        return near
    large = placed.where("blocks > 1").select(F.col("node").alias("u"), "label", "block")
    here = cut(members.join(large, "u").groupBy("label", "trie", "prefix", "block").agg(F.count("*").alias("n")), "spread")
    key = ["label", "trie", "prefix"]
    pairs = here.select(*key, F.col("block").alias("a")).join(here.select(*key, F.col("block").alias("b")), key).where("a <= b").select("label", "a", "b").distinct()
    ends = pairs.select("label", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"), F.struct("a", "b").alias("ab"))
    told = ends.groupBy("label", "block").agg(F.collect_list("ab").alias("pairs"))
    far = placed.where("blocks > 1").join(told, ["label", "block"])
    return near.unionByName(far.select("node", "label", "block", "pairs"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.999, block: int = 256) -> DataFrame:
    """Groups of documents whose sets of n-word shingles (words as parted by white space, A-Z lower-cased) have a Jaccard
    similarity of `threshold` or more.

    Returns one row a row of docs: doc_id, class_id (least doc_id with the same set), group_id (least doc_id of all that
    chains of links reach), n_links (documents it is linked to, copies counted).

    Method: rows with equal sets become one class. MinHash signatures of the classes are sorted as prefix tries, one for
    each of TRIES parts of DEPTH values; matched prefixes are shortened from the whole depth until the recall measured on
    these signatures reaches the target (`choose_depth`), and the nodes of the tries at that depth hold the candidates.
    Nodes with common members make candidate groups, cut into blocks of about `block` classes; each pair of blocks that a
    node spans is verified exactly, on the whole sets. Only counts and the parts found leave a task, not pairs. Equal
    copies, however many, are one class; different texts of one node are all compared, so that cost grows with the square
    of a node's different texts.

    Texts of fewer than n words are one shingle; null texts and texts without words have none and are linked to nothing.
    Rows with a null doc_id get null ids and no links. Rows that repeat an id count as copies where they have the same
    set, and otherwise as documents of their own. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    profile = cut(rows.mapInArrow(_profile(n), "rep long, c1 long, c2 long, size int, sig binary").withColumnRenamed("rep", "doc"), "profiles")
    usable = profile.where(F.col("doc").isNotNull() & (F.col("size") > 0))
    classes = cut(usable.groupBy("c1", "c2").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig")), "classes")
    members = forest(classes, choose_depth(classes, threshold, recall))
    label = cut(components(members.select("u", "v")), "groups")
    where = _dealt(members, label, block)
    chosen = cut(where.join(classes.select(_node().alias("node"), "rep", "c1", "c2", "copies"), "node").drop("node"), "chosen")
    texts = rows.where(F.length("text") > 0).join(chosen.withColumnRenamed("rep", "doc").hint("merge"), "doc").select(F.col("doc").alias("rep"), "c1", "c2", "label", "block", "copies", "pairs", "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    dealt = texts.mapInArrow(_sets(n), f"{kinds}, found binary").withColumn("ab", F.explode("pairs")).select("rep", "c1", "c2", "block", "copies", "found", "label", "ab.a", "ab.b")
    links = cut(dealt.groupBy("label", "a", "b").applyInArrow(_verify(threshold), _LINKS), "links")
    links = links.select(_node().alias("node"), _node("p_").alias("part"), "links")
    part = components(links.select(F.col("node").alias("u"), F.col("part").alias("v")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links")).join(part.select("node", _rep("label").alias("group_id")), "node", "left")
    of_class = classes.select(_node().alias("node"), "c1", "c2", "rep", "copies").join(counted, "node", "left")
    of_class = cut(of_class.select("c1", "c2", "copies", F.col("rep").alias("class_id"), F.coalesce("group_id", "rep").alias("group_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "found")
    linked = join_hot(usable.select("doc", "c1", "c2"), of_class, ["c1", "c2"], "copies", usable.count()).select(F.col("doc").alias("doc_id"), "class_id", "group_id", "n_links")
    alone = profile.where(F.col("doc").isNull() | (F.col("size") == 0)).select(F.col("doc").alias("doc_id"), F.col("doc").alias("class_id"), F.col("doc").alias("group_id"), F.lit(0).cast("long").alias("n_links"))
    discard(classes, label, chosen)
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs without those whose group has a smaller doc_id; rows without an id stay."""
    found = near_duplicates(docs, **how).where(F.col("group_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(found.hint("merge"), "doc_id", "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
