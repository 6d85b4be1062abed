"""Suffix-array dedup: repeated byte strings found by the difference-cover algorithm over candidate segments."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_back, id_of, partitions, scratch_table, union
from .tokens import groups, mix, slices

#: The shortest strings that can be sought, and the longest gram that minimisers are made of less than these.
SHORTEST, ROOM = 12, 34
#: Parts of a bucket, by the minimiser's hash: each is sorted by itself, in arrays that stay in the processor's cache.
PARTS = 64


def gram_of(least: int) -> int:
    """Bytes of a minimiser's gram: long, so that few grams repeat without the string around them, but short enough for
    a string to hold several, of which the least is chosen. A segment around a minimiser has at most ROOM + 1 starts."""
    if least < SHORTEST:
        raise ValueError(f"strings of at least {SHORTEST} bytes, not {least}")
    return max(8, least - ROOM)


def _sorted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of at least 0 in order, and their places. Where both fit, a number and its place are sorted as one, without
    moving places apart from numbers."""
    bits = max(len(x) - 1, 1).bit_length()
    if int(x.max(initial=0)) >> (63 - bits):
        order = np.argsort(x, kind="stable")
        return x[order], order
    both = x << bits
    both |= np.arange(len(x))
    both.sort()
    return both >> bits, both & ((1 << bits) - 1)


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of s (numbers of at least 1), in order of their first `depth` symbols at least.

    Difference cover modulo 3: the triples at places 1 and 2 modulo 3 are sorted and named; the names, in the order of
    their places, are a text of two thirds the length, which is sorted in the same way unless all names differ or
    already stand for depth symbols; the places 0 modulo 3 are sorted by their symbol and the next place's rank, and
    merged in."""
    n = len(s)
    t = np.concatenate([s, np.zeros(4, s.dtype)]).astype(np.int64)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:n].tolist()), np.int64)
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])

    def in_order(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of tuples, and the name of each."""
        top = int(max(k.max() for k in keys)) + 1
        if top ** len(keys) < 2**63:
            one = keys[0].copy()
            for k in keys[1:]:
                one = one * top + k
            value, order = _sorted(one)
            new = np.diff(value, prepend=-1) != 0
        else:
            order = np.lexsort(keys[::-1])
            new = np.ones(len(order), bool)
            new[1:] = np.logical_or.reduce([np.diff(k[order]) != 0 for k in keys])
        name = np.empty(len(order), np.int64)
        name[order] = np.cumsum(new)
        return order, name

    order, name = in_order(t[sample], t[sample + 1], t[sample + 2])
    if name.max() < len(sample) and depth > 3:
        order = suffix_array(name, -(-depth // 3))
        name = np.empty(len(order), np.int64)  # ranks: the places of the order
        name[order] = np.arange(1, len(order) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = name
    sorted12 = sample[order]
    sorted12 = sorted12[sorted12 < n]
    top, high = int(rank.max()) + 1, int(t.max()) + 1
    zeros = np.arange(0, n, 3)
    value, order = _sorted(t[zeros] * top + rank[zeros + 1])
    zeros = zeros[order]

    def place(mod: int) -> np.ndarray:
        """For each suffix of zeros, how many of sorted12 with this remainder are smaller."""
        other = sorted12[sorted12 % 3 == mod]
        if mod == 1:
            a, b = t[other] * top + rank[other + 1], value
        elif high * high * top < 2**63:
            a, b = ((t[x] * high + t[x + 1]) * top + rank[x + 2] for x in (other, zeros))
        else:
            both = np.concatenate([t[other] * high + t[other + 1], t[zeros] * high + t[zeros + 1]])
            pair = np.unique(both, return_inverse=True)[1]
            a, b = pair[: len(other)] * top + rank[other + 2], pair[len(other) :] * top + rank[zeros + 2]
        # suffixes that agree in depth symbols have no order among them; the places must still not fall
        return np.maximum.accumulate(np.searchsorted(np.maximum.accumulate(a), b, side="left"))

    out = np.full(n, -1, np.int64)
    out[np.arange(len(zeros)) + place(1) + place(2)] = zeros
    out[out < 0] = sorted12
    return out


def _eights(data: np.ndarray) -> np.ndarray:
    """Eight bytes of data as one number, from each place."""
    return np.ndarray((max(len(data) - 7, 0),), "<u8", data.tobytes() if not data.flags.c_contiguous else data, 0, (1,))


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of x[i:i+width] for every i."""
    size = 1
    while 2 * size <= width:
        x = best(x[: len(x) - size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def _segments_of(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, text number, minimiser's hash) of the segments of some texts, joined."""
    gram = gram_of(least)
    window = least - gram + 1
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), np.uint8)
    n, none = len(data) - least + 1, np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, np.zeros(0, np.uint64)
    view, n_grams = _eights(data), len(data) - gram + 1
    h = np.zeros(n_grams, np.uint64)
    for o in sorted({*range(0, gram - 7, 8), gram - 8}):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + view[o : o + n_grams])
    least_of = _slide(h, window, np.minimum)
    # the grams that are the least of some window; each window's is the first of these that it holds with its value
    pad = np.zeros(window - 1, np.uint64)
    is_chosen = _slide(np.concatenate([pad, least_of, pad]), window, np.maximum) == h
    chosen = np.flatnonzero(is_chosen)
    value = h[chosen]
    at = (np.cumsum(is_chosen, dtype=np.int32) - is_chosen)[:n]  # of each place, the first of these from there on
    wrong = np.flatnonzero(value[at] != least_of)
    while len(wrong):
        at[wrong] += 1
        wrong = wrong[value[at[wrong]] != least_of[wrong]]
    long = size >= least
    inside = np.zeros(n + 1, np.int8)  # starts of strings that end in their text
    np.add.at(inside, start[long], 1)
    np.add.at(inside, np.minimum(start[long] + size[long] - least + 1, n), -1)
    whole = np.cumsum(inside[:n], dtype=np.int8) > 0
    edge = np.ones(n, bool)
    edge[1:] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1])
    edge[start[long]] = True
    first = np.flatnonzero(edge)
    last = np.append(first[1:], n) - 1
    kept = whole[first]
    first, last = first[kept], last[kept]
    return first, last + least, np.searchsorted(start, first, "right") - 1, value[at[first]]


class Run:
    """Some texts, joined, and their segments. Every string of `least` bytes inside a text has a minimiser: the first of
    its grams with the least hash, at the same place in it wherever it occurs. A segment (`low` to `high`) holds
    neighbouring strings with one minimiser, so each string lies in one segment."""

    def __init__(self, data: bytes, size: np.ndarray, least: int):
        self.least = least
        self.size = size
        self.start = np.cumsum(self.size) - self.size
        self.bytes = data
        texts = (data[a : a + n] for a, n in zip(self.start.tolist(), size.tolist(), strict=True))
        parts = []
        for at, held in groups(texts, 1 << 18):  # pieces whose arrays stay in the processor's cache
            low, high, of, h = _segments_of(held, least)
            parts.append((low + self.start[at], high + self.start[at], of + at, h))
        none = np.zeros(0, np.int64)
        self.low, self.high, self.of, self.hash = (np.concatenate(x) for x in zip(*(parts or [(none, none, none, np.zeros(0, np.uint64))]), strict=True))

    def buckets(self, n: int) -> np.ndarray:
        return ((self.hash >> np.uint64(34)) % np.uint64(n)).astype(np.int64)

    def segments(self, doc: np.ndarray, n: int, repeated: dict[int, np.ndarray], frequent: dict[int, np.ndarray]) -> Segments:
        """The distinct segments of repeated minimisers, bucket by bucket. Of frequent minimisers each string is a segment
        of its own, dealt by its own hash."""
        bucket, short = self.buckets(n), self.hash & np.uint64(0xFFFFFFFF)
        key = bucket.astype(np.uint64) << np.uint64(32) | short

        def held(told: dict[int, np.ndarray]) -> np.ndarray:
            asked = [x.astype(np.uint64) | np.uint64(k << 32) for k, x in told.items() if len(x)]
            return np.isin(key, np.concatenate(asked)) if asked else np.zeros(len(key), bool)

        often = held(frequent)
        at = np.flatnonzero(held(repeated) | often)
        number: dict[bytes, int] = {}
        own = np.empty(len(at), np.int64)
        for k in range(0, len(at), 1 << 14):  # few numbers at once are objects
            i = at[k : k + (1 << 14)]
            own[k : k + len(i)] = [number.setdefault(self.bytes[x:y], len(number)) for x, y in zip(self.low[i].tolist(), self.high[i].tolist(), strict=True)]
        text, place = self.of[at], self.low[at]
        held_by = np.full(len(number), 2**63 - 1, np.int64)
        np.minimum.at(held_by, own, doc[text])
        one = at[np.unique(own, return_index=True)[1]]
        often = often[one]
        whole = np.flatnonzero(~often)
        # strings of frequent minimisers are cut from distinct segments: copies of a text give no more of them
        distinct, strings = list(number), {}
        parted = np.flatnonzero(often)
        times = (self.high - self.low)[one][parted] - self.least + 1
        string = np.empty(times.sum(), np.int64)
        k = 0
        for j, n_strings in zip(parted.tolist(), times.tolist(), strict=True):
            x = distinct[j]
            string[k : k + n_strings] = [strings.setdefault(x[p : p + self.least], len(strings)) for p in range(n_strings)]
            k += n_strings
        h = np.fromiter((xxhash.xxh64_intdigest(x) for x in strings), np.uint64, len(strings))
        least = np.full(len(strings), 2**63 - 1, np.int64)
        np.minimum.at(least, string, np.repeat(held_by[parted], times))
        bucket = np.concatenate([bucket[one[whole]], (h // np.uint64(PARTS) % np.uint64(n)).astype(np.int64)])
        part = np.concatenate([self.hash[one[whole]], h]) % np.uint64(PARTS)
        order = np.lexsort((part, bucket))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        piece = [distinct[j] for j in whole.tolist()] + list(strings)
        short = np.concatenate([short[one[whole]], h >> np.uint64(32)]).astype(np.uint32)
        first = np.concatenate([held_by[whole], least])
        first_place = np.cumsum(times) - times
        parts = Parts(whole, rank[: len(whole)], np.repeat(parted, times), np.arange(len(string)) - np.repeat(first_place, times), rank[len(whole) + string])
        return Segments([piece[i] for i in order.tolist()], bucket[order], part[order].astype(np.int64), short[order], first[order], (self.high - self.low)[one], held_by, parts, own, text, place)


@dataclass
class Parts:
    """Which pieces are sent for distinct segments: one for the whole segment, or one for each of its strings."""

    whole: np.ndarray
    piece: np.ndarray
    parted: np.ndarray
    string: np.ndarray
    string_piece: np.ndarray


@dataclass
class Segments:
    """Pieces to send in order of their buckets and parts (pieces, bucket, part, the minimiser's short hash, the least
    document that has it), the distinct segments (size, the least document, their pieces), and all occurrences of these
    in order (own: which segment, text, place)."""

    pieces: list[bytes]
    bucket: np.ndarray
    part: np.ndarray
    short: np.ndarray
    first: np.ndarray
    size: np.ndarray
    held_by: np.ndarray
    parts: Parts
    own: np.ndarray
    text: np.ndarray
    place: np.ndarray

    def covered(self, mask: np.ndarray) -> np.ndarray:
        """For each distinct segment a bit for each string that a document before its least one has, from the pieces'."""
        p = self.parts
        out = np.zeros(len(self.size), np.uint64)
        out[p.whole] = mask[p.piece]
        hit = (mask[p.string_piece] & np.uint64(1)).astype(bool) | (self.first[p.string_piece] < self.held_by[p.parted])
        np.bitwise_or.at(out, p.parted[hit], np.uint64(1) << p.string[hit].astype(np.uint64))
        return out


def _runs(most: int):
    """Texts in runs of about `most` bytes, each one row with a key of its own."""

    def row(docs, texts):
        doc, size, data = np.array(docs, np.int64).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), b"".join(texts)
        # the key follows from the content, so that a task that runs again gives the same; equal runs may share one
        return [xxhash.xxh3_128_hexdigest(doc + size + data)], [doc], [size], [data]

    def out(docs, texts):
        key, doc, size, data = row(docs, texts)
        return pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(doc, pa.binary()), pa.array(size, pa.binary()), pa.array(data, pa.binary())], names=["run", "doc", "size", "data"])

    def run(batches):
        docs, texts, size = [], [], 0
        for batch in slices(batches):
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if size + len(t) > most and docs:
                    yield out(docs, texts)
                    docs, texts, size = [], [], 0
                docs.append(d)
                texts.append(t)
                size += len(t)
        if docs:
            yield out(docs, texts)

    return run


def _read(r: dict, least: int) -> tuple[np.ndarray, Run]:
    return np.frombuffer(r["doc"], np.int64), Run(r["data"], np.frombuffer(r["size"], np.int64), least)


def _rows(table):
    """The rows as dicts, one after another: a run's texts are large."""
    for i in range(table.num_rows):
        yield {c: table.column(c)[i].as_py() for c in table.schema.names}


def _minimisers(least: int, n: int):
    """For each run and bucket the distinct minimisers: in one text, in more, in many."""

    def run(key, texts):
        out = []
        for r in _rows(texts):
            doc, own = _read(r, least)
            order = np.argsort(own.hash, kind="stable")  # within a hash the texts stay in order
            h, of = own.hash[order], own.of[order]
            other = np.ones(len(h), bool)
            other[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
            h, times = np.unique(h[other], return_counts=True)
            many = times > max(8, len(doc) // 32)
            bucket = ((h >> np.uint64(34)) % np.uint64(n)).astype(np.int64)
            h = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(n + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                i = order[edges[k] : edges[k + 1]]
                out.append((r["run"], k, h[i[times[i] == 1]].tobytes(), h[i[(times[i] > 1) & ~many[i]]].tobytes(), h[i[many[i]]].tobytes()))
        kinds = (pa.string(), pa.int32(), *[pa.binary()] * 3)
        return pa.table([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=["run", "bucket", "one", "more", "many"])

    return run


def _repeated(max_runs: int):
    def run(key, table):
        """Which of each run's minimisers occur in two texts at least, and which of these are frequent."""
        read = [[np.frombuffer(x, np.uint32) for x in table.column(c).to_pylist()] for c in ("one", "more", "many")]
        held = [np.concatenate(x) for x in zip(*read, strict=True)]
        ends = np.cumsum([len(x) for x in held])
        h, number, times = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        often, more = times > max_runs, times > 1
        for i, (_, y, z) in enumerate(zip(*read, strict=True)):
            often[number[ends[i] - len(z) : ends[i]]] = True
            more[number[ends[i] - len(z) - len(y) : ends[i]]] = True
        more |= often
        out = []
        for i, (name, bucket) in enumerate(zip(table.column("run").to_pylist(), table.column("bucket").to_pylist(), strict=True)):
            own = number[ends[i] - len(held[i]) : ends[i]]
            if more[own].any():
                out.append((name, bucket, held[i][more[own]].tobytes(), held[i][often[own]].tobytes()))
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=["run", "bucket", "repeated", "frequent"])

    return run


def _told(table) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
    return {r["bucket"]: np.frombuffer(r["repeated"], np.uint32) for r in rows}, {r["bucket"]: np.frombuffer(r["frequent"], np.uint32) for r in rows}


_SENT = "run string, bucket int, part binary, short binary, size binary, data binary, first binary"


def _segments(least: int, n: int):
    names = [x.split()[0] for x in _SENT.split(", ")]

    def run(key, texts, told):
        out = []
        for r in _rows(texts):
            doc, own = _read(r, least)
            s = own.segments(doc, n, *_told(told))
            edges = np.searchsorted(s.bucket, np.arange(n + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                i = slice(edges[k], edges[k + 1])
                size = np.array([len(x) for x in s.pieces[i]], np.uint16)
                out.append((r["run"], k, s.part[i].astype(np.uint8).tobytes(), s.short[i].tobytes(), size.tobytes(), b"".join(s.pieces[i]), s.first[i].tobytes()))
        return pa.table([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.string(), pa.int32(), *[pa.binary()] * 5))], names=names)

    return run


def owners(segments: list[bytes], first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a string of `least` bytes in the segments, in order: (its segment, the least of `first` among
    the segments that hold the string)."""
    size = np.array([len(x) for x in segments], np.int64)
    data = np.frombuffer(b"\0".join(segments) + b"\0" * 8, np.uint8)
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    symbols = data.astype(np.int64) + 2
    symbols[(begin + size)] = 1
    symbols[int(begin[-1] + size[-1]) :] = 1
    order = suffix_array(symbols[: int(begin[-1] + size[-1])], least)
    of = np.repeat(np.arange(len(segments)), size + 1)[: len(order)]
    keep = order + least <= (begin + size)[of[order]]
    order = order[keep]
    # adjacent prefixes: a new string wherever some byte of the first `least` differs
    new, view = np.zeros(len(order), bool), _eights(data)
    new[:1] = True
    for o in [*range(0, least - 7, 8), least - 8]:
        v = view[order + o]
        new[1:] |= v[1:] != v[:-1]
    low = np.minimum.reduceat(first[of[order]], np.flatnonzero(new)) if len(order) else np.zeros(0, np.int64)
    owner = low[np.cumsum(new) - 1]
    found = np.full(len(symbols), -1, np.int64)
    found[order] = np.arange(len(order))
    found = found[found >= 0]  # of each start, its place in the order
    return of[order[found]], owner[found]


def _cover(least: int):
    def run(key, table):
        """For each run's segments in a bucket, a bit for each string in it: whether a document before those of the run
        that hold the segment has it."""
        rows = table.to_pylist()
        number: dict[bytes, int] = {}
        read, part, short = [], [], []
        for r in rows:
            ends = np.cumsum(np.frombuffer(r["size"], np.uint16).astype(np.int64)).tolist()
            before = len(number)
            i = np.array([number.setdefault(r["data"][a:b], len(number)) for a, b in zip([0, *ends], ends, strict=False)], np.int64)
            new = np.unique(i[i >= before], return_index=True)[1]  # in the order they came
            for held, c, kind in ((part, "part", np.uint8), (short, "short", np.uint32)):
                held.append(np.frombuffer(r[c], kind)[i >= before][new])
            read.append((i, np.frombuffer(r["first"], np.int64)))
        part, short = np.concatenate(part).astype(np.int64), np.concatenate(short)
        pieces = list(number)
        first = np.full(len(pieces), 2**63 - 1, np.int64)
        for i, d in read:
            np.minimum.at(first, i, d)
        every = np.array([len(x) for x in pieces], np.int64) - least + 1
        at = np.concatenate([[0], np.cumsum(every)])
        owner = np.repeat(first, every)
        # a minimiser with one segment has no string in another; the others are sorted, part by part
        _, group, many = np.unique(short, return_inverse=True, return_counts=True)
        for k in range(PARTS):
            several = np.flatnonzero((many[group] > 1) & (part == k))
            if len(several):
                of, found = owners([pieces[i] for i in several.tolist()], first[several], least)
                place = np.repeat(at[several], every[several]) + np.arange(len(of)) - np.repeat(np.cumsum(every[several]) - every[several], every[several])
                owner[place] = found
        out = []
        for r, (i, d) in zip(rows, read, strict=True):
            n = at[i + 1] - at[i]
            starts = np.repeat(at[i] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            bit = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            earlier = owner[starts] < np.repeat(d, n)
            mask = np.zeros(len(i), np.uint64)
            np.bitwise_or.at(mask, np.repeat(np.arange(len(i)), n)[earlier], np.uint64(1) << bit[earlier].astype(np.uint64))
            out.append((r["run"], r["bucket"], mask.tobytes()))
        kinds = (pa.string(), pa.int32(), pa.binary())
        return pa.table([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=["run", "bucket", "mask"])

    return run


#: Bytes of texts that are stripped at once, in arrays of a number a byte.
GROUP = 1 << 19


def _stripped(own: Run, doc: np.ndarray, found: Segments, mask: np.ndarray, at: int, end: int) -> list[tuple]:
    """(doc, n_bytes, n_removed, n_spans, kept) of the run's texts from number `at` to `end`."""
    begin, least = int(own.start[at]), own.least
    data = np.frombuffer(own.bytes, np.uint8, int(own.size[at:end].sum()), begin) if own.size[at:end].any() else np.zeros(0, np.uint8)
    i = slice(*np.searchsorted(found.text, [at, end]).tolist())
    which, place = found.own[i], found.place[i] - begin
    gone = np.zeros(len(data) + 1, np.int32)  # starts of covered strings
    later = doc[found.text[i]] > found.held_by[which]  # another text of this run has it before
    np.add.at(gone, place[later], 1)
    np.add.at(gone, place[later] + found.size[which[later]] - least + 1, -1)
    mine, place = mask[which[~later]], place[~later]
    for o in range(int(found.size[which].max(initial=least - 1)) - least + 1):
        hit = place[(mine >> np.uint64(o) & np.uint64(1)).astype(bool)] + o
        np.add.at(gone, hit, 1)
        np.add.at(gone, hit + 1, -1)
    starts = np.flatnonzero(np.cumsum(gone[:-1], dtype=np.int32) > 0)
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + least, -1)
    covered = np.cumsum(change[:-1], dtype=np.int32) > 0
    out = []
    for d, a, size in zip(doc[at:end].tolist(), (own.start[at:end] - begin).tolist(), own.size[at:end].tolist(), strict=True):
        c = covered[a : a + size]
        if c.any():
            spans = int(c[0]) + int((c[1:] & ~c[:-1]).sum())
            out.append((d, size, int(c.sum()), spans, data[a : a + size][~c].tobytes()))
        else:
            out.append((d, size, 0, 0, data[a : a + size].tobytes()))
    return out


def _strip(least: int, n: int):
    def run(key, texts, told):
        """The run's texts without the covered bytes."""
        rows = told.to_pylist()
        asked = {r["bucket"]: np.frombuffer(r["repeated"], np.uint32) for r in rows if r["repeated"] is not None}
        often = {r["bucket"]: np.frombuffer(r["frequent"], np.uint32) for r in rows if r["frequent"] is not None}
        masks = {r["bucket"]: np.frombuffer(r["mask"], np.uint64) for r in rows if r["mask"] is not None}
        out = []
        for r in _rows(texts):
            doc, own = _read(r, least)
            found = own.segments(doc, n, dict(sorted(asked.items())), often)
            mask = found.covered(np.concatenate([np.zeros(0, np.uint64), *(masks[k] for k in sorted(masks))]))
            ends = np.cumsum(own.size)
            at = 0
            while at < len(doc):  # texts of some bytes at once, or one longer text
                end = max(at + 1, int(np.searchsorted(ends, own.start[at] + GROUP, "right")))
                out += _stripped(own, doc, found, mask, at, end)
                at = end
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _level(sample: DataFrame, step: int) -> DataFrame:
    """Names of the places by three names in a row, `step` bytes apart: equal names for equal triples, in their order. One
    range-partitioned sort; equal triples share a partition, so a name is its rank there after those before it."""
    w = Window.partitionBy("doc", "rest").orderBy("i")
    triple = sample.select("doc", "rest", "i", "name", F.coalesce(F.lead("name", step).over(w), F.lit(0)).alias("n2"), F.coalesce(F.lead("name", 2 * step).over(w), F.lit(0)).alias("n3"))
    key = ["name", "n2", "n3"]
    held = cut(triple.repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "triples")
    rank = held.withColumn("rank", F.dense_rank().over(Window.partitionBy("part").orderBy(*key)))
    sizes = rank.groupBy("part").agg(F.max("rank").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return cut(rank.join(F.broadcast(before), "part").select("doc", "rest", "i", (F.col("rank") + F.col("before")).alias("name")), "names")


def _bytes(batches):
    for batch in batches:
        texts = [np.frombuffer(t, np.uint8) for t in batch.column(1).to_pylist()]
        doc = np.repeat(batch.column(0).to_numpy(), [len(t) for t in texts])
        i = np.concatenate([np.arange(len(t)) for t in texts] or [np.zeros(0, np.int64)])
        b = np.concatenate(texts or [np.zeros(0, np.uint8)]).astype(np.int64) + 1
        for at in range(0, len(i), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(doc[part]), pa.array(i[part]), pa.array(b[part])], names=["doc", "i", "b"])


def earlier_starts(docs: DataFrame, least: int = 50) -> DataFrame:
    """(doc, i): the places at which a string of `least` bytes starts that also starts in a document with a smaller id, of
    docs (doc, text as bytes; ids differ). The whole difference cover over all suffixes as stages of the cluster: the
    sample (places 1 and 2 modulo 3) is sorted by triples of bytes, then again and again by triples of its names, until
    three of these span `least` bytes; places 0 modulo 3 are merged in by their first bytes and the next sampled name; equal
    neighbours in these orders are equal strings, and the least of their documents is the owner.

    Every place is a row that is shuffled at each level, so this moves far more than ten times the texts. It is here to
    hold `remove_repeats` against, and to be measured."""
    every = cut(docs.mapInArrow(_bytes, "doc long, i long, b long").withColumn("rest", (F.col("i") % 3).cast("int")), "bytes")
    w = Window.partitionBy("doc").orderBy("i")
    ahead = {f"b{k}": F.coalesce(F.lead("b", k).over(w), F.lit(0)) for k in (1, 2)} | {"end": F.lead("b", least - 1).over(w), "end2": F.lead("b", least - 2).over(w)}
    near = cut(every.withColumns(ahead), "near")
    # a first name is a triple of bytes as one number
    sample = cut(near.where("rest > 0").select("doc", "rest", "i", ((F.col("b") * 257 + F.col("b1")) * 257 + F.col("b2")).alias("name")), "names")
    known = 3
    while 3 * known <= least - 2:
        sample, known = _level(sample, known // 3), 3 * known
    # names of a string's part from a sampled place on: three of them, which may overlap, and the last two bytes beside
    v = Window.partitionBy("doc", "rest").orderBy("i")
    both = near.where("end is not null").select("doc", "i", "rest", "b", "b1", "end", "end2")
    for k in range(3):
        far = (least - k) // 3 * 3 - known
        part = F.struct("name", F.lead("name", min(known, far) // 3).over(v).alias("n2"), F.lead("name", far // 3).over(v).alias("n3"))
        both = both.join(sample.select("doc", (F.col("i") - k).alias("i"), part.alias(f"r{k}")), ["doc", "i"], "left")
    both = cut(both, "starts")
    # equal strings at two places have a sampled name in common at the same distance: 0, 1 or 2 bytes on
    same = [(["r0", "end2", "end"], [1, 2]), (["b", "r1", "end2", "end"], [0, 1]), (["b", "b1", "r2", "end2", "end"], [0, 2])]
    owners = []
    for key, rests in same:
        rows = both.where(F.col("rest").isin(rests)).select("doc", "i", *key)
        owner = rows.groupBy(*key).agg(F.min("doc").alias("owner"))
        owners.append(rows.join(owner, key).where("owner < doc").select("doc", "i"))
    return union(owners).distinct()


def remove_repeats(docs: DataFrame, least: int = 50, run_bytes: int = 4 << 20, bucket_bytes: int = 12 << 20, max_runs: int = 500) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every whole text without the bytes that a string of `least` bytes
    covers which also starts in a document with a smaller doc_id. Strings are judged on the input; matches don't cross
    documents.

    Method. A distributed difference cover over the whole corpus would move each sampled suffix, with its names, once a
    level; so suffixes that can't repeat go first. Texts lie in runs of about run_bytes; each string of `least` bytes
    has a minimiser, and runs tell buckets of minimiser hashes which they have (four bytes each). Only for minimisers
    of two texts at least are segments cut out, which hold the strings with that minimiser, and dealt to the same
    buckets; equal segments of a run go once, with their least doc_id. Every bucket sorts its distinct segments'
    suffixes by the difference-cover algorithm (triples at places 1 and 2 modulo 3, recursion on names, merge) and
    compares adjacent prefixes of `least` bytes; what goes back to a run is a bit for each string of its segments. For
    minimisers in many texts, each string is dealt by its own hash, so that a run sends equal ones once and nothing
    gathers. All exact: hashes only choose who meets whom. Each run and bucket that have something for each other
    exchange rows, so their number grows with the square of the texts over run_bytes times bucket_bytes: both are as
    large as a task's memory allows.

    Null texts are empty. A null doc_id counts as the largest id and comes back as null. Rows with the same doc_id don't
    remove each other's bytes.
    """
    spark = docs.sparkSession
    rows = docs.select(id_of().alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    n_runs = partitions(spark)
    gram_of(least)
    table = scratch_table(spark, "texts")
    runs = rows.mapInArrow(_runs(run_bytes), "run string, doc binary, size binary, data binary")
    # each task has few runs, a file each: the texts are on disk once, without an exchange before it
    runs.write.bucketBy(n_runs, "run").option("compression", "zstd").format("parquet").saveAsTable(table)
    texts = spark.table(table)
    size = texts.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    n = max(-(-size // bucket_bytes), min(6, n_runs))
    # run by run: a partition's runs together are a batch of many times a run's bytes
    minimisers = texts.groupBy("run").applyInArrow(_minimisers(least, n), "run string, bucket int, one binary, more binary, many binary")
    schema = "run string, bucket int, repeated binary, frequent binary"
    told = cut(minimisers.groupBy("bucket").applyInArrow(_repeated(max_runs), schema), "repeated")
    segments = texts.groupBy("run").cogroup(told.groupBy("run")).applyInArrow(_segments(least, n), _SENT)
    masks = segments.groupBy("bucket").applyInArrow(_cover(least), "run string, bucket int, mask binary")
    answers = cut(told.withColumn("mask", F.lit(None).cast("binary")).unionByName(masks, allowMissingColumns=True), "answers")
    out = texts.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(_strip(least, n), "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(id_back("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
