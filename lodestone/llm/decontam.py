"""Benchmark decontamination by SimHash over item-sized windows.

Every item is compared with the windows of a document that have as many words as the item. Windows and items are bags of five-word
shingles, and each has a fingerprint of BITS bits: the signs of the sums of its shingles' signs. Fingerprints within RADIUS
bits are found through BLOCKS blocks: two that differ in at most RADIUS bits differ in at most RADIUS // BLOCKS bits of some
block, so that lists by block value, kept for all values so near, hold every one of them. What lies within the radius is a candidate; candidates alone are verified, by the exact weighted
similarity sum(min) / sum(max) of the shingle counts. An item that is a candidate for one window is verified on all windows that adjoin it.

A window gets a fingerprint only if so many of its shingles occur anywhere in the benchmark that it could reach SIMILARITY with some item;
a window below that bound is far from all of them. A pair at SIMILARITY exactly lies within the radius with a
probability of about 0.998; nearer pairs do almost surely.

Items with the same words are one item, named by its least id, n_items says how many they are. Words are cut at ASCII white space; A to Z count as a to z. Items of fewer than five words are
one shingle of all their words; a document shorter than an item is one window.

Items are collected in blocks of ITEM_BYTES bytes. If there are several, one pass over the documents marks those with a window that passes
the bound for any item, by a filter of bits of bounded size; only these, written to a table, are compared with block after block.

Defined cases: null or empty texts and items match nothing; a null item_id counts as the last; repeated documents are reported
each; of equally similar windows the first is named; an empty table on either side gives no matches; documents are read whole; kept columns
with names of the result's columns give way to them in find(), which puts the others first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import table
from .shingles import SHINGLE, WordHashes, shingles

SIMILARITY = 0.8
BITS = 128
RADIUS = 31
BLOCKS = 8
#: Bytes of items that are broadcast at a time, about.
ITEM_BYTES = 1 << 23
#: Bits of the filter that tells which shingles the benchmark has: a power of two, 64 bits for each byte of items, between these.
FILTER_BITS = (22, 30)

_near = [np.flatnonzero(np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)) <= n).astype(np.uint16) for n in range(RADIUS // BLOCKS + 1)][-1]


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each hash and each of BITS bits."""
    parts = []
    for k in range(BITS // 64):
        x = hashes + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        parts.append((x ^ (x >> np.uint64(31))).astype("<u8"))
    bits = np.unpackbits(np.stack(parts, axis=1).view(np.uint8).reshape(-1, BITS // 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """BLOCKS numbers of 16 bits for each row of sums."""
    return np.packbits(sums > 0, axis=1).view(np.uint16).reshape(len(sums), -1)


class HammingIndex:
    """Finds all stored fingerprints within RADIUS bits of queries, by lists of those whose block is near a value."""

    #: Of up to so many fingerprints a block's list is found by looking at all of the block's values.
    SHORT = len(_near)

    def __init__(self, prints: np.ndarray):
        self.prints, self.lists, self.examined = prints, [], 0
        if len(prints) > self.SHORT:
            order = [np.argsort(prints[:, b], kind="stable") for b in range(BLOCKS)]
            self.lists = [(prints[o, b], o) for b, o in enumerate(order)]

    def within(self, queries: np.ndarray) -> np.ndarray:
        """The fingerprints near one of the queries at least."""
        if not self.lists:
            found = np.zeros(len(self.prints), bool)
            step = max(1, 100_000 // max(len(self.prints), 1))
            for i in range(0, len(queries), step):
                apart = np.bitwise_count(queries[i : i + step, None] ^ self.prints)
                listed = (apart <= RADIUS // BLOCKS).any(axis=2)
                self.examined += int(listed.sum())
                found |= (listed & (apart.sum(axis=2, dtype=np.int32) <= RADIUS)).any(axis=0)
            return np.flatnonzero(found)
        return np.unique(np.concatenate([self._listed(q) for q in queries]))

    def _listed(self, query: np.ndarray) -> np.ndarray:
        met = []
        for b, (values, order) in enumerate(self.lists):
            want = query[b] ^ _near
            left, right = np.searchsorted(values, want, "left"), np.searchsorted(values, want, "right")
            met += [order[i:j] for i, j in zip(left[left < right].tolist(), right[left < right].tolist(), strict=True)]
        some = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
        self.examined += len(some)
        return some[np.bitwise_count(self.prints[some] ^ query).sum(axis=1) <= RADIUS]


class Exact:
    """The shingles of a block of items, behind a mask by their leading bits that turns most others away."""

    BITS = 22

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.mask = np.unique(hashes), np.zeros(1 << self.BITS, bool)
        self.mask[self.hashes >> np.uint64(64 - self.BITS)] = True

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the shingles that some item has."""
        at = np.flatnonzero(self.mask[hashes >> np.uint64(64 - self.BITS)])
        if not len(at):
            return at
        found = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        return at[self.hashes[found] == hashes[at]]


class Filter:
    """Which shingles the whole benchmark has, as bits by hash: none is missed, and few others are taken for one."""

    def __init__(self, bits: int):
        self.shift, self.bits = np.uint64(64 - bits), np.zeros(1 << (bits - 3), np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        at = hashes >> self.shift
        np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return np.flatnonzero((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1))


def least_hits(m: int, n: int) -> int:
    """How many of its n shingles a window shares at least with an item of m at SIMILARITY: c common ones give c / (m + n - c)."""
    return int(np.ceil((m + n) * SIMILARITY / (1 + SIMILARITY) - 1e-9))


def possible(hits: np.ndarray, n: int, m: int) -> np.ndarray:
    """Starts of the windows of m shingles, or of the only one of a shorter text of n, with so many hits (places, sorted) that they could be near an item of m."""
    held = min(m, n)
    need = least_hits(m, held)
    if len(hits) < need:
        return np.zeros(0, np.int64)
    # a run of so many hits within a window's reach lets all windows pass that hold it
    close = np.flatnonzero(hits[need - 1 :] - hits[: len(hits) - need + 1] < held)
    first, last = np.maximum(hits[close + need - 1] - held + 1, 0), np.minimum(hits[close], n - held)
    return np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(first.tolist(), last.tolist(), strict=True)])) if len(close) else close


class Screen:
    """The sizes of all items, and which shingles they have."""

    def __init__(self, sizes: list[tuple[int, int]], known: Exact | Filter):
        self.known, self.sizes = known, {}
        for k, m in sizes:  # words of a shingle, shingles
            self.sizes.setdefault(k, []).append(m)

    def starts(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Words of a shingle, shingles of a window, the text's shingles and the starts of windows that could be near an item."""
        for k, sizes in self.sizes.items():
            hashes = shingles(words, k)
            hits = self.known.hits(hashes)
            for m in sizes if len(hits) else ():
                found = possible(hits, len(hashes), m)
                if len(found):
                    yield k, m, hashes, found


class Items:
    """Shingles and fingerprints of a block of items: (id, how many, text)."""

    def __init__(self, rows: list[tuple]):
        hashes = WordHashes()
        words = [hashes.of(t) for *_, t in rows]
        some = [i for i, w in enumerate(words) if len(w)]
        self.ids, self.many = [rows[i][0] for i in some], [rows[i][1] for i in some]
        words = [words[i] for i in some]
        widths = [min(len(w), SHINGLE) for w in words]
        flat = [shingles(w, k) for w, k in zip(words, widths, strict=True)]
        self.bags = [np.unique(x, return_counts=True) for x in flat]
        sizes = [(k, len(x)) for k, x in zip(widths, flat, strict=True)]
        self.screen = Screen(sorted(set(sizes)), Exact(np.concatenate(flat) if flat else np.zeros(0, np.uint64)))
        self.by_size = {}
        for size in sorted(set(sizes)):
            own = np.array([i for i, x in enumerate(sizes) if x == size])
            sums = np.array([(signs(self.bags[i][0]) * self.bags[i][1][:, None]).sum(axis=0) for i in own])
            self.by_size[size] = (own, HammingIndex(fingerprints(sums)))

    def matches(self, words: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window for each item that reaches SIMILARITY; the earliest of equal ones."""
        best: dict[int, tuple[float, int, int]] = {}
        for k, m, hashes, starts in self.screen.starts(words):
            held = min(m, len(hashes))
            own, index = self.by_size[k, m]
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                sums = np.vstack([np.zeros((1, BITS), np.int32), np.cumsum(signs(hashes[run[0] : run[-1] + held]), axis=0)])
                near = own[index.within(fingerprints(sums[run - run[0] + held] - sums[run - run[0]]))]
                if len(near):
                    for s in run.tolist():
                        bag = np.unique(hashes[s : s + held], return_counts=True)
                        for i in near.tolist():
                            found = similarity(bag, self.bags[i])
                            if found >= SIMILARITY - 1e-12 and (i not in best or found > best[i][0]):
                                best[i] = (found, s, held + k - 1)
        return [(i, s, a, n) for i, (s, a, n) in sorted(best.items())]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """sum(min) / sum(max) of two bags (sorted hashes, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / (int(a[1].sum()) + int(b[1].sum()) - common)


def filter_bits(size: int) -> int:
    low, high = FILTER_BITS
    return min(high, max(low, (64 * max(size, 1)).bit_length()))


def distinct_items(benchmark: DataFrame, item: str, text: str) -> tuple[DataFrame, int]:
    """A table of i (the least id), n and t (the words, joined by spaces) of the items, and its bytes."""
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    t = F.regexp_replace(F.regexp_replace(low, r"[\x20\x09-\x0D]+", " "), "^ | $", "")
    rows = benchmark.select(F.col(item).alias("i"), t.alias("t")).filter("t <> ''")
    found = table(rows.groupBy("t").agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("n")), "items")
    return found, found.agg(F.sum(F.octet_length("t") + 32)).first()[0] or 0


def _blocks(items: DataFrame, size: int) -> Iterator[Items]:
    """The items in blocks of about ITEM_BYTES bytes, dealt by a hash of their text."""
    blocks = 1 + size // ITEM_BYTES
    for b in range(blocks):
        found = items.filter(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).orderBy("i", "t").collect()
        yield Items([(x["i"], x["n"], x["t"]) for x in found])


def _screen(items: DataFrame, size: int) -> Screen:
    """Sizes and shingles of all items: the filter is joined from parts that tasks make, and its size is bounded whatever that of the benchmark."""
    bits = filter_bits(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known, sizes = WordHashes(), Filter(bits), set()
        for b in batches:
            for t in b.column("t"):
                words = hashes.of(t.as_py())
                k = min(len(words), SHINGLE)
                known.add(shingles(words, k))
                sizes.add((k, len(words) - k + 1))
        yield pa.RecordBatch.from_arrays([pa.array([known.bits.tobytes()], pa.binary()), pa.array([[x for pair in sorted(sizes) for x in pair]], pa.list_(pa.int32()))], ["bits", "sizes"])

    known, sizes = Filter(bits), set()
    for row in items.select("t").coalesce(8).mapInArrow(run, "bits binary, sizes array<int>").toLocalIterator():  # a filter at a time, 8 of them
        known.bits |= np.frombuffer(row["bits"], np.uint8)
        sizes |= set(zip(row["sizes"][::2], row["sizes"][1::2], strict=True))
    return Screen(sorted(sizes), known)


def _suspects(df: DataFrame, screen: Screen) -> DataFrame:
    """df (row, t) with suspect: a window could be near some item."""
    sent = df.sparkSession.sparkContext.broadcast(screen)
    kind = dict(df.dtypes)["row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            flags = [next(sent.value.starts(hashes.of(t.as_py())), None) is not None for t in b.column("t")]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("t"), pa.array(flags, pa.bool_())], ["row", "t", "suspect"])

    return df.mapInArrow(run, f"row {kind}, t string, suspect boolean")


FOUND = ("item_id", "n_items", "similarity", "first_word", "n_words")


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The columns of keep, and item_id, n_items, similarity, first_word and n_words of the best window for each document and item that match."""
    spark = docs.sparkSession
    df = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("t"))
    kind, item_kind = dict(df.dtypes)["row"], to_arrow_type(benchmark.schema[item].dataType)
    schema = f"row {kind}, item_id {dict(benchmark.dtypes)[item]}, n_items long, similarity double, first_word long, n_words long"
    every, size = distinct_items(benchmark, item, item_text)
    if size >= ITEM_BYTES:
        df = table(_suspects(df, _screen(every, size)).filter("suspect").select("row", "t"), "suspects")
    out = None
    for items in _blocks(every, size):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for b in batches:
                found = [(r, *x) for r, t in enumerate(b.column("t")) for x in sent.value.matches(hashes.of(t.as_py()))]
                if found:
                    r, i, s, a, n = zip(*found, strict=True)
                    own = [pa.array([sent.value.ids[x] for x in i], item_kind), pa.array([sent.value.many[x] for x in i]), pa.array(s), pa.array(a), pa.array(n)]
                    yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(r)), *own], ["row", *FOUND])

        part = df.mapInArrow(run, schema).select(*(F.col(f"row.{c}") for c in keep if c not in FOUND), *FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the documents that hold an item; columns unchanged."""
    spark = docs.sparkSession
    every, size = distinct_items(benchmark, item, item_text)
    df = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("t"))
    kind, safe = dict(df.dtypes)["row"], None
    if size >= ITEM_BYTES:
        marked = table(_suspects(df, _screen(every, size)), "suspects")
        safe, df = marked.filter("NOT suspect").select("row.*"), marked.filter("suspect").select("row", "t")
    for items in _blocks(every, size):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for b in batches:
                free = [not sent.value.matches(hashes.of(t.as_py())) for t in b.column("t")]
                yield b.filter(pa.array(free, pa.bool_()))

        df = df.mapInArrow(run, f"row {kind}, t string")
    df = df.select("row.*")
    return df if safe is None else safe.unionByName(df)
