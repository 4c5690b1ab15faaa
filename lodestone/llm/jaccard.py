"""Similarity join of documents on five-word shingles, with Bayesian pruning.

1. Documents with equal shingle sets form a class. Each class has HASHES MinHash values.
2. Bands of ROWS values propose pairs: classes that share a band's bucket. A pair at SIMILARITY shares none of the BANDS
   buckets with a probability of (1 - SIMILARITY ** ROWS) ** BANDS, 5e-8.
3. In a bucket, the values (8 bits of each) are compared STEP at a time, and a pair is dropped as soon as the posterior probability that its
   similarity reaches SIMILARITY, from a uniform prior, is below TOLERANCE. What is left joins classes to blocks.
4. Within a block the same comparison prunes pairs, and each pair that survives, no other, is verified exactly on the shingles
   themselves. Verified links give each class its
   number of links, and their components its group.

No group grows without bound. A bucket of more than PART classes is cut to parts, each of which also holds the bucket's least class: what
hangs together with that class needs no further comparison, and only what does not, in any part, is compared with the whole bucket.
A block of more than PART classes or PART_BYTES bytes of shingles is cut to parts, and each pair of parts is a group of its own. Shingles
travel as hashes, once for each part that a class meets. A bucket gives a spanning tree of its links, a block the sums of each class: never all pairs.

Defined cases: a null or empty text has no shingles, no links and a group of its own; a text of fewer than five words is one shingle;
copies are one class; repeated rows are copies; a null id comes after all others; of equal ids the row read first stands for the group; an
empty table gives no rows; texts are read whole; columns of docs with any names stay in row.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, small, table
from .components import components
from .shingles import WordHashes, shingle_set

SIMILARITY = 0.8
ROWS, BANDS = 4, 32
HASHES = ROWS * BANDS
STEP = 16
TOLERANCE = 1e-7
#: Classes of a bucket or block, and bytes of a block's shingles, that a task holds, twice.
PART, PART_BYTES = 16_384, 1 << 25

_seeds = np.frombuffer(b"".join(xxhash.xxh64_digest(b"minhash", i) for i in range(HASHES)), np.uint32).reshape(HASHES, 2)
TURN, FACTOR = _seeds[:, 0].copy(), _seeds[:, 1] | np.uint32(1)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of a non-empty shingle set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, ((x[i : i + 1024, None] ^ TURN) * FACTOR).min(axis=0), out=out)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, different for equal values in different bands."""
    raw = minima.tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[4 * ROWS * b : 4 * ROWS * (b + 1)], b) for b in range(BANDS)], np.uint64).view(np.int64)


def sketch(minima: np.ndarray) -> bytes:
    """8 bits of each minimum."""
    return ((minima * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def least_matches() -> list[int]:
    """For each number of compared values, the matches below which a pair is dropped.

    With c the probability that 8-bit values match, c(s) = s + (1 - s) / 256, and a uniform prior on c, the posterior of c is
    Beta(m + 1, n - m + 1), and P(c >= x | m, n) = P(Binomial(n + 1, x) <= m)."""
    x = SIMILARITY + (1 - SIMILARITY) / 256
    out = []
    for n in range(HASHES + 1):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * x**m * (1 - x) ** (n + 1 - m)
            if total >= TOLERANCE:
                break
            m += 1
        out.append(m)
    return out


NEED = least_matches()


def possible(sketches: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a[i], b[i]) are not dropped."""
    low, high = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    alive = np.flatnonzero(low >= SIMILARITY * high - 1e-9)
    matches = np.zeros(len(a), np.int32)
    for i in range(0, HASHES, STEP):
        if not len(alive):
            break
        matches[alive] += (sketches[a[alive], i : i + STEP] == sketches[b[alive], i : i + STEP]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= NEED[i + STEP]]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


PAIRS = 200_000


def spanning(sketches: np.ndarray, sizes: np.ndarray, roots: int | None = None) -> list[tuple[int, int]]:
    """Edges that join the members of a bucket as all pairs that are not dropped would. With roots, only the first so many
    members are compared with all others: what they reach directly hangs together with them."""
    edges: list[tuple[int, int]] = []
    left = np.arange(len(sizes))
    while len(left) > 1 and (roots is None or left[0] < roots):
        root, left = left[0], left[1:]
        front = np.array([root])
        while len(front) and len(left):
            reached = []
            step = max(1, PAIRS // len(left))
            for i in range(0, len(front), step):
                part = front[i : i + step]
                if not len(left):
                    break
                hit = np.zeros(len(left), bool)
                for j in range(0, len(left), PAIRS):
                    some = left[j : j + PAIRS]
                    kept = possible(sketches, sizes, np.repeat(part, len(some)), np.tile(some, len(part)))
                    hit[j : j + PAIRS] = kept.reshape(len(part), len(some)).any(axis=0)
                reached.append(left[hit])
                left = left[~hit]
            front = np.concatenate(reached) if reached else np.zeros(0, np.int64)
            edges += [(int(root), int(x)) for x in front]
    return edges


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of one key at a time, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.append(np.append(0, np.flatnonzero(k[1:] != k[:-1]) + 1), len(k))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and k[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = k[a]
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _parted(df: DataFrame, group: str, id_: str, parts: Column) -> DataFrame:
    """df with part, a key for each group or, if a group has several parts, for each pair of them; same: the pair is one part
    twice; first: the row is in the first of the two."""
    df = df.withColumn("_parts", parts.cast("int"))
    parts = F.col("_parts")
    own = F.pmod(F.xxhash64(id_, F.lit("part")), parts).cast("int")
    df = df.withColumn("_own", own).withColumn("_with", F.explode(F.sequence(F.lit(0), parts - 1)))
    low, high = F.least("_own", "_with"), F.greatest("_own", "_with")
    return df.withColumn("part", F.xxhash64(group, low, high)).withColumn("same", low == high).withColumn("first", F.col("_own") == low).drop("_own", "_with", "_parts")


def sketched(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """A table of rid, row (struct of keep), t, set (hash of the shingle set, null if empty), n, keys and sketch."""
    df = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets, sizes, keys, small_ = [], [], [], []
            for t in b.column("t"):
                s = shingle_set(t.as_py(), hashes)
                sizes.append(len(s))
                if not len(s):
                    sets.append(None), keys.append(None), small_.append(None)
                    continue
                minima = minhash(s)
                sets.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(band_keys(minima))
                small_.append(sketch(minima))
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("t"), pa.array(sets, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(small_, pa.binary())],
                ["row", "t", "set", "n", "keys", "sketch"],
            )

    out = df.mapInArrow(run, f"row {dict(df.dtypes)['row']}, t string, set binary, n int, keys array<long>, sketch binary")
    return table(out.withColumn("rid", F.monotonically_increasing_id()), "sketched")


def _bucket_edges(classes: DataFrame) -> DataFrame:
    """Links (a, b) that the buckets propose and the posterior keeps, as spanning trees."""
    rows = classes.select("id", F.explode("keys").alias("key"))
    counts = table(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("pivot")).filter("c > 1"), "buckets")
    parts = F.ceil(F.col("c") / PART).cast("int")
    own = F.xxhash64("key", F.when(parts > 1, F.pmod(F.xxhash64("id", F.lit("part")), parts)).otherwise(0).cast("long"))
    shared = lookup_join(rows, counts, "key", "inner").select("key", "id", own.alias("part"), F.when(F.col("id") == F.col("pivot"), 0).otherwise(1).alias("place"), (parts > 1).alias("hot"))
    every = counts.filter(F.col("c") > PART).select("key", F.col("pivot").alias("id"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("p"))
    pivots = every.select("key", "id", F.xxhash64("key", F.col("p").cast("long")).alias("part"), F.lit(0).alias("place"), F.lit(True).alias("hot"))
    dealt = shared.filter("NOT (hot AND place = 0)").unionByName(pivots)
    found = table(_with_sketches(dealt, classes).mapInArrow(_own_trees, "a long, b long, key long").distinct(), "trees")
    edges = found.filter("key IS NULL").select("a", "b")
    rest = found.filter("key IS NOT NULL").select("key", F.col("a").alias("id"))
    if not rest.limit(1).count():
        return edges
    # what no least class reached meets its whole bucket, PART of it at a time
    many = table(rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("sets")), "rests")
    spread = lookup_join(lookup_join(rest, many, "key", "inner"), counts, "key", "inner")
    spread = table(spread.select("key", "id", F.pmod(F.xxhash64("id", F.lit("set")), "sets").cast("long").alias("set"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("p")), "rest")
    roots = spread.select("key", "id", F.xxhash64("key", "set", F.col("p").cast("long"), F.lit("rest")).alias("part"), F.lit(0).alias("place"), F.lit(False).alias("hot"))
    p = F.pmod(F.xxhash64("id", F.lit("part")), parts).cast("long")
    others = lookup_join(lookup_join(rows, counts.filter(F.col("c") > PART), "key", "inner"), many, "key", "inner")
    others = others.withColumn("set", F.explode(F.sequence(F.lit(0), F.col("sets") - 1))).select("key", "id", F.xxhash64("key", F.col("set").cast("long"), p, F.lit("rest")).alias("part"), F.lit(1).alias("place"), F.lit(False).alias("hot"))
    more = _with_sketches(roots.unionByName(others), classes).mapInArrow(_rest_trees, "a long, b long, key long")
    return edges.unionByName(more.select("a", "b")).distinct()


def _with_sketches(dealt: DataFrame, classes: DataFrame) -> DataFrame:
    members = dealt.join(classes.select("id", "n", "sketch"), "id").repartition("part").sortWithinPartitions("part", "place", "id")
    return members.select("part", "place", "key", "hot", "id", "n", "sketch")


def _own_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each part; of a part of a cut bucket also those (a, null, key) that its least class, the first row, does not reach."""
    return _trees(batches, False)


def _rest_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the rows at place 0 with all others of their part."""
    return _trees(batches, True)


def _trees(batches: Iterator[pa.RecordBatch], rooted: bool) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[int, int | None, int | None]] = set()
    for g in groups(batches, "part"):
        ids, place = g.column("id").to_numpy(), g.column("place").to_numpy()
        found = spanning(_matrix(g.column("sketch")), g.column("n").to_numpy(), int((place == 0).sum()) if rooted else None)
        seen.update((int(ids[a]), int(ids[b]), None) for a, b in found)
        if g.column("hot")[0].as_py():
            reached = {0, *(b for a, b in found if a == 0)}
            key = g.column("key")[0].as_py()
            seen.update((int(x), None, key) for i, x in enumerate(ids.tolist()) if i not in reached)
        if len(seen) > 50_000:
            yield _edges(seen)
            seen.clear()
    yield _edges(seen)


def _edges(seen: set[tuple[int, int | None, int | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in seen], pa.int64()) for i in range(3)], ["a", "b", "key"])


#: Bytes up to which a group's shingles are held as bits, and pairs that are looked up at a time beyond that.
PACKED, CHECKED = 1 << 26, 20_000


class Shared:
    """The shingles that two members or more of a group have: a row of bits for each member, or if that is too much, a sorted list of (member, shingle)."""

    def __init__(self, sets: list[np.ndarray]):
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        column = np.cumsum(np.diff(flat, prepend=flat[:1]) != 0)
        use = np.bincount(column)[column] > 1
        owner, column = owner[use], np.unique(column[use], return_inverse=True)[1]
        columns = int(column.max(initial=-1)) + 1
        self.bits = None
        if len(sets) * columns <= 8 * PACKED:
            self.bits = np.zeros((len(sets), -(-columns // 64)), np.uint64)
            np.bitwise_or.at(self.bits, (owner, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
            return
        order = np.lexsort((column, owner))
        self.column, self.columns = column[order], columns
        self.start = np.searchsorted(owner[order], np.arange(len(sets) + 1))
        self.place = owner[order].astype(np.int64) * columns + self.column

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        """How many shingles member i shares with each of the others."""
        if self.bits is not None:
            return np.bitwise_count(self.bits[others] & self.bits[i]).sum(axis=1, dtype=np.int64)
        own = self.column[self.start[i] : self.start[i + 1]]
        out = np.zeros(len(others), np.int64)
        step = max(1, CHECKED // max(len(own), 1))
        for k in range(0, len(others), step):
            want = others[k : k + step, None] * self.columns + own
            found = np.minimum(np.searchsorted(self.place, want), len(self.place) - 1)
            out[k : k + step] = (self.place[found] == want).sum(axis=1)
        return out


def links(sets: list[np.ndarray], sketches: np.ndarray, same: bool, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each member the members that reach SIMILARITY with it, each pair once; if not same, only pairs of a first and another row.

    Of all pairs only those are verified that survive the comparison of their values."""
    sizes = np.array([len(s) for s in sets])
    index, shared = np.arange(len(sets)), Shared(sets)
    blocks = [np.ascontiguousarray(sketches[:, k : k + STEP]) for k in range(0, HASHES, STEP)]
    for i in index.tolist():
        if not same and not first[i]:
            continue
        left = index[i + 1 :] if same else np.flatnonzero(~first)
        left = left[np.minimum(sizes[left], sizes[i]) >= SIMILARITY * np.maximum(sizes[left], sizes[i]) - 1e-9]
        matches = np.zeros(len(left), np.int32)
        for k, block in enumerate(blocks):
            if not len(left):
                break
            matches += (block[left] == block[i]).sum(axis=1, dtype=np.int32)
            alive = matches >= NEED[STEP * (k + 1)]
            if not alive.all():
                left, matches = left[alive], matches[alive]
        if len(left):
            common = shared.common(i, left)
            left = left[common >= SIMILARITY * (sizes[i] + sizes[left] - common) - 1e-9]
            if len(left):
                yield i, left


def _verified(members: DataFrame) -> DataFrame:
    """members (part, same, first, id, weight, sketch, s) as id, links (classes), copies (documents of linked classes) and root
    (least member that is reached by links), for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "part"):
            ids, weight = g.column("id").to_numpy(), g.column("weight").to_numpy()
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in g.column("s")]
            met, copies, root = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.arange(len(ids))
            for i, near in links(sets, _matrix(g.column("sketch")), g.column("same")[0].as_py(), g.column("first").to_numpy(zero_copy_only=False)):
                met[i] += len(near)
                met[near] += 1
                copies[i] += weight[near].sum()
                copies[near] += weight[i]
                if (root[near] != root[i]).any():
                    root = _joined(root, np.full(len(near), i), near)
            yield pa.RecordBatch.from_arrays([g.column("part").combine_chunks(), pa.array(ids), pa.array(met), pa.array(copies), pa.array(ids[root])], ["part", "id", "links", "copies", "root"])

    return members.mapInArrow(run, "part long, id long, links long, copies long, root long")


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after the pairs (a, b) are joined: of each component its least member."""
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        least = root.copy()
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(after := least[least], least):
            least = after
        root = least[root]


def members_of(texts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows for _verified, sorted by part: the members of blocks (root, id, rid, weight, sketch, c, bytes) with their shingles, once for each part they meet."""
    inside = table(blocks, "inside")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = pa.array([shingle_set(t.as_py(), hashes).tobytes() for t in b.column("t")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("rid"), sets], ["rid", "s"])

    ids = inside.select("rid")
    found = texts.join(F.broadcast(ids) if small(inside) else ids, "rid").mapInArrow(hashed, "rid long, s binary")
    parts = F.ceil(F.greatest(F.col("c") / PART, F.col("bytes") / PART_BYTES))
    members = _parted(found.join(inside, "rid"), "root", "id", parts)
    return members.select("part", "same", "first", "id", "weight", "sketch", "s").repartition("part").sortWithinPartitions("part", "id")


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", keep_rows: bool = False) -> DataFrame:
    """row (struct of key, or of docs' columns if keep_rows), class_id (least id of the group), n_links (other documents at
    SIMILARITY or more, copies among them), n_class_links (different texts among them), first (true for one document of each group)."""
    rows = sketched(docs, text, docs.columns if keep_rows else [key])
    own_id = F.col(f"row.{key}")
    place = F.struct(own_id.isNull().alias("none"), own_id.alias("key"), F.col("rid").alias("rid"))  # null ids come last
    classes = rows.filter("set is not null").groupBy("set").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("weight"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = table(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    blocks = table(components(_bucket_edges(classes), "a", "b"), "blocks")
    held = table(blocks.join(classes.select("id", "weight", "n", "sketch", F.col("least.rid").alias("rid")), "id"), "held")
    sizes = table(held.groupBy("root").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("n").cast("long") * 8).alias("bytes")), "sizes")
    members = members_of(rows.select("rid", "t"), lookup_join(held, sizes, "root", "inner"))
    verified = table(_verified(members), "verified")
    sums = verified.groupBy("id").agg(F.sum("links").alias("links"), F.sum("copies").alias("copies"))
    trees = components(verified.filter("id <> root"), "id", "root")
    grouped = sums.join(trees, "id", "left").withColumn("root", F.coalesce("root", "id"))
    own = classes.select("id", "set", "weight", "least").join(grouped, "id", "left").filter("links is not null or weight > 1")
    own = table(own.withColumn("root", F.coalesce("root", "id")), "own")
    heads = table(own.groupBy("root").agg(F.min("least").alias("head")), "heads")
    known = lookup_join(own, heads, "root", "inner").select("set", "head", F.coalesce("links", F.lit(0)).alias("links"), (F.coalesce("copies", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = lookup_join(rows.select("row", "rid", "set"), table(known, "known"), "set")
    return out.select(
        "row",
        F.when(F.col("head").isNull(), F.col(f"row.{key}")).otherwise(F.col("head.key")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_class_links"),
        F.coalesce(F.col("head.rid") == F.col("rid"), F.lit(True)).alias("first"),
    )


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one document, the one of the least id, of each group; columns unchanged."""
    return join(docs, text, key, keep_rows=True).filter("first").select("row.*")
