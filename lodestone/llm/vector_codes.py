"""Product codes of vectors, with codebooks by filtering Lloyd rounds.

Vectors become whole numbers and are cut into PARTS equal parts; each part position has a codebook of up to ENTRIES entries.
Every chunk of a partition builds one kd-tree for each part position, whose nodes hold bounding box, sum and count of their
parts; the trees are stored once and every round reads them. A round goes down a tree level by level, all nodes of a
level at once: an entry goes on the list of a node only if it can be the nearest for a point of the node's box, and
a node with one entry left hands over its sum and count whole. Only leaves that several entries reach compare their points.
Sums by part and entry are added up by Spark; the driver holds the codebooks alone.

Distances are exact: doubles while all whole numbers that occur fit, 64-bit whole numbers else. Ties go to the lower index,
also in the filter.

Defined cases: rows whose vector is null, empty or has null or non-finite components are dropped, as are those with a component of LIMIT or
more in magnitude, whose squares would leave 64 bits, and those whose length differs from that of the smallest kept
id; a length that PARTS does not divide is filled up with zeros; null ids come after all others; of repeated ids the lesser vector comes first, and
each row has its code; with fewer rows than ENTRIES the codebooks are shorter; null labels are equal; an empty
table gives no rows; of docs' other columns none is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, lookup_join, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components are smaller than this in magnitude; 4096 times it, with up to 2,047 components in a part, fits 64 bits squared and summed.
LIMIT = 4096.0
#: Vectors of a chunk, parts of a leaf at most; vectors and chunks in an Arrow batch.
CHUNK, LEAF, BATCH, CHUNK_BATCH = 8192, 32, 4096, 4

CHUNK_SCHEMA = "ids array<bigint>, labels array<string>, points array<binary>, places array<binary>, low array<binary>, high array<binary>, sums array<binary>"
SUM_SCHEMA = "part int, entry int, n bigint, sums array<bigint>"
CODE_SCHEMA = "vec_id bigint, label string, code string, error bigint"


@contextmanager
def _batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, so many rows make an Arrow batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def whole_vectors(vectors: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    """id, label (a string, null apart) and v, the whole numbers, of the rows that are not dropped."""
    x = F.col(vector).cast("array<double>")
    fine = (F.size(x) > 0) & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT)), F.lit(False))
    whole = F.transform(x, lambda c: F.floor(c * SCALE).cast("int"))
    return vectors.filter(fine).select(F.col(id).alias("id"), keyed(F.col(label)).alias("label"), whole.alias("v"))


def levels(n: int) -> int:
    """Splits from the root to the leaves of a tree over n points."""
    return max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))


def starts(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin among n points, and n. Each node is halved."""
    out = np.array([0, n])
    for _ in range(level):
        out = np.append(np.stack([out[:-1], (out[:-1] + out[1:]) // 2], axis=1).ravel(), n)
    return out


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of the points in a kd-tree, and low, high and sum of all its nodes, level by level. Each node is halved at the median of its widest side."""
    n, dim = points.shape
    order = np.arange(n)
    boxes = []
    for level in range(levels(n) + 1):
        at = starts(n, level)
        low, high = np.minimum.reduceat(points[order], at[:-1]), np.maximum.reduceat(points[order], at[:-1])
        boxes.append((low, high, np.add.reduceat(points[order].astype(np.int64), at[:-1])))
        if level < levels(n):
            node = np.repeat(np.arange(len(at) - 1), np.diff(at))
            side = (high - low).argmax(axis=1)[node]
            order = order[np.lexsort((points[order, side], node))]
    low, high, sums = (np.concatenate([b[i] for b in boxes]) for i in range(3))
    return order, low, high, sums


def assign(codebook: np.ndarray, points: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts and sums by entry (the latter if sums are given), and the entry of each point, in the tree's order."""
    n, k = len(points), len(codebook)
    most = max(int(np.abs(codebook).max()), -int(low.min()), int(high.max()), 1)
    kind = np.float64 if 16 * most * most * points.shape[1] < 1 << 53 else np.int64
    book = codebook.astype(kind)
    entries = np.arange(k)
    counts, totals, labels = np.zeros(k, np.int64), np.zeros(codebook.shape, np.int64), np.zeros(n, np.int8)
    nodes, reach, first = np.array([0]), np.ones((1, k), bool), 0
    depth = levels(n)
    for level in range(depth + 1):
        at = starts(n, level)
        lo, hi = low[first + nodes].astype(kind), high[first + nodes].astype(kind)
        # the entry on the list that is nearest to the middle of the box
        middle = np.square(2 * book[None] - (lo + hi)[:, None]).sum(axis=2)
        best = np.where(reach, middle, np.iinfo(np.int64).max).argmin(axis=1)
        mine = book[best][:, None]
        # the corner of the box that is best for each entry against it
        corner = np.where(book[None] > mine, hi[:, None], lo[:, None])
        worse = np.square(book[None] - corner).sum(axis=2) - np.square(mine - corner).sum(axis=2)
        reach &= (worse < 0) | ((worse == 0) & (entries[None] <= best[:, None]))
        settled = reach.sum(axis=1) == 1
        for node, entry in zip(nodes[settled], best[settled], strict=True):
            labels[at[node] : at[node + 1]] = entry
        counts += np.bincount(best[settled], weights=(at[nodes + 1] - at[nodes])[settled], minlength=k).astype(np.int64)
        if sums is not None:
            np.add.at(totals, best[settled], sums[first + nodes[settled]])
        nodes, reach = nodes[~settled], reach[~settled]
        first += len(at) - 1
        if level < depth:
            nodes, reach = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel(), np.repeat(reach, 2, axis=0)
    size = at[nodes + 1] - at[nodes]
    if len(nodes):
        left = np.repeat(at[nodes] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        some = points[left]
        far = np.square(some.astype(kind)[:, None] - book[None]).sum(axis=2)
        labels[left] = np.where(np.repeat(reach, size, axis=0), far, np.iinfo(np.int64).max).argmin(axis=1)
        counts += np.bincount(labels[left], minlength=k)
        if sums is not None:
            np.add.at(totals, labels[left].astype(np.int64), some.astype(np.int64))
    return counts, totals, labels


def _trees(length: int):
    """mapInArrow function: rows of whole_vectors() become chunks with their trees."""
    dim = -(-length // PARTS)

    def chunk(rows: pa.Table) -> pa.RecordBatch:
        n = len(rows)
        flat = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, length)
        points = np.zeros((n, PARTS * dim), np.int32)
        points[:, :length] = flat
        trees = [(points[:, p * dim : (p + 1) * dim], *build(points[:, p * dim : (p + 1) * dim])) for p in range(PARTS)]
        blobs = lambda f: [[f(t).tobytes() for t in trees]]
        return pa.RecordBatch.from_pydict(
            {
                "ids": pa.array([rows["id"].to_pylist()], pa.list_(pa.int64())),
                "labels": pa.array([rows["label"].to_pylist()], pa.list_(pa.string())),
                "points": blobs(lambda t: np.ascontiguousarray(t[0][t[1]])),
                "places": blobs(lambda t: t[1].astype(np.int32)),
                "low": blobs(lambda t: t[2].astype(np.int32)),
                "high": blobs(lambda t: t[3].astype(np.int32)),
                "sums": blobs(lambda t: t[4]),
            }
        )

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            while n >= CHUNK:
                rows = pa.Table.from_batches(held)
                yield chunk(rows.slice(0, CHUNK))
                held = rows.slice(CHUNK).to_batches()
                n -= CHUNK
        if n:
            yield chunk(pa.Table.from_batches(held))

    return run


def _each(batches, names: tuple[str, ...], dim: int):
    """The chunks' rows, and a function from a part to its arrays."""
    kinds = {"points": np.int32, "places": np.int32, "low": np.int32, "high": np.int32, "sums": np.int64}
    for batch in batches:
        for i in range(len(batch)):
            row = lambda name, i=i, batch=batch: batch.column(name)[i]

            def arrays(part: int, row=row) -> list[np.ndarray]:
                found = [np.frombuffer(row(name)[part].as_buffer(), kinds[name]) for name in names]
                return [a if name == "places" else a.reshape(-1, dim) for name, a in zip(names, found, strict=True)]

            yield row, arrays


def _summed(books: np.ndarray):
    """mapInArrow function: chunks become counts and sums by part and entry; each task adds up its own first."""
    parts, k, dim = books.shape

    def run(batches):
        counts, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, dim), object)
        for _, arrays in _each(batches, ("points", "low", "high", "sums"), dim):
            for p in range(parts):
                n, total, _ = assign(books[p], *arrays(p))
                counts[p] += n
                sums[p] += total
        hit = [(p, e) for p in range(parts) for e in range(k) if counts[p, e]]
        if hit:
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([p for p, _ in hit], pa.int32()),
                    "entry": pa.array([e for _, e in hit], pa.int32()),
                    "n": pa.array([int(counts[x]) for x in hit], pa.int64()),
                    "sums": pa.array([[int(s) for s in sums[x]] for x in hit], pa.list_(pa.int64())),
                }
            )

    return run


def _coded(books: np.ndarray):
    """mapInArrow function: chunks become ids, labels, codes and errors."""
    parts, _, dim = books.shape
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches):
        for row, arrays in _each(batches, ("points", "places", "low", "high"), dim):
            codes, errors = [], 0
            for p in range(parts):
                points, places, low, high = arrays(p)
                _, _, entry = assign(books[p], points, low, high, None)
                entry = entry.astype(np.int64)
                mine, error = np.empty(len(entry), np.int64), np.empty(len(entry), np.int64)
                mine[places], error[places] = entry, np.square(points.astype(np.int64) - books[p][entry]).sum(axis=1)
                codes.append(digits[mine])
                errors = errors + error
            code = codes[0]
            for more in codes[1:]:
                code = np.char.add(code, more)
            yield pa.RecordBatch.from_pydict(
                {"vec_id": row("ids").values, "label": row("labels").values, "code": pa.array(code.tolist(), pa.string()), "error": pa.array(errors, pa.int64())}
            )

    return run


def _first_books(vectors: DataFrame, length: int) -> np.ndarray:
    """The parts of the vectors of the least ids: part, entry, component."""
    least = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).collect()  # ENTRIES rows
    dim = -(-length // PARTS)
    out = np.zeros((len(least), PARTS * dim), np.int64)
    for i, row in enumerate(least):
        out[i, :length] = row["v"]
    return np.ascontiguousarray(out.reshape(len(least), PARTS, dim).transpose(1, 0, 2))


def books_hash(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def _wide(column: str, dim: int) -> list[Column]:
    return [F.sum(F.get(column, i).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """A table of vec_id, label, code and error of every kept row, and the codebooks (part, entry, component)."""
    spark = vectors.sparkSession
    whole = table(whole_vectors(vectors, id, vector, label), "whole-vectors")
    least = whole.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    if not least:
        return spark.createDataFrame([], CODE_SCHEMA), np.zeros((PARTS, 0, 0), np.int64)
    length = len(least[0]["v"])
    same = whole.filter(F.size("v") == length)
    books = _first_books(same, length)
    dim = books.shape[2]
    with _batches(spark, BATCH):
        trees = table(same.mapInArrow(_trees(length), CHUNK_SCHEMA), "vector-trees")
    with _batches(spark, CHUNK_BATCH):
        for _ in range(ROUNDS):
            sums = trees.mapInArrow(_summed(books), SUM_SCHEMA).groupBy("part", "entry").agg(F.sum("n").alias("n"), *_wide("sums", dim))
            for row in sums.collect():  # PARTS times ENTRIES rows
                books[row["part"], row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(dim)]
        codes = table(trees.mapInArrow(_coded(books), CODE_SCHEMA), "vector-codes")
    return codes, books


def digest(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (errors of rows with the same label) and codebooks_sha256."""
    codes, books = compress(vectors, id, vector, label)
    sums = table(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    return lookup_join(codes, sums, "label").select("vec_id", "code", "error", "label_error", F.lit(books_hash(books)).alias("codebooks_sha256"))
