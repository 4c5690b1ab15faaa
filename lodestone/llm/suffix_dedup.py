"""Removal of repeated byte strings with a sampled, range-partitioned suffix array.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document of a smaller id, or in the same one.

Anchors: among the LENGTH - GRAM + 1 grams (GRAM bytes) of a string the one of the least hash, the first of equal ones, is
its anchor. Equal strings have their anchors at the same place in them, so only suffixes at anchors, one in about 33, are compared.
1. Splitters are drawn from a sample of suffixes. Suffixes at anchors, with the bytes of all strings that they stand for, are range-partitioned by
   their leading bytes, up to LENGTH of them, in true order.
2. A range sorts its suffixes by multikey quicksort, eight bytes a character, and lets go of those whose leading gram occurs once. Of
   suffixes that agree in all their bytes all but the earliest are repeats in whole. Where a gram has different bytes around it, the strings
   themselves are sorted in the same way; equal ones are neighbours, and all but the earliest are repeats.
3. Strings whose anchors lie on either side of a splitter can be equal only if the leading gram is the splitter's own. Suffixes with such a gram are
   compared across boundaries: they go on as single strings, which have ranges of their own with splitters by all LENGTH bytes, so that equal strings meet and a gram
   however frequent is split inside.
4. Each document gathers its repeated strings and loses them.

A task settles copies among its own suffixes and strings first, so that what occurs in every document travels once a task. Hashes only choose anchors and
find candidates for equality: what is removed has been compared byte by byte.

Defined cases: a null text is empty; a null id comes after all others, the largest number too; ids that are no whole numbers count by their rank among all
ids; rows with equal ids count as one document, so that
neither is earlier than the other but for a smaller start; repeated rows give equal rows; texts shorter than LENGTH
stay; long texts are read in overlapping pieces of PIECE bytes; an empty table gives no rows; other columns of docs, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, shuffles_removed, table

LENGTH = 100
GRAM = 32
REACH = LENGTH - GRAM
AROUND = REACH + LENGTH
PIECE = 1 << 22
#: Documents, or one for so many ranges if that is more, and suffixes of each from which splitters are drawn.
SAMPLE_DOCS, RANGES_A_DOC, SAMPLE_SUFFIXES = 2000, 8, 64
#: Ranges for each shuffle partition.
RANGES = 4
#: Suffixes that a task holds before it settles and deals them; strings that it takes apart at a time.
HELD, STRINGS = 120_000, 200_000
#: Segments of so many rows are no more split by a pivot.
SMALL = 4096

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CODES = np.array([xxhash.xxh64_intdigest(b"byte", i) for i in range(256)], np.uint64)


class Powers:
    """Powers of BASE and of its inverse, modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(INVERSE, k, 1 << 64))])
        return self.up[:n], self.down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values."""
    n, out = 1, x
    while 2 * n <= width:
        out = np.minimum(out[: len(out) - n], out[n:])
        n *= 2
    rest = width - n
    return np.minimum(out[: len(x) - width + 1], out[rest : rest + len(x) - width + 1]) if rest else out


def anchors(raw: np.ndarray, powers: Powers) -> tuple[np.ndarray, ...]:
    """For each anchor of a piece: its place, the place less the first start of the strings it stands for, the last start less
    the first, gram hash, and the bytes of these strings: REACH columns before the anchor and LENGTH from it on, 0 where no string reaches."""
    up, down = powers.get(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(CODES[raw] * up[:-1], out=sums[1:])
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(sums) - GRAM])
    low = np.uint64(24)
    ranked = (grams >> low << low) | np.arange(len(grams), dtype=np.uint64)
    chosen = (sliding_least(ranked, REACH + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.append(0, np.flatnonzero(np.diff(chosen)) + 1)
    last = np.append(first[1:], len(chosen)) - 1
    p = chosen[first]
    padded = np.concatenate([np.zeros(REACH, np.uint8), raw, np.zeros(LENGTH, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, AROUND)[p]
    column = np.arange(AROUND)
    around *= (column >= (REACH - (p - first))[:, None]) & (column < (REACH + LENGTH + last - p)[:, None])
    return p, (p - first).astype(np.uint8), (last - first).astype(np.uint8), grams[p], around


def pieces(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Overlapping pieces; each string of LENGTH bytes lies in one."""
    for a in range(0, max(len(raw) - LENGTH + 1, 0), PIECE):
        yield a, raw[a : a + PIECE + LENGTH - 1]


def texts_of(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as texts of fixed length, which compare byte by byte."""
    rows = np.ascontiguousarray(rows)
    return rows.view(f"S{rows.shape[1]}").reshape(-1)


def strings_at(span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row, and start less that of the row's first string, of every string that the anchors stand for."""
    many = span.astype(np.int64) + 1
    row = np.repeat(np.arange(len(many)), many)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)


def strings_of(left: np.ndarray, span: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """strings_at(), and the LENGTH bytes of each."""
    row, offset = strings_at(span)
    windows = np.lib.stride_tricks.sliding_window_view(around, LENGTH, axis=1)
    return row, offset, windows[row, REACH - left[row].astype(np.int64) + offset]


PACK = zstandard.ZstdCompressor(level=1)
UNPACK = zstandard.ZstdDecompressor()


def compressed(data: bytes) -> bytes:
    return PACK.compress(data)


def restored(data: bytes) -> bytes:
    return UNPACK.decompress(data)


def pack(*arrays: np.ndarray) -> bytes:
    return compressed(b"".join([len(arrays[0]).to_bytes(8, "little"), *(np.ascontiguousarray(x).tobytes() for x in arrays)]))


def unpack(blobs: list[bytes], *kinds) -> list[np.ndarray]:
    """The columns that were packed, all blobs one after another. A kind may be (type, width)."""
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        raw = restored(blob)
        n, at = int.from_bytes(raw[:8], "little"), 8
        for i, kind in enumerate(kinds):
            kind, width = kind if isinstance(kind, tuple) else (kind, 0)
            many = n * max(width, 1)
            x = np.frombuffer(raw, kind, many, at)
            at += x.nbytes
            parts[i].append(x.reshape(n, width) if width else x)
    return [np.concatenate(x) if x else np.zeros((0, k[1]) if isinstance(k, tuple) else 0, k[0] if isinstance(k, tuple) else k) for x, k in zip(parts, kinds, strict=True)]


def dealt(keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A packed blob of the columns for each value of keys."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cuts = np.append(np.append(0, np.flatnonzero(np.diff(keys)) + 1), len(keys))
    columns = [x[order] for x in columns]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b > a:
            yield int(keys[a]), pack(*(x[a:b] for x in columns))


def text_hash(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) >> 1


class Owners:
    """Whose the rows are: whether the id is null, the id, a hash of the text."""

    KINDS = (np.uint8, np.int64, np.int64)

    def __init__(self, none: np.ndarray, id_: np.ndarray, text: np.ndarray):
        self.columns = (none, id_, text)

    @classmethod
    def of(cls, none: bool, id_: int, data: bytes, n: int) -> Owners:
        return cls(np.full(n, none, np.uint8), np.full(n, id_, np.int64), np.full(n, text_hash(data), np.int64))

    @classmethod
    def joined(cls, parts: list[Owners]) -> Owners:
        return cls(*(np.concatenate(x) for x in zip(*(p.columns for p in parts), strict=True)))

    def __getitem__(self, at) -> Owners:
        return Owners(*(c[at] for c in self.columns))

    def __len__(self) -> int:
        return len(self.columns[0])

    def differ(self, a: np.ndarray, b: np.ndarray, text: bool = False) -> np.ndarray:
        """Whether rows a and b are of different documents (or texts)."""
        none, id_, th = self.columns
        out = (none[a] != none[b]) | (id_[a] != id_[b])
        return out | (th[a] != th[b]) if text else out

    def home(self, homes: int) -> np.ndarray:
        """Where a document gathers what belongs to it."""
        none, id_, th = self.columns
        return (mixed(id_.astype(np.uint64) * np.uint64(BASE) + th.astype(np.uint64) + none) % np.uint64(homes)).astype(np.int32)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of intervals that overlap or touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return starts[at], reach[np.append(at[1:], len(reach)) - 1]


def firsts(owners: Owners, places: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order by keys, id and place; the start of each row's group of equal keys in it; which rows in it come truly after their group's first;
    which are rows of the same text and place as the one before."""
    none, id_, th = owners.columns
    order = np.lexsort((th, places, id_, none, *reversed(keys)))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    place = places[order]
    after = owners.differ(order, order[start]) | (place != place[start])
    again = ~new
    again[1:] &= ~owners.differ(order[1:], order[:-1], text=True) & (place[1:] == place[:-1])
    return order, start, after, again


SUFFIX = (*Owners.KINDS, np.int32, np.uint8, np.uint8, (np.uint8, AROUND))  # owner, place, place - first, last - first, bytes
STRING = (*Owners.KINDS, np.int32, (np.uint8, LENGTH))  # owner, start, bytes
SPAN = (*Owners.KINDS, np.int32, np.int32)  # owner, start, end
#: Rows that meet at a document's home: spans of kind 2, texts of kind 3.
HOME = "h int, kind int, none int, k long, th long, a int, b int, z binary"
HOME_NAMES = [x.split()[0] for x in HOME.split(", ")]
HOME_TYPES = [{"int": pa.int32(), "long": pa.int64()}[x.split()[1]] for x in HOME.split(", ")[:-1]]
NOTHING = np.zeros(0, np.int64)
#: Whose runs of bytes are, where they start and end.
Spans = tuple[Owners, np.ndarray, np.ndarray]


def _rows(pairs: list[tuple[int, int, bytes]], names: tuple[str, str, str]) -> pa.RecordBatch:
    a, k, z = zip(*pairs, strict=True) if pairs else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(k, pa.int32()), pa.array(z, pa.binary())], list(names))


def _blobs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(kind, blob) of each value of key, from batches sorted by key."""
    last, held = None, []
    for batch in batches:
        for k, kind, z in zip(batch.column(key).to_pylist(), batch.column("kind").to_pylist(), batch.column("z"), strict=True):
            if k != last and held:
                yield last, held
                held = []
            last = k
            held.append((kind, z.as_py()))
    if held:
        yield last, held


class Splitters:
    """Where ranges begin: of suffixes by their leading bytes, and of single strings of the grams that a splitter has."""

    def __init__(self, sample: list[tuple], ranges: int):
        self.ranges = ranges
        left, span, gram, around = (np.concatenate(x) for x in zip(*sample, strict=True)) if sample else (np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint64), np.zeros((0, AROUND), np.uint8))
        texts = texts_of(around[:, REACH:])
        order = np.argsort(texts, kind="stable")
        at = order[np.arange(1, ranges) * len(order) // ranges] if len(order) else order
        self.suffixes, self.grams = texts[at], np.unique(gram[at])
        own = np.isin(gram, self.grams)
        strings = np.sort(texts_of(strings_of(left[own], span[own], around[own])[2]))
        self.strings = np.unique(strings[np.arange(1, ranges) * len(strings) // ranges]) if len(strings) else strings

    def of_suffixes(self, around: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.suffixes, texts_of(around[:, REACH:]), "right").astype(np.int32)

    def of_strings(self, strings: np.ndarray) -> np.ndarray:
        return (self.ranges + np.searchsorted(self.strings, texts_of(strings), "right")).astype(np.int32)


def splitters(df: DataFrame, ranges: int) -> Splitters:
    """Splitters from a sample of documents; its size follows the number of ranges, whatever the number of documents."""
    wanted = max(SAMPLE_DOCS, ranges // RANGES_A_DOC)
    every = max(1, df.count() // wanted)
    draw = F.xxhash64("k", F.octet_length("t"), F.lit("splitters"))
    sample = df.filter(F.pmod(draw, F.lit(every)) == 0).orderBy(draw).limit(wanted).select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            for t in b.column("t"):
                raw = np.frombuffer((t.as_py() or "").encode("utf-8"), np.uint8)[:PIECE]
                if len(raw) >= LENGTH:
                    _, left, span, gram, around = anchors(raw, powers)
                    some = slice(None, None, -(-len(gram) // SAMPLE_SUFFIXES))
                    yield pa.RecordBatch.from_arrays([pa.array([pack(left[some], span[some], gram[some], around[some])], pa.binary())], ["z"])

    kinds = (np.uint8, np.uint8, np.uint64, (np.uint8, AROUND))
    return Splitters([unpack([bytes(x)], *kinds) for x in sample.mapInArrow(run, "z binary").toPandas().z], ranges)


def with_places(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """k (a whole number in the ids' order, null for null), t; and for other ids than whole numbers a table of k and id."""
    if dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint"):
        return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")), None
    ids = docs.select(F.col(key).alias("id")).filter("id IS NOT NULL").distinct()
    ids = table(ids.orderBy("id").withColumn("k", F.monotonically_increasing_id()), "ids")
    return lookup_join(docs.select(F.col(key).alias("id"), F.col(text).alias("t")), ids, "id").select("k", "t"), ids


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """k (id), n_bytes, n_removed, n_spans and kept (the bytes that stay) for each document."""
    spark = docs.sparkSession
    df, ids = with_places(docs, key, text)
    homes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = spark.sparkContext.broadcast(splitters(df, RANGES * homes))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        found: list[tuple] = []
        held = 0
        for b in batches:
            for k, t in zip(b.column("k").to_pylist(), b.column("t"), strict=True):
                data = (t.as_py() or "").encode("utf-8")
                if len(data) < LENGTH:
                    continue
                for at, raw in pieces(np.frombuffer(data, np.uint8)):
                    p, *rest = anchors(raw, powers)
                    found.append((Owners.of(k is None, k or 0, data, len(p)), (p + at).astype(np.int32), *rest))
                    held += len(p)
                    if held > HELD:
                        yield settle(found)
                        found, held = [], 0
        if found:
            yield settle(found)

    def settle(found: list[tuple]) -> pa.RecordBatch:
        owners = Owners.joined([x[0] for x in found])
        p, left, span, gram, around = (np.concatenate(x) for x in zip(*(x[1:] for x in found), strict=True))
        rows, group = equal_rows(characters(around, 0, AROUND), len(p), AROUND // 8)
        order, _, after, again = firsts(owners[rows], p[rows], left[rows], span[rows], group)
        rest = rows[order[after]]
        settled = np.zeros(len(p), bool)
        settled[rows[order[after | again]]] = True
        own = np.flatnonzero(~settled)
        a = p[rest] - left[rest]
        rows = _packed(_spans(owners[rest], a, a + span[rest] + LENGTH))
        hot = np.isin(gram[own], sent.value.grams)
        some = own[~hot]
        rows += [(r, 0, z) for r, z in dealt(sent.value.of_suffixes(around[some]), *owners[some].columns, p[some], left[some], span[some], around[some])]
        some = own[hot]
        for i in range(0, len(some), STRINGS // (REACH + 1)):
            rows += apart(owners, p, left, span, around, some[i : i + STRINGS // (REACH + 1)])
        return _rows(rows, ("r", "kind", "z"))

    def apart(owners: Owners, p: np.ndarray, left: np.ndarray, span: np.ndarray, around: np.ndarray, some: np.ndarray) -> list[tuple[int, int, bytes]]:
        """The strings of some suffixes, dealt to their ranges; those that are not the task's first are repeats already."""
        row, offset, strings = strings_of(left[some], span[some], around[some])
        at = some[row]
        start = (p[at] - left[at] + offset).astype(np.int32)
        place = np.unique(texts_of(strings), return_inverse=True)[1]
        order, _, after, again = firsts(owners[at], start, place)
        rest, own = order[after], order[~after & ~again]
        rows = _packed(_spans(owners[at[rest]], start[rest], start[rest] + LENGTH))
        return rows + [(r, 1, z) for r, z in dealt(sent.value.of_strings(strings[own]), *owners[at[own]].columns, start[own], strings[own])]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, blobs in _blobs(batches, "r"):
            for kind, found in ((0, repeated_suffixes), (1, repeated_strings), (2, _unpacked)):
                own = [z for k, z in blobs if k == kind]
                for owners, a, b in found(own) if own else ():
                    yield at_home(owners, 2, a, b, pa.nulls(len(a), pa.binary()))

    def at_home(owners: Owners, kind: int, a: np.ndarray, b: np.ndarray, z: pa.Array) -> pa.RecordBatch:
        none, id_, th = owners.columns
        columns = (owners.home(homes), np.full(len(a), kind), none, id_, th, a, b)
        return pa.RecordBatch.from_arrays([*(pa.array(x).cast(t) for x, t in zip(columns, HOME_TYPES, strict=True)), z], HOME_NAMES)

    first = df.mapInArrow(suffixes, "r int, kind int, z binary").repartition("r").sortWithinPartitions("r")
    with shuffles_removed(spark):  # the suffixes are several times the texts
        spans = table(first.mapInArrow(compare, HOME), "spans")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compressed texts with whose they are."""
        for b in batches:
            data = [(t.as_py() or "").encode("utf-8") for t in b.column("t")]
            if data:
                owners = Owners.joined([Owners.of(k is None, k or 0, d, 1) for k, d in zip(b.column("k").to_pylist(), data, strict=True)])
                zero = np.zeros(len(data), np.int32)
                yield at_home(owners, 3, zero, zero, pa.array(map(compressed, data), pa.binary()))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, held, own, a, b = None, [], {}, NOTHING, NOTHING
        for batch in batches:
            h, kind, none, id_, th, start, end = (batch.column(i).to_numpy() for i in range(7))
            z = batch.column("z")
            cuts = np.append(np.flatnonzero(np.append(len(h) > 0, (h[1:] != h[:-1]) | (kind[1:] != kind[:-1]))), len(h))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if h[i] != home:
                    home, held, own = h[i], [], None
                if kind[i] == 2:
                    held.append([x[i:j] for x in (none, id_, th, start, end)])
                    continue
                if own is None:
                    *owner, a, b = (np.concatenate(x) for x in zip(*held, strict=True)) if held else [NOTHING] * 5
                    held, own = [], _by_owner(*owner)
                out: list[tuple] = []
                for r in range(i, j):
                    data = restored(z[r].as_py())
                    at = own.get((bool(none[r]), int(id_[r]), int(th[r])), NOTHING)
                    starts, ends = merged(a[at], b[at])
                    kept = b"".join(data[e:s] for e, s in zip([0, *ends.tolist()], [*starts.tolist(), len(data)], strict=True))
                    out.append((None if none[r] else int(id_[r]), len(data), len(data) - len(kept), len(starts), kept))
                    if len(out) >= 256:
                        yield _finished(out)
                        out = []
                yield _finished(out)

    gathered = df.mapInArrow(texts, HOME).unionByName(spans).repartition("h").sortWithinPartitions("h", "kind")
    out = gathered.mapInArrow(finish, "k long, n_bytes long, n_removed long, n_spans long, kept binary")
    if ids is None:
        return out
    return lookup_join(out, ids, "k").select(F.col("id").alias("k"), "n_bytes", "n_removed", "n_spans", "kept")


def _finished(rows: list[tuple]) -> pa.RecordBatch:
    k, n, removed, spans, kept = zip(*rows, strict=True) if rows else ((),) * 5
    columns = [pa.array(x, pa.int64()) for x in (k, n, removed, spans)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary())], ["k", "n_bytes", "n_removed", "n_spans", "kept"])


def _by_owner(none: np.ndarray, id_: np.ndarray, th: np.ndarray) -> dict[tuple[bool, int, int], np.ndarray]:
    """The rows of each owner."""
    order = np.lexsort((th, id_, none))
    none, id_, th = none[order], id_[order], th[order]
    cuts = np.append(np.flatnonzero(np.append(len(th) > 0, (none[1:] != none[:-1]) | (id_[1:] != id_[:-1]) | (th[1:] != th[:-1]))), len(th))
    return {(bool(none[a]), int(id_[a]), int(th[a])): order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)}


def _spans(owners: Owners, starts: np.ndarray, ends: np.ndarray) -> Spans:
    """The runs of the intervals of each document; intervals that overlap or touch become one."""
    if not len(owners):
        return owners, starts.astype(np.int32), ends.astype(np.int32)
    none, id_, th = owners.columns
    order = np.lexsort((starts, th, id_, none))
    owners, starts, ends = owners[order], starts[order].astype(np.int64), ends[order].astype(np.int64)
    at = np.arange(len(order))
    document = np.cumsum(np.append(False, owners.differ(at[1:], at[:-1], text=True)))
    shift = document << np.int64(32)
    a, b = merged(starts + shift, ends + shift)
    owners, mask = owners[np.searchsorted(document, a >> 32)], np.int64((1 << 32) - 1)
    return owners, (a & mask).astype(np.int32), (b & mask).astype(np.int32)


def _packed(spans: Spans) -> list[tuple[int, int, bytes]]:
    """A row for all the spans, which any range may pass on."""
    owners, a, b = spans
    return [(int(owners.columns[2][0]) & 0x7FFFFFFF, 2, pack(*owners.columns, a, b))] if len(a) else []


def _unpacked(blobs: list[bytes]) -> Iterator[Spans]:
    *owner, a, b = unpack(blobs, *SPAN)
    yield Owners(*owner), a, b


def equal_rows(character: Callable[[np.ndarray, int], np.ndarray], n: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that equal another in all depth characters, and a number for each group of equal ones, in the rows' order.

    Multikey quicksort: a pivot parts a segment by one character, and what equals the pivot goes on with the next. Small segments are
    sorted character by character; rows that are alone are let go."""
    rows_out, group_out, groups = [], [], 0
    stack = [(np.arange(n), 0)]
    while stack:
        rows, d = stack.pop()
        if d < depth and len(rows) > SMALL:
            x = character(rows, d)
            pivot = np.sort(x[:: max(1, len(x) // 9)])[4]
            stack += [(rows[x > pivot], d), (rows[x == pivot], d + 1), (rows[x < pivot], d)]
            continue
        group = np.zeros(len(rows), np.int64)
        for c in range(d, depth):
            if len(rows) < 2:
                break
            x = character(rows, c)
            order = np.lexsort((x, group))
            rows, group, x = rows[order], group[order], x[order]
            group = np.cumsum(np.append(True, (group[1:] != group[:-1]) | (x[1:] != x[:-1])))
            many = np.bincount(group)[group] > 1
            rows, group = rows[many], group[many]
        if len(rows) > 1:
            group = np.unique(group, return_inverse=True)[1]
            rows_out.append(rows)
            group_out.append(group + groups)
            groups += int(group[-1]) + 1 if len(group) else 0
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows_out), np.concatenate(group_out)) if rows_out else (none, none)


def characters(rows: np.ndarray, begin: np.ndarray | int, length: int, row: np.ndarray | None = None) -> Callable[[np.ndarray, int], np.ndarray]:
    """Eight bytes as a character, the first byte most significant, of texts of length bytes that begin at a place of a row; the last character may overlap the one before."""
    flat = np.ascontiguousarray(rows).reshape(-1)
    words = np.ndarray((max(len(flat) - 7, 0),), ">u8", flat.data, strides=(1,)) if len(flat) > 7 else np.zeros(0, ">u8")
    base = (np.arange(len(rows)) if row is None else row) * rows.shape[1] + begin
    return lambda at, c: words[base[at] + min(8 * c, length - 8)].astype(np.uint64)


def repeated_suffixes(blobs: list[bytes]) -> Iterator[Spans]:
    """Spans of the strings of a range's suffixes that also start earlier."""
    *owner, p, left, span, around = unpack(blobs, *SUFFIX)
    owners = Owners(*owner)
    rows, gram = equal_rows(characters(around, REACH, GRAM), len(p), GRAM // 8)
    if not len(rows):
        return
    owners, p, left, span, around = owners[rows], p[rows], left[rows], span[rows], around[rows]
    factors = mixed(np.arange(1, AROUND // 8 + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
    whole = mixed((np.ascontiguousarray(around).view(np.uint64) * factors).sum(axis=1, dtype=np.uint64))
    order, start, after, again = firsts(owners, p, gram, left, span, whole)
    same = (around[order] == around[order[start]]).all(axis=1)
    rest, own = order[after & same], order[~(after & same) & ~again]
    a = p[rest] - left[rest]
    yield _spans(owners[rest], a, a + span[rest] + LENGTH)
    own = own[np.bincount(gram[own], minlength=1)[gram[own]] > 1]
    # the strings of whole grams at a time, so that those of one meet
    own = own[np.argsort(gram[own], kind="stable")]
    ends = np.append(np.flatnonzero(np.diff(gram[own])) + 1, len(own))
    total = np.append(0, np.cumsum(span[own].astype(np.int64) + 1))
    done = 0
    while done < len(own):
        fit = np.searchsorted(total[ends], total[done] + STRINGS, "right") - 1
        end = int(ends[max(fit, np.searchsorted(ends, done, "right"))])
        some = own[done:end]
        done = end
        row, offset = strings_at(span[some])
        at = some[row]
        begin = REACH - left[at].astype(np.int64) + offset
        yield _repeated(owners[at], (p[at] - left[at] + offset).astype(np.int32), characters(around[some], begin, LENGTH, row))


def repeated_strings(blobs: list[bytes]) -> Iterator[Spans]:
    """Spans of a range's strings that also start earlier."""
    *owner, start, strings = unpack(blobs, *STRING)
    yield _repeated(Owners(*owner), start, characters(strings, 0, LENGTH))


def _repeated(owners: Owners, start: np.ndarray, character: Callable[[np.ndarray, int], np.ndarray]) -> Spans:
    rows, group = equal_rows(character, len(start), -(-LENGTH // 8))
    order, _, after, _ = firsts(owners[rows], start[rows], group)
    again = rows[order[after]]
    return _spans(owners[again], start[again], start[again] + LENGTH)
