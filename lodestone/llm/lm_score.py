"""Log-probability of texts under a hashed maximum-entropy model with a class-factored softmax.

P(word | context) = P(class | context) * P(word | class, context). The first softmax is over CLASSES classes; a class is parted into
sub-classes by softmaxes of the same width until a word is alone, so that the product over its path is a softmax over all words of
the class. Every softmax on the path, not the first alone, has the hashed features of the context beside its bias: the last word, the last two words, and the word before the
last (skip). Each feature of each softmax is a row of CLASSES weights.

Head words, the most frequent and HEAD at most, are dealt to HEAD_CLASSES classes by rank so that classes have about equal mass, and parted further in the same way.
Other words, known or not, have one of TAIL_CLASSES classes by their hash and within it their discounted count; what discounts free is the share of unknown words, which
count as one outcome as in the base score. The head is broadcast; counts of other words, as many as the corpus has, are joined by shuffle, a row for each document and word.

Training is distributed: every task sums the gradient of the log-likelihood of all training texts at the start, where the weights are 0 and biases give each word
its share: for each row the observed less the expected counts of its classes. The step divides it by the curvature as iterative scaling does, w = rate * log(1 + g / (p * (n + PRIOR))), with n the
row's count and p the bias's share, so that rare contexts move little. Counts are whole numbers, so that scores do not depend on how
texts are dealt to tasks.

Rows are shared out to softmaxes by their mass. Their number grows with the training tokens up to ROWS, as the weights are broadcast; beyond it more contexts share a row.

Defined cases: null and empty texts have the end token alone; a null id counts as the text "" in the hold-out rule; repeated rows are
learned from and scored each; words of equal counts are ranked by their bytes; an empty table gives no rows; with no training documents weights stay 0 and every word is unknown; texts of any
length are read whole; kept columns with names of the result's columns give way to them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, table, words_of

HEAD_CLASSES, TAIL_CLASSES = 24, 8
CLASSES = HEAD_CLASSES + TAIL_CLASSES
HEAD = 1 << 17
#: The head is cut between words of which one has 2 ** (1 / LEVELS) times the count of the other.
LEVELS = 16
#: Rows of weights: one for so many training tokens, between these.
TOKENS_A_ROW, ROWS = 16, (1 << 12, 1 << 18)
#: Rates of the features: the last word, the last two, the word before the last. A row's count is taken with so many expected ones.
RATES, PRIOR = (0.5, 0.3, 0.5), 20.0
#: What a token counts in the sums; a part of it goes to the unknown words.
UNIT = 64
#: Rows of weights that are summed up together.
BLOCK = 4096
CHUNK = 2048
#: Bytes of texts whose tokens a task holds at a time, and one text more.
GROUP = 1 << 20
#: Steps of a path after which words are parted by number, so that no path is long.
EVEN = 6
END = b"\n"  # no word holds a line feed
#: Words that a task counts before it passes its counts on.
HELD_WORDS = 400_000
#: A word beyond the head that more documents of a task hold, and more than one in a hundred, is joined apart.
OFTEN = 50


def held_out(key) -> object:
    """crc32 of the id as text, modulo 5, is 1."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 1


def tokens(text: str | None) -> list[bytes]:
    return [*words_of(text), END]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """tokens() of many texts but for the ends, and their owners."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat, owner = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(some).cast(pa.binary()), owner.filter(some).to_numpy()


def groups(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The texts in slices of about GROUP bytes, and where each begins."""
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    cuts = np.append(np.flatnonzero(np.diff(size // GROUP, prepend=-1)), len(texts))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield a, texts.slice(a, b - a)


def count_words(df: DataFrame) -> DataFrame:
    """w, c: the count of every token in the texts (column t) of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            out = pa.concat_tables(held).group_by("w", use_threads=False).aggregate([("c", "sum")])
            return out.select(["w", "c_sum"]).rename_columns(["w", "c"])

        for b in batches:
            for _, texts in groups(b.column("t")):
                seen = split(texts)[0].value_counts()
                held.append(pa.table({"w": seen.field("values"), "c": seen.field("counts")}))
                held.append(pa.table({"w": pa.array([END], pa.binary()), "c": pa.array([len(texts)], pa.int64())}))
                if sum(map(len, held)) > 2 * HELD_WORDS:
                    held = [summed()]
                    if len(held[0]) > HELD_WORDS:
                        yield from held.pop().to_batches()
        if held:
            yield from summed().to_batches()

    return df.mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def tail_class(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word, 7) % TAIL_CLASSES


class Model:
    """What is broadcast: the head with its paths, and sums over the vocabulary."""

    def __init__(self, head: list[tuple[bytes, int]], n: int, v: int, singles: int, doubles: int, tail: dict[int, tuple[int, int]]):
        self.n, self.v = n, v
        self.discount = d = min(0.9, max(0.1, singles / (singles + 2 * doubles))) if singles + doubles else 0.5
        counts = np.array([c for _, c in head], float)
        # the head's discounts, and one count, go to the unknown words of the tail classes in equal parts
        self.free = (d * len(head) + 1) / TAIL_CLASSES
        self.types = np.array([tail.get(k, (0, 0))[1] for k in range(TAIL_CLASSES)], float)
        self.tail_mass = np.array([tail.get(k, (0, 0))[0] + self.free for k in range(TAIL_CLASSES)])
        self.head = {w: i for i, (w, _) in enumerate(head)}
        #: For each head word, then each tail class: the softmax at each step of the path, -1 beyond its end, and the class taken there.
        self.node, self.taken, mass = paths(counts - d, self.tail_mass)
        total = mass.sum(axis=1, keepdims=True)
        self.share = mass / np.where(total > 0, total, 1)
        self.bias = np.log(np.maximum(self.share, 1e-30)).astype(np.float32)
        base = np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))
        self.base = np.append(base, np.zeros(TAIL_CLASSES))
        lost = np.append(np.rint(UNIT * d / np.maximum(counts, 1)), np.zeros(TAIL_CLASSES)).astype(np.int64)
        self.lost = np.minimum(lost, UNIT)
        wanted = min(ROWS[1], max(ROWS[0], n // TOKENS_A_ROW)) / len(RATES)
        self.size = np.maximum(1, np.rint(wanted * total[:, 0] / max(total.sum(), 1e-9))).astype(np.uint64)
        self.start = (np.cumsum(self.size) - self.size).astype(np.int64)
        self.rows = int(self.size.sum())  # for each feature

    def tail_within(self, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        """log10 P(word | class) of words of tail class k with training count c."""
        free = self.discount * self.types[k] + self.free
        return np.log10(np.where(c > 0, np.maximum(c - self.discount, 1e-9), free) / self.tail_mass[k])

    def row(self, j: int, feature: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The row of a hashed context (feature j) for a softmax."""
        return next(self.each_row([feature], node)) + j * self.rows

    def each_row(self, features: list[np.ndarray], node: np.ndarray) -> Iterator[np.ndarray]:
        """row() of each feature."""
        own, size, start = node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), self.size[node], self.start[node]
        for j, feature in enumerate(features):
            x = feature ^ own
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x >>= np.uint64(32)
            x *= size
            x >>= np.uint64(32)
            row = x.view(np.int64)
            row += start
            row += j * self.rows
            yield row

    def node_of_rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size.astype(np.int64))


def parted(mass: np.ndarray, classes: int, depth: int) -> np.ndarray:
    """A class for each word: runs of about equal mass, far down of equal length, or each word alone if they are so few."""
    if len(mass) <= classes:
        return np.arange(len(mass))
    if depth >= EVEN:
        return np.arange(len(mass)) * classes // len(mass)
    share = (np.cumsum(mass) - mass) / max(mass.sum(), 1e-9)
    return np.minimum((share * classes).astype(int), classes - 1)


def paths(mass: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Softmaxes and classes on the way to each word and tail class, and the masses of each softmax's classes."""
    steps: list[tuple[int, np.ndarray, int, np.ndarray]] = []
    masses: list[np.ndarray] = []
    stack = [(np.arange(len(mass)), 0)]
    while stack:
        words, depth = stack.pop()
        own = parted(mass[words], CLASSES if depth else HEAD_CLASSES, depth)
        sums = np.bincount(own, mass[words], minlength=CLASSES) if len(words) else np.zeros(CLASSES)
        if not depth:
            sums[HEAD_CLASSES:] = tail
        steps.append((depth, words, len(masses), own))
        masses.append(sums)
        cuts = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own))
        stack += [(words[a:b], depth + 1) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b - a > 1]
    deep = 1 + max(depth for depth, *_ in steps)
    node = np.full((len(mass) + len(tail), deep), -1, np.int32)
    taken = np.zeros((len(mass) + len(tail), deep), np.int8)
    for depth, words, i, own in steps:
        node[words, depth], taken[words, depth] = i, own
    node[len(mass) :, 0], taken[len(mass) :, 0] = 0, HEAD_CLASSES + np.arange(len(tail))
    return node, taken, np.array(masses)


class Words(dict):
    """Word to its place in the head, or beyond it its tail class, packed with its 32-bit hash; keeps words of the head alone."""

    def __init__(self, head: dict[bytes, int]):
        super().__init__()
        self.head = head

    def __missing__(self, word: bytes) -> int:
        place, digest = self.head.get(word, -1), xxhash.xxh32_intdigest
        if place < 0:
            return (digest(word) << 24) | (len(self.head) + digest(word, 7) % TAIL_CLASSES)
        self[word] = packed = (digest(word) << 24) | place
        return packed


def encode(texts: list[str | None] | pa.Array, words: Words) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Codes, context features (three hashes for each token) and owners of all tokens of the texts, and the tokens. Each distinct word is looked up once."""
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.string())
    flat, owner = split(texts)
    flat = flat.dictionary_encode()
    sizes = np.bincount(owner, minlength=len(texts)) + 1
    unique = np.empty(len(flat.dictionary) + 1, object)
    unique[:-1], unique[-1] = flat.dictionary.to_numpy(zero_copy_only=False), END
    at = np.full(len(flat) + len(texts), len(unique) - 1)
    at[np.arange(len(flat)) + owner] = flat.indices.to_numpy()
    packed = np.fromiter(map(words.__getitem__, unique.tolist()), np.uint64, len(unique))[at]
    code = (packed & np.uint64(0xFFFFFF)).astype(np.int64)
    h = (packed >> np.uint64(24)) + np.uint64(3)
    start = np.cumsum(sizes) - sizes
    one = np.roll(h, 1)
    two = np.roll(h, 2)
    one[start] = 1
    two[start] = 2
    two[(start + 1)[sizes > 1]] = 2
    mix = lambda x: (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return code, [mix(one * np.uint64(0x9E3779B97F4A7C15)), mix(one * np.uint64(0xC2B2AE3D27D4EB4F) ^ two), mix(two * np.uint64(0xD6E8FEB86659FD93))], np.repeat(np.arange(len(texts)), sizes), unique[at]


def by_word(code: np.ndarray, f: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """An order of the tokens by word, and codes and features in it: words near to each other share softmaxes, whose rows then stay in the cache."""
    order = np.argsort(code)
    return order, code[order], [x[order] for x in f]


def steps(model: Model, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens, their softmax and the class that they take there, step by step."""
    at = np.arange(len(code))
    for depth in range(model.node.shape[1]):
        node = model.node[code[at], depth]
        at, node = at[node >= 0], node[node >= 0]
        if not len(at):
            return
        yield at, node, model.taken[code[at], depth]


def aligned(weights: np.ndarray) -> np.ndarray:
    """A copy whose rows begin at cache lines."""
    room = np.empty(weights.size + 16, np.float32)
    skip = -room.ctypes.data // 4 % 16
    out = room[skip : skip + weights.size].reshape(weights.shape)
    out[:] = weights
    return out


class Scratch:
    """Memory for the rows of some tokens, used again and again."""

    def __init__(self, n: int = CHUNK):
        self.x, self.w = (np.empty((n, CLASSES), np.float32) for _ in range(2))
        self.ones = np.ones(CLASSES, np.float32)


def log_words(model: Model, weights: np.ndarray, code: np.ndarray, f: list[np.ndarray], scratch: Scratch | None = None) -> np.ndarray:
    """Natural log of P(head word or tail class | context) of as many tokens as scratch has room for."""
    scratch = scratch or Scratch(len(code))
    out = np.zeros(len(code))
    for at, node, taken in steps(model, code):
        x, w = scratch.x[: len(at)], scratch.w[: len(at)]
        np.take(model.bias, node, axis=0, out=x, mode="clip")
        for row in model.each_row(f if len(at) == len(code) else [y[at] for y in f], node):
            np.take(weights, row, axis=0, out=w, mode="clip")
            x += w
        out[at] += x[np.arange(len(at)), taken]
        out[at] -= np.log(np.exp(x, out=x) @ scratch.ones)
    return out


def observe(model: Model, code: np.ndarray, f: list[np.ndarray], sums: np.ndarray) -> None:
    """Adds the classes taken in each row, in parts of UNIT.

    A word's own count would not know it but for the rest of its occurrences, so the share that its discount has of it counts for an unknown word."""
    for depth, (at, node, taken) in enumerate(steps(model, code)):
        lost = model.lost[code[at]]
        some = np.flatnonzero(lost) if depth == 0 else np.zeros(0, np.int64)
        for row in model.each_row([x[at] for x in f], node):
            row *= CLASSES
            np.add.at(sums, row + taken, UNIT - lost)
            if len(some):
                np.add.at(sums, row[some] + HEAD_CLASSES + code[at][some] % TAIL_CLASSES, lost[some])


def train(df: DataFrame, sent) -> np.ndarray:
    """Weights, a row of CLASSES for each row of each feature, from the texts (column t) of df.

    Each task sums over its texts; sums are added up in blocks of rows by as many tasks, which also take the step; the driver gets the weights alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        words, sums, seen = Words(model.head), np.zeros(len(RATES) * model.rows * CLASSES, np.int64), False
        for b in batches:
            for _, texts in groups(b.column("t")):
                code, f, *_ = encode(texts, words)
                _, code, f = by_word(code, f)
                seen = True
                for k in range(0, len(code), CHUNK):
                    observe(model, code[k : k + CHUNK], [x[k : k + CHUNK] for x in f], sums)
        if seen:
            size, pack = BLOCK * CLASSES, zstandard.ZstdCompressor(level=1)
            for k in range(0, len(sums), size):
                part = sums[k : k + size]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k // size], pa.int32()), pa.array([pack.compress(part.tobytes())], pa.binary())], ["block", "z"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        share = model.share[model.node_of_rows()]
        held: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for block, z in zip(b.column("block").to_pylist(), b.column("z"), strict=True):
                part = np.frombuffer(unpack.decompress(z.as_py()), np.int64)
                held[block] = held[block] + part if block in held else part
        for block, sums in held.items():
            observed = sums.reshape(-1, CLASSES) / UNIT
            row = block * BLOCK + np.arange(len(observed))
            p, rate = share[row % model.rows], np.array(RATES)[row // model.rows]
            n = observed.sum(axis=1, keepdims=True)
            gradient = observed - n * p
            scaled = np.maximum(gradient / np.where(p > 0, p * (n + PRIOR), 1.0), -1 + 1e-9)
            w = np.where(p > 0, rate[:, None] * np.log1p(scaled), 0.0).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([w.tobytes()], pa.binary())], ["block", "w"])

    parts = df.mapInArrow(run, "block int, z binary").repartition("block")
    weights = np.zeros((len(RATES) * sent.value.rows, CLASSES), np.float32)
    for row in parts.mapInArrow(step, "block int, w binary").collect():  # ROWS rows of CLASSES numbers at most
        part = np.frombuffer(row["w"], np.float32).reshape(-1, CLASSES)
        weights[row["block"] * BLOCK : row["block"] * BLOCK + len(part)] = part
    return weights


def fit(df: DataFrame, counts: DataFrame):
    """Broadcasts of the model and its weights. df: training texts in column t; counts: table() of their tokens."""
    spark = df.sparkSession
    sums = counts.agg(F.sum("c").alias("n"), F.count("w").alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("a"), F.sum((F.col("c") == 2).cast("long")).alias("b")).first()
    level = F.floor(F.log2("c") * LEVELS).cast("int")
    words, lowest = 0, 0
    for x in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # 64 * LEVELS rows at most
        if words + x["count"] > HEAD:
            lowest = x["level"] + 1
            break
        words += x["count"]
    head = counts.filter(level >= lowest).toPandas()  # HEAD rows at most
    words = sorted(((bytes(w), int(c)) for w, c in zip(head.w, head.c, strict=True)), key=lambda x: (-x[1], x[0]))
    tail: dict[int, tuple[int, int]] = {}
    if lowest:
        beyond = counts.filter(level < lowest)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mass, types = np.zeros(TAIL_CLASSES, np.int64), np.zeros(TAIL_CLASSES, np.int64)
            for b in batches:
                k = np.array([tail_class(w) for w in b.column("w").to_pylist()], np.int64)
                np.add.at(mass, k, b.column("c").to_numpy())
                np.add.at(types, k, 1)
            yield pa.RecordBatch.from_arrays([pa.array(range(TAIL_CLASSES), pa.int32()), pa.array(mass), pa.array(types)], ["k", "m", "v"])

        found = beyond.mapInArrow(run, "k int, m long, v long").groupBy("k").agg(F.sum("m").alias("m"), F.sum("v").alias("v")).collect()
        tail = {x["k"]: (x["m"], x["v"]) for x in found}
    model = Model(words, sums["n"] or 0, sums["v"] or 0, sums["a"] or 0, sums["b"] or 0, tail)
    sent = spark.sparkContext.broadcast(model)
    return sent, spark.sparkContext.broadcast(train(df, sent))


def _lists(owner: np.ndarray, words: pa.Array, n: np.ndarray, texts: int) -> pa.ListArray:
    """Words and numbers of each text; owners ascend."""
    pairs = pa.StructArray.from_arrays([words, pa.array(n, pa.int32())], ["w", "n"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(owner, minlength=texts))).astype(np.int32)), pairs)


def bags(owner: np.ndarray, words: np.ndarray, texts: int, often: Counter, limit: int) -> list[pa.ListArray]:
    """Distinct words of each text with their numbers: those which at most limit texts of the task hold, and the others. often: the texts by word, to which these are added."""
    flat = pa.array(words, pa.binary()).dictionary_encode()
    unique = flat.dictionary
    pair, n = np.unique(owner * max(len(unique), 1) + flat.indices.to_numpy(), return_counts=True)
    owner, at = np.divmod(pair, max(len(unique), 1))
    names = unique.to_pylist()
    often.update(dict(zip(names, np.bincount(at, minlength=len(names)).tolist(), strict=True)))
    hot = np.fromiter((often[w] > limit for w in names), bool, len(names))[at]
    return [_lists(owner[x], unique.take(pa.array(at[x])), n[x], texts) for x in (~hot, hot)]


SCORED = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, and held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    keep = [c for c in keep if c not in SCORED]
    df = docs.select(F.struct(*(keep or [F.lit(None).alias("none")])).alias("row"), held_out(F.col(key)).alias("h"), F.col(text).alias("t"))
    training = df.filter(~F.col("h")).select("t")
    counts = table(count_words(training), "words")
    sent, weights = fit(training, counts)
    kind = dict(df.dtypes)["row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, w = sent.value, aligned(weights.value)
        words, head, scratch = Words(model.head), len(model.head), Scratch()
        seen, often = 0, Counter()
        for b in batches:
            for i, part in groups(b.column("t")):
                code, f, owner, flat = encode(part, words)
                order, sorted_code, f = by_word(code, f)
                logs = np.empty(len(code))
                for j in range(0, len(code), CHUNK):
                    logs[order[j : j + CHUNK]] = log_words(model, w, sorted_code[j : j + CHUNK], [x[j : j + CHUNK] for x in f], scratch)
                known = code < head
                logs /= np.log(10)
                sums = lambda x, m=len(part), o=owner: np.bincount(o, x, minlength=m)
                seen += len(part)
                lists = bags(owner[~known], flat[~known], len(part), often, max(OFTEN, seen // 100))
                if len(often) > HELD_WORDS:
                    often.clear()
                held = b.slice(i, len(part))
                yield pa.RecordBatch.from_arrays(
                    [held.column("row"), held.column("h"), pa.array(sums(np.ones(len(code))).astype(np.int64)), pa.array(sums(known).astype(np.int64)),
                     pa.array(sums(model.base[code])), pa.array(sums(logs)), *lists],
                    ["row", "h", "n", "known", "base", "score", "rest", "hot"],
                )

    pairs = "array<struct<w:binary,n:int>>"
    parts = table(df.mapInArrow(run, f"row {kind}, h boolean, n long, known long, base double, score double, rest {pairs}, hot {pairs}").withColumn("id", F.monotonically_increasing_id()), "scored")
    model = sent.value
    each = lambda c: parts.select("id", F.explode(c).alias("x")).select("id", "x.w", "x.n")
    rest = each("rest").join(counts, "w", "left")
    if each("hot").limit(1).count():
        # a word of very many documents meets its count by itself, not in one task
        words = table(each("hot").select("w").distinct(), "often")
        rest = rest.unionByName(lookup_join(each("hot"), table(lookup_join(words, counts, "w"), "known"), "w"))
    rest = rest.select("id", "w", "n", F.coalesce("c", F.lit(0)).alias("c"))

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            c, n = b.column("c").to_numpy(), b.column("n").to_numpy()
            k = np.array([tail_class(w) for w in b.column("w").to_pylist()], np.int64)
            base = n * np.log10((c + 0.5) / (model.n + 0.5 * (model.v + 1)))
            ids, at = np.unique(b.column("id").to_numpy(), return_inverse=True)
            sums = lambda x: np.bincount(at, x, minlength=len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums(n * (c > 0)).astype(np.int64)), pa.array(sums(base)), pa.array(sums(n * model.tail_within(c, k)))], ["id", "known", "base", "score"])

    added = rest.mapInArrow(tails, "id long, known long, base double, score double").groupBy("id")
    added = added.agg(*(F.sum(x).alias(f"{x}_2") for x in ("known", "base", "score")))
    zero = lambda x: F.coalesce(F.col(f"{x}_2"), F.lit(0))
    return parts.drop("rest", "hot").join(added, "id", "left").select(
        *(F.col(f"row.{c}") for c in keep),
        F.col("h").alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + zero("known")).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base")).alias("base_score"),
        (F.col("score") + zero("score")).alias("score"),
    )
