"""Line dedup, divergence audit and vector codes against plain forms of their contracts."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import divergence, line_dedup, vector_codes
from lodestone.llm.queries import QUERIES

from .cases import documents, frame, row

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
A, B, C = "This line stands in many documents", "a second line that is shared widely", "ünïcödé line of many documents 漢字"


# Line dedup.


def plain_lines(rows):
    """(id, n_lines, n_dropped, kept) of each (id, text)."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(list)
    for i, (_, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                held[k].append(i)
    rank = lambda i: -math.inf if rows[i][0] is None else rows[i][0]
    keeper = {k: max(map(rank, at)) for k, at in held.items() if len(at) >= 3}
    out = []
    for i, (id_, t) in enumerate(rows):
        lines = (t or "").split("\n")
        kept = [x for x in lines if rank(i) >= keeper.get(key(x), -math.inf)]
        out.append((id_, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def got_lines(docs, **how):
    return [tuple(r) for r in line_dedup.dedup(docs, **how).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()]


def order(rows):
    return sorted(rows, key=repr)


def line_cases():
    shared = [row(20 + i, f"own words of document {i}\n  {A.upper()} \n{A}\n{B if i % 2 else 'short'}\n\n{C}") for i in range(9)]
    return [
        *documents(), *shared,
        row(None, A), row(None, f"{B}\nx"), row(None, f"{B}\nx"),
        row(90, "\n".join([A] * 500)), row(91, A), row(91, A),  # repeated rows of the largest id that holds it
        row(92, "nineteen characters"), row(93, "nineteen characters"), row(94, "nineteen characters"),
        row(95, "exactly twenty chars"), row(96, "\x0bexactly twenty CHARS\r"), row(97, "exactly twenty chars"),
        row(98, "only two documents have this line"), row(99, "only two documents have this line"),
        row(None, "null ids alone hold this line here"), row(None, "null ids alone hold this line here"), row(None, "null ids alone hold this line here"),
    ]


@pytest.mark.parametrize("batches", [1, 7])
def test_line_dedup(spark, batches):
    rows = line_cases()
    assert order(got_lines(frame(spark, rows), batches=batches)) == order(plain_lines([(r[0], r[1]) for r in rows]))


def test_line_dedup_keeps_all_columns_of_its_rows(spark):
    docs = frame(spark, line_cases())
    assert line_dedup.dedup(docs).select("row.*").columns == docs.columns


def test_line_dedup_of_nothing(spark):
    assert got_lines(frame(spark, [])) == []
    assert got_lines(frame(spark, [row(1, None)])) == [(1, 1, 0, "")]


def test_lines_of_one_document_do_not_count_thrice(spark):
    assert got_lines(frame(spark, [row(1, f"{A}\n{A}\n{A}"), row(2, A)])) != []
    assert {r[2] for r in got_lines(frame(spark, [row(1, f"{A}\n{A}\n{A}"), row(2, A)]))} == {0}


def test_line_dedup_smallest_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert sorted(got_lines(docs)) == sorted(plain_lines([tuple(r) for r in docs.collect()]))


def hashes(spark, rows):
    return spark.createDataFrame(rows, "k string, id long").select(F.unhex(F.md5("k")).alias("h"), "id")


def test_runs_are_levelled_and_leave_out_what_is_settled(spark):
    runs = line_dedup.LineRuns(spark, 4)
    runs.add(hashes(spark, [("a", i) for i in range(10, 15)]))
    runs.add(hashes(spark, [("a", 3), ("b", 3)]))  # a is settled, with a larger id
    assert [len(x) for x in runs.levels] == [2]
    assert runs.runs()[1].count() == 1
    runs.add(hashes(spark, [("a", 99), ("b", 5)]))  # a larger id counts
    assert [len(x) for x in runs.levels] == [0, 1]  # compacted
    found = {r["keeper"]: r["docs"] for r in runs.merged().collect()}
    assert found == {99: 6, 5: 2}
    for i in range(6):
        runs.add(hashes(spark, [("b", i)]))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert {r["keeper"] for r in runs.merged().filter("docs >= 3").collect()} == {99, 5}
    runs.drop()
    assert runs.runs() == []


def test_runs_are_joined_without_a_shuffle(spark):
    runs = line_dedup.LineRuns(spark, 4)
    for i in range(2):
        runs.add(hashes(spark, [(str(j), i) for j in range(50)]))
    plan = runs.merged()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.drop()


# Divergence audit.


def plain_audit(rows):
    """(lang, source, part, item, value, rank) from (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER)) for _, _, t in rows]
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for (lang, source, _), found in zip(rows, terms, strict=True):
        held[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang in {r[0] for r in rows}:
        kept = [t for t, n in held[lang].items() if n >= 30]
        own = sorted({s for x, s in counts if x == lang})
        whole = sum((counts[lang, s] for s in own), Counter())
        total = lambda c: sum(c[t] for t in kept) + 5 * len(kept)  # noqa: E731, B023
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // total(c) for t in kept}  # noqa: E731, B023
        p, q = {s: share(counts[lang, s]) for s in own}, share(whole)
        for s in own:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            more = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", more)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found) if part == "pair" or i < 50]
    return sorted(out)


def audit_cases():
    words = [f"term{chr(97 + i)}" for i in range(26)] + ["Ünïcödé", "漢字", "🙂x", "naïve"]
    rows = []
    for i in range(120):
        text = " ".join(words[(i * j) % (7 + i % 20)] for j in range(1, 40)) + "9" * (i % 3) + "_"
        rows.append(row(i, text if i % 17 else text.upper(), "abc"[i % 3]))
    rows += [row(200, None, "silent"), row(201, "", None), row(202, "12 34 !!", "b")]
    rows += [(300 + i, " ".join(words), lang, s, 1, "x", 1, "y", 2, 3, "z", "m", 4, True) for i, (lang, s) in enumerate([(None, "a"), (None, None), ("", ""), ("de", "a"), ("de", "b")])]
    rows += [(400 + i, "gleiche wörter überall", "fr", f"s{i % 4}", 1, "x", 1, "y", 2, 3, "z", "m", 4, True) for i in range(32)]  # ties of all values
    return [*documents(), *rows, rows[5]]


@pytest.mark.parametrize("broadcast", [True, False])
def test_divergence(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(divergence, "small", lambda df: False)
    rows = audit_cases()
    found = divergence.audit(frame(spark, rows))
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == plain_audit([(r[2], r[3], r[1]) for r in rows])


def test_divergence_of_nothing(spark):
    assert divergence.audit(frame(spark, [])).collect() == []


def test_shares_are_exact_beyond_64_bits(spark):
    n = 10**12 + 7
    df = spark.createDataFrame([(n, 3 * n, 11)], "c long, t long, v long")
    assert df.select(divergence._share(F.col("c"), F.col("t"), F.col("v"))).first()[0] == 1 + 10**9 * (n + 5) // (3 * n + 55)


# Vector codes.

VECTORS = "vec_id long, embedding array<float>, label int, part int, entry int, v string"


def plain_codes(rows):
    """(vec_id, code, error, label_error, codebooks_sha256) from (vec_id, embedding, label); ids differ."""
    rows = sorted((i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v))
    parts = [[[math.floor(4096 * float(np.float32(x))) for x in v[p * len(v) // 8 : (p + 1) * len(v) // 8]] for p in range(8)] for _, v, _ in rows]
    books = [[list(x[p]) for x in parts[:16]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(6):
        for p, book in enumerate(books):
            own = defaultdict(list)
            for x in parts:
                own[nearest(x[p], book)].append(x[p])
            for e, xs in own.items():
                book[e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out, sums = [], Counter()
    for (i, _, label), x in zip(rows, parts, strict=True):
        code = [nearest(x[p], books[p]) for p in range(8)]
        error = sum(far(x[p], books[p][e]) for p, e in enumerate(code))
        sums[label] += error
        out.append((i, "".join(f"{e:02x}" for e in code), error, label))
    return sorted((i, code, error, sums[label], digest) for i, code, error, label in out)


def vectors(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x = np.round(rng.normal(size=dim), 2) if i % 3 else np.full(dim, 0.25)  # a third are alike
        out.append((3 * i + 5, [float(np.float32(c)) for c in x], None if i % 7 == 0 else i % 4))
    return out


def codes(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], VECTORS)
    return sorted(tuple(r) for r in vector_codes.digest(df.repartition(3)).collect())


@pytest.mark.parametrize("chunk, leaf", [(8192, 32), (64, 4), (50, 1)])
def test_vector_codes(spark, monkeypatch, chunk, leaf):
    # tasks import the module anew; only the trees' sizes are set here, and both are read where trees are built
    rows = vectors(400)
    bad = [(1, None, 1), (2, [], 1), (3, [None, *rows[0][1][1:]], 1), (4, [math.nan, *rows[0][1][1:]], 1), (6, [math.inf, *rows[0][1][1:]], 1)]
    assert codes(spark, rows + bad) == plain_codes(rows + bad)
    points = np.array([np.floor(np.array(r[1]) * 4096) for r in rows], np.int32)[:, :8]
    monkeypatch.setattr(vector_codes, "LEAF", leaf)
    book = points[:16].astype(np.int64)
    want = np.square(points[:chunk, None].astype(np.int64) - book[None]).sum(axis=2).argmin(axis=1)
    place, low, high, sums = vector_codes.build(points[:chunk])
    counts, totals, found = vector_codes.assign(book, points[:chunk][place], low, high, sums)
    assert (found == want[place]).all()
    assert (counts == np.bincount(want, minlength=16)).all()
    assert all((totals[e] == points[:chunk][want == e].astype(np.int64).sum(axis=0)).all() for e in range(16))


def test_whole_subtrees_are_assigned_at_once():
    rng = np.random.default_rng(3)
    side = rng.integers(0, 2, 4096)
    points = (np.array([-4000, 4000])[side][:, None] + rng.integers(-50, 50, (4096, 4))).astype(np.int32)
    points = np.concatenate([points[side == 0][:2000], points[side == 1][:2000]])
    place, low, high, sums = vector_codes.build(points)
    book = np.array([[-4000] * 4, [4000] * 4])
    counts, totals, _ = vector_codes.assign(book, np.zeros_like(points), low, high, sums)  # the points themselves are not looked at
    assert counts.tolist() == [2000, 2000]
    assert (totals == [points[:2000].sum(axis=0), points[2000:].sum(axis=0)]).all()


def test_ties_go_to_the_lower_entry():
    points = np.zeros((100, 2), np.int32)
    place, low, high, sums = vector_codes.build(points)
    book = np.array([[5, 5], [3, 0], [0, 3], [-3, 0], [3, 0]])
    counts, _, labels = vector_codes.assign(book, points[place], low, high, sums)
    assert counts.tolist() == [0, 100, 0, 0, 0] and set(labels) == {1}


def test_large_components_are_exact():
    rng = np.random.default_rng(5)
    points = rng.integers(-(1 << 24), 1 << 24, (300, 8)).astype(np.int32)
    book = points[:16].astype(np.int64)
    want = np.square(points[:, None].astype(np.int64) - book[None]).sum(axis=2).argmin(axis=1)
    place, low, high, sums = vector_codes.build(points)
    assert (vector_codes.assign(book, points[place], low, high, sums)[2] == want[place]).all()


def test_vector_codes_of_few_rows(spark):
    assert codes(spark, []) == []
    assert codes(spark, [(1, None, 1)]) == []
    few = vectors(5)
    assert codes(spark, few) == plain_codes(few)


def test_vector_codes_of_repeated_ids_and_other_lengths(spark):
    rows = [*vectors(40), *vectors(40), (None, vectors(1)[0][1], None), (7, [0.5] * 8, 1), (9, [5000.0] * 16, 1)]
    found = vector_codes.digest(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], VECTORS)).collect()
    assert len(found) == 81 and len({r["codebooks_sha256"] for r in found}) == 1
    odd = [(i, v[:13], label) for i, v, label in vectors(30)]
    filled = [(i, [*v[:13], 0.0, 0.0, 0.0], label) for i, v, label in vectors(30)]
    assert codes(spark, odd) == codes(spark, filled)


def test_vector_codes_do_not_depend_on_the_deal(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = plain_codes([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])
    for n in (1, 5):
        assert sorted(tuple(r) for r in vector_codes.digest(df.repartition(n)).collect()) == want


def test_queries_of_lines_and_terms(spark, sf):
    assert QUERIES["op11_line_dedup"](spark, sf).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain_audit([(r["lang"], r["source"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, QUERIES["op12_divergence"](spark, sf).collect())) == want
