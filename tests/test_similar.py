"""Similar texts by tiles and blocks against comparisons of all pairs: the best, the first leaders, containment, recovery."""

import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import textblock
from lodestone.functions.textblock import TextBlock
from lodestone.operators import matching, reconcile, tiles

WORDS = ["red", "blue", "green", "plate", "plates", "cup", "cups", "shop", "ünïcödé", "a", "漢字", "long-handled", "teapot"]


def plain(a, b, contained=False):
    x, y = set(a.split()), set(b.split())
    words = len(x & y) / max(len(x), len(y)) if x and y else 0.0
    inside = 0.8 if contained and (a in b or b in a) else 0.0
    return 1.0 if a == b else max(SequenceMatcher(None, a, b).ratio(), words, inside)


def some_texts(n, seed, most=6):
    rng = random.Random(seed)
    return sorted({" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, most))) for _ in range(n)}, key=lambda t: rng.random())


@pytest.mark.parametrize("asked", [1, 32])
@pytest.mark.parametrize(("floor", "k"), [(0.5, 10), (0.8, 1), (0.3, 3)])
def test_best_of_a_block(monkeypatch, asked, floor, k):
    monkeypatch.setattr(textblock, "ASKED", asked)
    texts = some_texts(200, 1)
    block = TextBlock(texts)
    for a in some_texts(40, 2) + texts[:5] + ["x" * 70, "red plate " * 60]:
        for contained in (True, False):
            every = sorted((-plain(a, b, contained), i) for i, b in enumerate(texts))
            assert block.best(a, floor, k, contained) == [(i, -s) for s, i in every[:k] if -s >= floor], a


@settings(max_examples=300, deadline=None)
@given(st.text("abcd ", max_size=150), st.lists(st.text("abcd ", max_size=150), min_size=1, max_size=5, unique=True))
def test_bounds_hold(a, texts):
    block = TextBlock(texts)
    some, bound = block.bounds(a, block.native(a, False) * 0 - 1, 0.0)
    asked = dict(zip(some.tolist(), bound.tolist(), strict=True))
    for i, b in enumerate(texts):
        if a:
            assert SequenceMatcher(None, a, b).ratio() <= asked[i]


def test_subsequences_are_the_longest():
    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
        return row[-1]

    texts = [*some_texts(50, 3, 30), "", "ab" * 200]
    block = TextBlock(texts)
    for a in [*some_texts(20, 4, 30), "ab" * 150, "x", "a" * 64, "b" * 65]:
        assert block._subsequence(a, block.length.argsort()).tolist() == [longest(a, texts[i]) for i in block.length.argsort()]


def test_first_and_every():
    texts = some_texts(150, 5)
    block = TextBlock(texts)
    for a in some_texts(40, 6):
        every = [i for i, b in enumerate(texts) if plain(a, b) >= 0.7]
        assert block.first(a, 0.7) == (every[0] if every else None)
        assert block.every(a, 0.7, 80) == [i for i in every if i < 80]


@pytest.mark.parametrize(("tile", "block"), [(1024, 32_768), (7, 20)])
def test_top_matches_are_those_of_all_pairs(spark, monkeypatch, tile, block):
    monkeypatch.setattr(tiles, "TILE", tile)
    monkeypatch.setattr(tiles, "BLOCK", block)
    a, b = some_texts(60, 7), [*some_texts(90, 8), "Red  PLATE", "red plate"]  # two rows of one text
    prompts = spark.createDataFrame([*enumerate(a), (999, None), (1000, a[0])], "ord long, prompt_text string")
    metrics = spark.createDataFrame([*enumerate(b), (999, None)], "ord long, query string")
    out = matching.top_matches(prompts, metrics, 0.5, 4).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["match_rank"]):
        got.setdefault(r["prompt_ord"], []).append((r["query_ord"], r["match_score"]))
    norm = [" ".join(t.lower().split()) for t in b]
    for i, t in [*enumerate(a), (1000, a[0])]:
        every = sorted((-plain(t, x, True), j) for j, x in enumerate(norm))
        assert got.get(i, []) == [(j, -s) for s, j in every[:4] if -s >= 0.5]
    assert 999 not in got
    assert matching.top_matches(prompts.limit(0), metrics).count() == 0 and matching.top_matches(prompts, metrics.limit(0)).count() == 0


def test_no_nested_loop_in_the_plan(spark):
    prompts = spark.createDataFrame([(1, "red plate")], "ord long, prompt_text string")
    metrics = spark.createDataFrame([(1, "red plates")], "ord long, query string")
    plan = matching.top_matches(prompts, metrics)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def plain_leaders(texts, threshold):
    heads, out = [], {}
    for t in texts:
        if t not in out:
            head = next((h for h in heads if plain(t, h) >= threshold), None)
            if head is None:
                heads.append(head := t)
            out[t] = head
    return out


@pytest.mark.parametrize("wave", [1024, 5])
def test_leaders_are_those_of_the_sequential_rule(spark, monkeypatch, wave):
    monkeypatch.setattr(reconcile, "WAVE", wave)
    monkeypatch.setattr(tiles, "TILE", 16)
    chained = ["".join("ab"[j < i] for j in range(20)) for i in range(21)]  # each resembles its neighbours
    groups = {"one": some_texts(60, 9), "two": chained, None: some_texts(8, 10) + ["red"], "three": ["alone"]}
    rows = [(g, i, t) for g, own in groups.items() for i, t in enumerate(own + own[:3])]
    df = spark.createDataFrame(rows, "domain string, ord long, norm string").repartition(3)
    got = {(r["domain"], r["norm"]): r["leader"] for r in reconcile.leaders(df, "domain", 0.8).collect()}
    want = {(g, t): head for g, own in groups.items() for t, head in plain_leaders(own, 0.8).items()}
    assert got == want
    assert reconcile.leaders(df.limit(0), "domain", 0.8).count() == 0


def test_recovery_takes_chained_texts_in_order(spark):
    chained = ["".join("ab"[j < i] for j in range(20)) for i in range(21)]
    stables = spark.createDataFrame([(i, t, 0.9, 0.5) for i, t in enumerate([*chained, *some_texts(30, 11), chained[0]])], "ord long, text string, stability double, avg_score double")
    current = spark.createDataFrame([(1, chained[4], 0.1), (2, "red plate", 0.2)], "ord long, prompt_text string, relevance_score double")
    held, want = [chained[4], "red plate"], []
    for r in stables.orderBy("ord").collect():
        t = " ".join(r["text"].lower().split())
        if all(plain(t, h) < 0.8 for h in held):
            held.append(t)
            want.append(r["ord"])
    assert sorted(r["ord"] for r in reconcile.recovered(stables, current).collect()) == want


@pytest.mark.parametrize(("tile", "block"), [(1024, 32_768), (3, 4)])
def test_paths_inside_and_around(spark, monkeypatch, tile, block):
    monkeypatch.setattr(tiles, "TILE", tile)
    monkeypatch.setattr(tiles, "BLOCK", block)
    paths = ["/u/1", "/u/12", "/", "", "/x/u/1/y", "/none", "/u/123/é", None]
    for pages in (["/u/1", "/u/10", "/u/12/", "/x", "/é"], ["/", "/u"], ["", "/u/1"], ["/zzz"], []):
        ps = spark.createDataFrame([(p,) for p in paths], "p string")
        ts = spark.createDataFrame([(t, 10 - i) for i, t in enumerate(pages)], "t string, ord long")
        want = {}
        for p in paths[:-1]:
            met = [10 - i for i, t in enumerate(pages) if t in p or p in t]
            if met:
                want[p] = min(met)
        assert {r["p"]: r["ord"] for r in matching.inside_or_around(ps, ts).collect()} == want


def test_a_group_is_dealt_to_bounded_tiles(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 10)
    monkeypatch.setattr(tiles, "BLOCK", 25)
    seen = tiles.tiled(
        spark.range(100).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("a")), spark.range(200).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("b")), "g",
        lambda a, b: __import__("pandas").DataFrame({"n": [len(a) * len(b)], "a": [len(a)], "b": [len(b)]}), "n long, a long, b long",
    ).collect()
    assert sum(r["n"] for r in seen) == 100 * 200  # every pair meets once
    assert max(r["a"] for r in seen) < 40 and max(r["b"] for r in seen) < 60
