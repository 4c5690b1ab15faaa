"""Hand-computed values of the column functions."""

import math
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import scoring, similarity, text, urls
from lodestone.functions.textblock import TextBlock
from lodestone.operators import claims, completion, reconcile, report
from lodestone.params import Reconcile, load


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "value"), [("1,234", 1234.0), ("3.5%", 3.5), ("$7", 7.0), ("-", 0.0), ("abc", 0.0), ("", 0.0), (" 12 ", 12.0), ("1e3", 1000.0), ("1d", 0.0), ("1_000", 1000.0), ("N/A", 0.0), ("-5", -5.0), (".5", 0.5)])
def test_number(spark, raw, value):
    assert one(spark, scoring.number(F.lit(raw))) == value


@pytest.mark.parametrize(("raw", "value"), [("3.5%", 0.035), ("0.5%", 0.5), ("1%", 1.0), ("12", 0.12)])
def test_percent(spark, raw, value):
    assert one(spark, scoring.percent(F.lit(raw))) == pytest.approx(value)


def scores(spark, **v):
    full = {"relevance": 0.8, "volume": "medium", "validation": None, "factcheck": None, "matched": False, "impressions": None, "ctr": None, "position": None, "seen": False, "organic": None} | v
    c = lambda k, t: F.lit(full[k]).cast(t)
    return one(spark, scoring.impact_score(c("relevance", "double"), c("volume", "string"), c("validation", "double"), c("factcheck", "double"), c("matched", "boolean"), c("impressions", "long"), c("ctr", "double"), c("position", "double"), c("seen", "boolean"), c("organic", "long")))


def test_impact_score(spark):
    assert scores(spark) == pytest.approx((0.12 + 0.15 + 0.10) / 0.65)
    assert scores(spark, relevance=0.9, validation=0.8, factcheck=0.9, matched=True, impressions=200, ctr=0.02, position=12.0, seen=True, organic=150) == 1.0


def test_correlation_score(spark):
    t, f = F.lit(True), F.lit(False)
    assert one(spark, scoring.correlation_score(t, F.lit(0.9), F.lit(5), F.lit(1), t, F.lit(3), F.lit(11))) == pytest.approx(0.97)
    assert one(spark, scoring.correlation_score(f, F.lit(None).cast("double"), F.lit(None).cast("long"), F.lit(None).cast("long"), f, F.lit(None).cast("long"), F.lit(None).cast("long"))) == 0.0


def test_similarity_parts(spark):
    words = lambda a: text.words(text.normal(F.lit(a)))
    assert one(spark, text.word_overlap(words("Red  plate"), words("small plate"))) == 0.5
    assert one(spark, similarity.native_score(F.lit("plate"), F.lit("red plate"), True)) == 0.8
    assert one(spark, similarity.native_score(F.lit("plate"), F.lit("red plate"), False)) == 0.5
    assert one(spark, similarity.seq_ratio(F.lit("tide"), F.lit("diet"))) == SequenceMatcher(None, "tide", "diet").ratio()
    assert one(spark, similarity.seq_ratio(F.lit("diet"), F.lit("tide"))) == SequenceMatcher(None, "diet", "tide").ratio()


@settings(max_examples=200, deadline=None)
@given(st.text("abc d", max_size=30), st.text("abc d", max_size=30))
def test_bounded_similarity_is_the_plain_one(a, b):
    a, b = " ".join(a.split()), " ".join(b.split())
    x, y = set(a.split()), set(b.split())
    words = len(x & y) / max(len(x), len(y)) if x and y else 0.0
    plain = 1.0 if a == b else max(SequenceMatcher(None, a, b).ratio(), words)
    assert TextBlock([b]).best(a, 0.0, 1, False) == [(0, plain)]
    for floor in (0.5, 0.8):
        assert TextBlock([b]).first(a, floor) == (0 if plain >= floor else None)


@pytest.mark.parametrize(("raw", "value"), [(" A  b\tC ", "a b c"), ("x", "x"), ("", "")])
def test_normal(spark, raw, value):
    assert one(spark, text.normal(F.lit(raw))) == value


@pytest.mark.parametrize(("u", "normal", "site", "page", "path"), [
    ("https://www.Example.com/a/b/#x", "https://www.Example.com/a/b", "example.com", True, "/a/b/"),
    ("http://shop.example.com:80/a.PDF?x=1", "http://shop.example.com:80/a.PDF?x=1", "shop.example.com:80", False, "/a.PDF"),
    ("https://example.com", "https://example.com", "example.com", True, ""),
    ("https://example.com/wp-admin/x", "https://example.com/wp-admin/x", "example.com", False, "/wp-admin/x"),
    ("https://example.com/a b;p?q", "https://example.com/a b;p?q", "example.com", True, "/a b"),
])
def test_urls(spark, u, normal, site, page, path):
    c = F.lit(u)
    assert one(spark, urls.normal_url(c)) == normal
    assert one(spark, urls.domain(c)) == site
    assert one(spark, urls.is_page(c)) == page
    assert one(spark, urls.path(c)) == path


def test_competitor_domain(spark):
    ok = lambda d: one(spark, urls.competitor_domain(F.lit(d), F.lit("www.me.com")))
    assert ok("rival.org") and not ok("me.com") and not ok("") and not ok("netflix.com") and not ok("maps.google.com")
    assert one(spark, urls.manual_domain(F.lit(" HTTPS://www.Rival.org// "))) == "rival.org"


@pytest.mark.parametrize(("reply", "k"), [('{"k": 1}', 1), ('well {"k": 2} ok', 2), ("no", None), ("", None), (None, None)])
def test_reply_rescue(spark, reply, k):
    r = one(spark, completion.read_reply(F.lit(reply).cast("string"), "k long"))
    assert (r["k"] if r else None) == k


def test_reply_rescue_of_a_list(spark):
    assert one(spark, completion.rescued(F.lit("list: [1, 2] end"))) == '{"items":[1, 2]}'


def test_claims_sum_up(spark):
    made = lambda *v: F.array(*(F.struct(F.lit("c").alias("claim_text"), F.lit(s).alias("verification_status"), F.lit(0.6).alias("confidence")) for s in v))
    r = one(spark, claims.summed(made("verified", "verified", "refuted")))
    assert r["overall_factual_score"] == pytest.approx(2 / 3) and not r["is_factually_sound"] and r["confidence_level"] == pytest.approx(0.6)
    assert one(spark, claims.summed(made("verified", "pending")))["is_factually_sound"]
    none = one(spark, claims.summed(F.slice(made("x"), 1, 0)))
    assert (none["overall_factual_score"], none["is_factually_sound"], none["confidence_level"]) == (0.5, True, 0.5)


def test_fixed_digits_round_as_the_double_stands(spark):
    assert [one(spark, report._fixed(F.lit(v), 2)) for v in (0.125, 0.375, 2.5, 1.0)] == ["0.12", "0.38", "2.50", "1.00"]


def runs_of(spark, n, text="same text"):
    return spark.createDataFrame([("d", i, i, text, 0.5) for i in range(n)], "domain string, run_seq long, ord long, text string, score double")


@pytest.mark.parametrize(("total", "least"), [(2, 2), (3, 2), (4, 2), (5, 3)])
def test_stable_minimum(spark, total, least):
    rows = [("d", r, 0, "always", 0.5) for r in range(total)] + [("d", r, 1, "enough", 0.4) for r in range(least)] + [("d", r, 2, "few", 0.3) for r in range(least - 1)]
    out = reconcile.stable(spark.createDataFrame(rows, "domain string, run_seq long, ord long, text string, score double"))
    assert {r["text"] for r in out.collect()} == {"always", "enough"}


@pytest.mark.parametrize(("total", "least"), [(2, 1), (3, 1), (4, 2), (5, 2)])
def test_consensus_minimum(spark, total, least):
    rows = []
    for i, (name, n) in enumerate((("alpha beta", total), ("gamma delta", least), ("omega zeta", least - 1))):
        rows += [("d", p, p * 10 + i, name, 0.5, "") for p in range(n)]
    df = spark.createDataFrame(rows, "domain string, pass int, ord long, prompt_text string, relevance_score double, extraction_reasoning string")
    kept = {r["prompt_text"] for r in reconcile.consensus(df).collect()}
    assert kept == {"alpha beta", "gamma delta"}


def test_consensus_of_one_pass_is_itself(spark):
    df = spark.createDataFrame([("d", 0, 1, "a", 0.1, "r"), ("d", 0, 2, "a", 0.2, "s")], "domain string, pass int, ord long, prompt_text string, relevance_score double, extraction_reasoning string")
    assert sorted(r["relevance_score"] for r in reconcile.consensus(df).collect()) == [0.1, 0.2]


def test_leaders_take_the_first_match_not_the_best(spark):
    df = spark.createDataFrame([("d", 1, "abcdefghij"), ("d", 2, "abcdefghxy"), ("d", 3, "abcdefghxj")], "domain string, ord long, norm string")
    leader = {r["norm"]: r["leader"] for r in reconcile.leaders(df, "domain", 0.8).collect()}
    got = {r["ord"]: leader[r["norm"]] for r in df.collect()}
    heads = []
    for i, t in ((1, "abcdefghij"), (2, "abcdefghxy"), (3, "abcdefghxj")):
        head = next((h for h in heads if SequenceMatcher(None, t, h).ratio() >= 0.8), None)
        if head is None:
            heads.append(head := t)
        assert got[i] == head


def test_drift_of_equal_runs_is_none(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "c")], "ord long, text string")
    new, dropped, counts = reconcile.drift(df, df)
    assert counts.first()["drift_score"] == 0.0 and new.count() == 0 and dropped.count() == 0
    assert reconcile.drift(df.limit(0), df.limit(0))[2].first()["drift_score"] == 0.0


def test_boosts_add_up_to_one_at_most(spark):
    stables = spark.createDataFrame([(1, "Red plate", 1.0, 0.5), (2, "red  plate", 1.0, 0.5), (3, "lost thing", 0.8, 0.5), (4, "lost things", 0.9, 0.5), (5, "weak", 0.5, 0.5)], "ord long, text string, stability double, avg_score double")
    current = spark.createDataFrame([(1, "red plate", 0.2), (2, "blue cup", 0.9)], "ord long, prompt_text string, relevance_score double")
    out = {r["ord"]: r["relevance_score"] for r in reconcile.boosts(stables, current).collect()}
    assert out[1] == pytest.approx(0.8) and out[2] == 0.9
    back = [r["text"] for r in reconcile.recovered(stables, current).collect()]
    assert back == ["lost thing"]  # its twin is a match of it by then


def test_parameters_from_settings():
    p = load({"CRAWL_MAX_PAGES": "7", "CRAWL_RESPECT_ROBOTS": "no", "EXTRACTION_TOP_N": "", "RECONCILE_SIMILARITY": "0.9"})
    assert p.crawl.max_pages == 7 and not p.crawl.respect_robots and p.extraction.top_n == 500 and p.reconcile == Reconcile(similarity=0.9)
    assert math.isclose(p.match_threshold, 0.5)


def test_fixed_digits_are_those_of_the_exact_value(spark):
    import random

    from lodestone.operators.report import _fixed

    rng = random.Random(1)
    values = [0.065, 0.045, 0.125, 0.375, 0.5, 1.005, 2.675, 0.0, 1e-9, -0.125, -2.5, 0.995, 123456.785, None] + [round(rng.random() * 10, rng.randint(1, 5)) for _ in range(500)] + [rng.randint(0, 4000) / 2 ** rng.randint(1, 8) for _ in range(200)]
    out = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", *(_fixed(F.col("v"), k).alias(f"d{k}") for k in (1, 2, 3, 4))).collect()
    for r in out:
        for k in (1, 2, 3, 4):
            v = values[r["i"]]
            assert r[f"d{k}"] == (None if v is None else f"{v:.{k}f}"), (v, k)


def test_script_paths():
    from lodestone.operators.pages import script_paths

    text = """x = "/docs/api-guide", '/a', "/static/x", "/a.js", '/a//b', "/ab/", "not /this", '/été'"""
    assert script_paths(text) == ["/docs/api-guide", "/été"]
