"""Steps whose rows must not grow with the square of a group."""

import pytest
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.operators import completion, context, lookup, pages, reconcile
from lodestone.params import Completion
from lodestone.schema import RESPONSE


@pytest.fixture
def fixed(spark):
    """Plans that stay as they are, so that their rows can be read."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def most_rows(df):
    """The rows of df, and the most rows that a step of its plan gives."""
    rows = df.collect()
    most, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return rows, most


def test_recovery_does_not_pair_equal_texts(fixed):
    n = 600
    stables = fixed.range(n).select(F.col("id").alias("ord"), F.when(F.col("id") == 7, "lost").when(F.col("id") == 8, None).otherwise("Same").alias("text"), F.lit(0.9).alias("stability"), F.lit(0.5).alias("avg_score"))
    current = fixed.range(n).select(F.col("id").alias("ord"), F.lit("same").alias("prompt_text"))
    rows, most = most_rows(reconcile.recovered(stables, current, fuzzy=False))
    assert sorted(r["ord"] for r in rows) == [7, 8] and most <= n


def test_pages_of_one_address_do_not_all_meet_its_prompts(fixed):
    n = 300
    pages = fixed.range(n).select(F.col("id").alias("ord"), F.concat(F.lit("u"), (F.col("id") % 2).cast("string")).alias("url"))
    urls = F.when(F.col("id") == 0, F.array(F.lit("u1"), F.lit("u0"), F.lit("u1"))).when(F.col("id") == 1, F.array(F.lit("none"))).otherwise(F.array(F.lit("u1")))
    prompts = fixed.range(n).select(F.col("id").alias("ord"), urls.alias("source_urls"))
    rows, most = most_rows(lookup.page_context(prompts, pages))
    found = {(r["prompt_ord"], r["page_ord"], r["place"]) for r in rows}
    want = {(i, at, k + 1) for i in range(n) for k, at in enumerate([0, 1, 2] if i < 2 else [1, 3, 5])}
    assert found == want and len(rows) == len(want) and most <= 4 * n


def test_a_text_of_pages_is_made_once_for_all_prompts_that_share_it(fixed):
    n = 400
    texts = fixed.createDataFrame([(i, f"text {i}") for i in range(4)], "ord long, body string")
    shared = fixed.range(n).select(F.col("id").alias("prompt_ord"), F.posexplode(F.when(F.col("id") == 0, F.array(F.lit(3), F.lit(9))).otherwise(F.array(F.lit(2), F.lit(0), F.lit(1)))).alias("place", "page_ord"))
    rows, most = most_rows(context.prompt_pages(shared, texts, F.col("body")))
    mark = "\n\n---\n\n"
    assert {r["prompt_ord"]: r["content"] for r in rows} == {i: mark.join(["text 2", "text 0", "text 1"]) if i else "text 3" for i in range(n)}
    assert len(rows) == n and most <= n


def test_calls_without_spacing_are_spread_over_tasks(fixed):
    def backend(request):
        from pyspark import TaskContext

        return str(TaskContext.get().partitionId()), {"prompt_tokens": 1}

    rows = fixed.range(300).select(F.col("id").alias("ord"))
    service = completion.Service(fixed.createDataFrame([], RESPONSE), backend, Completion(spacing=0.0, retries=1), partitions=None)
    got = service.ask(rows, "ord", F.array(completion.message("user", F.col("ord").cast("string"))), 0.1, 10).collect()
    assert len(got) == 300 and len({r["content"] for r in got}) > 1 and service.counted["calls"] == 300
    with pytest.raises(ValueError):
        completion.completed(rows, fixed.createDataFrame([], RESPONSE), backend, Completion(), None)


def test_pages_are_parsed_a_few_at_a_time(spark, monkeypatch):
    html = lambda i: f"<html><head><title>t{i}</title></head><body><main>{'word ' * (i % 20)}<a href='/{i}'>x</a></main></body></html>"
    want = [(i, *pages.parse(f"https://e.com/{i}", html(i))) for i in range(3 * pages.PAGES_AT_ONCE + 5)]
    rows = spark.createDataFrame([(i, f"https://e.com/{i}", html(i)) for i, *_ in want], "ord long, url string, html string").coalesce(1)
    assert [tuple(r) for r in pages.parsed(rows).drop("url").orderBy("ord").collect()] == want


def test_pages_of_one_address_count_apart(spark, tmp_path):
    body = "<html><body><main>some words</main></body></html>"
    rows = [(0, "https://e.com/en/a", body), (1, "https://e.com/en/a", body), (2, "https://e.com/en/b", body)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r["prompt_text"]: r["n_urls"] for r in catalog.extract_all_replay(spark, str(tmp_path)).collect()}
    assert found == {"first query": 3, "second query": 3, "for the site": 0}
