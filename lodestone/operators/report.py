"""Summaries of ranked prompts, and their JSON, CSV and text forms. Formatting happens here alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import impact_tier
from ..functions.text import filled
from ..storage import stored

# Header of the CSV report.
CSV_HEADER = (
    "Rank", "Prompt", "Impact Score", "Correlation Score", "Search Intent", "Topic Cluster", "Est. Volume", "Difficulty",
    "Validation Score", "Factcheck Score", "GSC Clicks", "GSC Impressions", "GSC CTR", "GSC Position", "GA Sessions",
    "GA Organic Sessions", "GA Bounce Rate", "Recommendation", "Source URLs",
)


def topic_clusters(rows: DataFrame, listed: int = 5) -> DataFrame:
    """topic, count, avg_impact, avg_correlation and the listed prompts of the highest impact."""
    rows = rows.withColumn("topic", F.coalesce(filled(F.col("topic_cluster")), F.lit("Uncategorized")))
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("impact_score"), "priority_rank"))
    near = rows.select("topic", "prompt_text", place.alias("place")).filter(F.col("place") <= listed)  # the limit holds before the shuffle, too
    best = near.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "prompt_text"))), lambda x: x["prompt_text"]).alias("top_prompts"))
    sums = rows.groupBy("topic").agg(F.count(F.lit(1)).alias("count"), F.avg("impact_score").alias("avg_impact"), F.avg("data_correlation_score").alias("avg_correlation"), F.min("priority_rank").alias("first_rank"))
    return sums.join(best, "topic").select("topic", "count", "avg_impact", "avg_correlation", "top_prompts", "first_rank")


def intents(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce(filled(F.col("search_intent")), F.lit("unknown")).alias("intent")).agg(F.count(F.lit(1)).alias("count"))


def summary(rows: DataFrame) -> DataFrame:
    tier = impact_tier(F.col("impact_score"))
    return rows.agg(
        F.count(F.lit(1)).alias("total_prompts"),
        *(F.count_if(tier == t).alias(f"{t}_impact_prompts") for t in ("high", "medium", "low")),
        F.count_if(F.size("matches") > 0).alias("with_gsc_data"),
        F.count_if(F.col("traffic").isNotNull()).alias("with_ga_data"),
        F.coalesce(F.avg("impact_score"), F.lit(0.0)).alias("avg_impact_score"),
        F.coalesce(F.avg("data_correlation_score"), F.lit(0.0)).alias("avg_correlation_score"),
    )


def recommendations(rows: DataFrame, first: int = 30) -> DataFrame:
    """Of the first ranks those that have a recommendation."""
    near = rows.filter(F.col("priority_rank") <= first).filter(filled(F.col("recommendation")).isNotNull())
    return near.select(F.col("priority_rank").alias("priority"), F.col("prompt_text").alias("prompt"), "impact_score", "recommendation", F.substring("correlation_reasoning", 1, 200).alias("reasoning"))


def _fixed(c: Column, digits: int) -> Column:
    """A double with fixed digits: the nearest to the double's exact value, of two the even one; null stays null.

    The product with the power of ten is split into what a double holds of it and the rest, so that no rounding decides."""
    scale = float(10**digits)
    a = F.abs(c)
    half = lambda x: (x * 134217729.0) - ((x * 134217729.0) - x)  # noqa: E731  the upper half of a double's digits
    p, high, low = a * scale, half(a), a - half(a)
    top, rest = half(F.lit(scale)), F.lit(scale) - half(F.lit(scale))
    error = (((high * top - p) + high * rest) + low * top) + low * rest
    n = F.floor(p)
    part = p - n
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (n % 2 == 1))))
    k = n + up.cast("long")
    text = F.concat(F.when(c < 0, "-").otherwise(""), F.floor(k / F.lit(10**digits)).cast("string"), F.lit("."), F.lpad((k % 10**digits).cast("string"), digits, "0"))
    return F.when(c.isNotNull(), text)


def csv_rows(rows: DataFrame) -> DataFrame:
    """The columns of CSV_HEADER as text; what is missing is empty."""
    best, t = F.get("matches", 0), F.col("traffic")
    values = [
        F.col("priority_rank"), F.col("prompt_text"), _fixed(F.col("impact_score"), 3), _fixed(F.col("data_correlation_score"), 3), F.col("search_intent"), F.col("topic_cluster"),
        F.col("estimated_volume"), F.col("difficulty"), _fixed(F.col("validation.overall_score"), 3), _fixed(F.col("factcheck.overall_factual_score"), 3), best["clicks"], best["impressions"],
        _fixed(best["ctr"], 4), _fixed(best["position"], 1), t["sessions"], t["organic_sessions"], _fixed(t["bounce_rate"], 2), F.col("recommendation"), F.array_join(F.slice("source_urls", 1, 3), "; "),
    ]
    return rows.orderBy("priority_rank").select(*(F.coalesce(v.cast("string"), F.lit("")).alias(n) for n, v in zip(CSV_HEADER, values, strict=True)))


def write_csv(rows: DataFrame, path: str) -> None:
    csv_rows(rows).coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", False).option("emptyValue", "").csv(path)


def _fields(rows: DataFrame) -> Column:
    """A ranked prompt as the report shows it: metrics without pages, dates, users, duration and conversions."""
    best, t = F.get("matches", 0), F.col("traffic")
    search = F.when(best.isNotNull(), F.struct(*(best[c].alias(c) for c in ("query", "clicks", "impressions", "ctr", "position"))))
    traffic = F.when(t.isNotNull(), F.struct(*(t[c].alias(c) for c in ("page_path", "sessions", "pageviews", "bounce_rate", "organic_sessions"))))
    prompt = F.struct(*(c for c in ("prompt_text", "source_urls", "relevance_score", "search_intent", "topic_cluster", "estimated_volume", "difficulty", "status") if c in rows.columns))
    return F.struct("priority_rank", prompt.alias("prompt"), "validation", "factcheck", search.alias("gsc_data"), traffic.alias("ga_data"), "data_correlation_score", "impact_score", "recommendation", "correlation_reasoning")


def json_report(rows: DataFrame, target_url: str, generated_at: str, pages: int, usage: DataFrame | None = None, shown: int = 50) -> DataFrame:
    """The whole report as JSON, in lines: ord and value. A prompt, a topic and an intent have a line each, so that no row holds them all."""
    one = F.lit(True)
    head = summary(rows).select(F.struct("*").alias("summary"))
    advice = recommendations(rows)  # 30 rows at most
    advice = advice.agg(F.transform(F.array_sort(F.collect_list(F.struct("priority", F.struct(*advice.columns).alias("x")))), lambda v: v["x"]).alias("recommendations"))
    row = head.join(advice, one)
    used = F.lit(None).cast("struct<calls:long>")
    if usage is not None:
        row = row.join(usage.select(F.struct("*").alias("llm_usage")), one)
        used = F.col("llm_usage")
    meta = F.struct(F.lit(generated_at).alias("generated_at"), F.lit(target_url).alias("target_url"), F.lit(pages).alias("total_pages_crawled"), F.col("summary.total_prompts").alias("total_prompts_analyzed"), used.alias("llm_usage"))
    start = F.to_json(F.struct(meta.alias("metadata"), "summary", "recommendations"))
    first = row.select(F.lit(0).cast("long").alias("ord"), F.concat(F.substr(start, F.lit(1), F.length(start) - 1), F.lit(',"top_prompts":[')).alias("value"))

    def lines(df: DataFrame, section: int, rank: str, text: Column) -> DataFrame:
        """A line for each row in order of rank, which is 1 for the first and for it alone."""
        return df.select((F.lit(section << 40) + F.col(rank)).alias("ord"), F.concat(F.when(F.col(rank) == 1, "").otherwise(","), text).alias("value"))

    def entry(name: str, *fields: str) -> Column:
        pair = F.to_json(F.create_map(F.col(name), F.struct(*fields) if len(fields) > 1 else F.col(fields[0])))
        return F.substr(pair, F.lit(2), F.length(pair) - 2)

    prompts = rows.select("priority_rank", F.to_json(_fields(rows)).alias("x"))
    topics = topic_clusters(rows)
    said = rows.groupBy(F.coalesce(filled(F.col("search_intent")), F.lit("unknown")).alias("intent")).agg(F.count(F.lit(1)).alias("count"), F.min("priority_rank").alias("first_rank"))
    marks = rows.sparkSession.createDataFrame([(2 << 40, '],"all_prompts":['), (3 << 40, '],"topic_clusters":{'), (4 << 40, '},"intent_distribution":{'), (5 << 40, "}}")], "ord long, value string")
    out = first.unionByName(marks).unionByName(lines(prompts.filter(F.col("priority_rank") <= shown), 1, "priority_rank", F.col("x"))).unionByName(lines(prompts, 2, "priority_rank", F.col("x")))
    return out.unionByName(lines(topics, 3, "first_rank", entry("topic", "count", "avg_impact", "avg_correlation", "top_prompts"))).unionByName(lines(said, 4, "first_rank", entry("intent", "count")))


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file of lines (ord, value) in order: sorted and written by one task, as a file keeps their order, line by line."""
    lines.repartition(1).sortWithinPartitions("ord").select("value").write.mode("overwrite").text(path)


def text_report(rows: DataFrame, target_url: str, generated_at: str, pages: int) -> str:
    """The report for reading: tiers, the first 50 prompts, the 20 largest clusters, recommendations of the first 20."""
    rows = stored(rows.select("priority_rank", "prompt_text", "impact_score", "data_correlation_score", "search_intent", "topic_cluster", "recommendation", "matches", "traffic"), "report")  # it is read three times
    s = summary(rows).first()
    near = rows.orderBy("priority_rank").limit(50).select("priority_rank", "prompt_text", "impact_score", "data_correlation_score", "search_intent", "recommendation").collect()
    topics = topic_clusters(rows).orderBy(F.desc("count"), "first_rank").limit(20).collect()
    parts = [
        (f"Search opportunities of {target_url}", [f"made {generated_at} from {pages} pages and {s['total_prompts']} prompts"]),
        ("Tiers", [f"{tier}: {s[f'{tier}_impact_prompts']}" for tier in ("high", "medium", "low")] + [f"with search data: {s['with_gsc_data']}", f"with traffic data: {s['with_ga_data']}"]),
        ("Prompts of the highest impact", [f"{r['priority_rank']}. {r['prompt_text']} (impact {r['impact_score']:.2f}, correlation {r['data_correlation_score']:.2f}, {r['search_intent'] or 'no intent'})" for r in near]),
        ("Topics", [f"{r['topic']}, {r['count']} prompts, mean impact {r['avg_impact']:.2f}" for r in topics]),
        ("What to do first", [f"{r['priority_rank']}. {r['recommendation']}" for r in near[:20] if r["recommendation"]]),
    ]
    return "\n\n".join("\n".join([f"# {title}", *lines]) for title, lines in parts)
