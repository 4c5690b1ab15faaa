"""Crawling: sitemaps, robots rules, fetches and one frontier of many sites, live by levels, over captured answers, or over a table of links."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.request import Request, urlopen
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import is_page, normal_url, robots_allowed, same_domain
from ..operators.pages import parsed
from ..params import Crawl
from ..storage import stored

#: Gives (status, content type, text) for a URL, or raises.
Fetch = Callable[[str], tuple[int, str, str]]
SITEMAPS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap/sitemap.xml")


def http_fetch(params: Crawl = Crawl()) -> Fetch:
    def fetch(url: str) -> tuple[int, str, str]:
        with urlopen(Request(url, headers={"User-Agent": params.user_agent}), timeout=params.timeout) as r:  # noqa: S310
            kind = r.headers.get("content-type", "")
            return r.status, kind, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")

    return fetch


def with_scheme(url: str) -> str:
    return url if "://" in url else f"https://{url}"


def _named(root: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (e for e in root.iter() if e.tag.rsplit("}", 1)[-1] == name)


def locations(xml: str, kind: str) -> list[str]:
    """Addresses of a sitemap's url or sitemap entries, in any namespace; none if it is not well formed."""
    try:
        root = ElementTree.fromstring(xml.encode("utf-8"))
    except ElementTree.ParseError:
        return []
    return [loc.text.strip() for e in _named(root, kind) for loc in list(_named(e, "loc"))[:1] if loc.text]


@F.pandas_udf(T.ArrayType(T.StringType()))
def sitemap_locations(xml: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([locations(x, k) if x is not None else [] for x, k in zip(xml, kind, strict=True)])


def sitemap_urls(base: str, fetch: Fetch) -> list[str]:
    """URLs of the first usual sitemap that has any; indexes are followed one level."""
    for place in SITEMAPS:
        try:
            status, _, xml = fetch(base + place)
        except Exception:  # noqa: BLE001  any failure means no sitemap here
            continue
        found: list[str] = []
        if status == 200:
            for child in locations(xml, "sitemap"):
                try:
                    found += locations(fetch(child)[2], "url")
                except Exception:  # noqa: BLE001
                    continue
            found += locations(xml, "url")
        if found:
            return found
    return []


def robots_text(base: str, fetch: Fetch) -> str | None:
    """The rules of a site; null, which allows all, if there are none."""
    try:
        status, _, text = fetch(base + "/robots.txt")
    except Exception:  # noqa: BLE001
        return None
    return text if status == 200 else None


def fetched(urls: DataFrame, fetch: Fetch | DataFrame, params: Crawl = Crawl(), partitions: int = 1) -> DataFrame:
    """urls (url, and site if they are of several) with status_code, content_type and html; html is null for errors and what is not HTML.

    fetch may be a table of captured answers (url, status_code, content_type, text). Else the pages of a site are fetched by so many
    partitions, whose pauses grow with their number, so that together they keep the site's delay; different sites do not wait for one another."""
    html = "status_code < 400 AND contains(content_type, 'text/html')"
    if isinstance(fetch, DataFrame):
        answers = fetch.select("url", "status_code", "content_type", F.when(F.expr(html), F.col("text")).alias("html"))
        return urls.join(answers, "url", "left")
    site = F.col("site") if "site" in urls.columns else F.lit("")
    last: dict[str, float] = {}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url, own in zip(frame["url"], frame["_site"], strict=True):
                time.sleep(max(0.0, last.get(own, -1e9) + params.delay * partitions - time.monotonic()) if own in last else params.delay * partitions)
                try:
                    status, kind, text = fetch(url)
                    rows.append((status, kind, text if status < 400 and "text/html" in kind else None))
                except Exception:  # noqa: BLE001  an unreachable page is no page
                    rows.append((None, None, None))
                last[own] = time.monotonic()
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield frame.assign(**dict(zip(("status_code", "content_type", "html"), columns, strict=True))).drop(columns="_site")

    schema = ", ".join(f"{c} {t}" for c, t in urls.dtypes) + ", status_code int, content_type string, html string"
    slot = F.pmod(F.xxhash64("url"), F.lit(partitions))
    return urls.withColumn("_site", site).repartition("_site", slot).mapInPandas(run, schema)


def word_gate(first: Column, words: Column, title: Column, params: Crawl = Crawl()) -> Column:
    """The first page needs few words or a title, others more words."""
    return F.when(first, (words >= params.first_words) | (F.coalesce(title, F.lit("")) != "")).otherwise(words >= params.other_words)


def _homes(sites: DataFrame, fetch: Fetch | DataFrame, params: Crawl) -> DataFrame:
    """site, rules (text or null) and seeds (the start, then the sitemap's addresses) of sites (start)."""
    start = F.when(F.contains("start", F.lit("://")), F.col("start")).otherwise(F.concat(F.lit("https://"), F.col("start")))
    rows = sites.select(start.alias("start")).select("start", F.regexp_extract("start", "//([^/?#]*)", 1).alias("site"), F.regexp_extract("start", "^(.*?//[^/?#]*)", 1).alias("base"))
    rows = rows.groupBy("site").agg(F.min_by(F.struct("start", "base"), "start").alias("x")).select("site", "x.*")  # one frontier a site
    if isinstance(fetch, DataFrame):
        text = fetch.filter("status_code = 200").groupBy("url").agg(F.first("text").alias("text"))
        ask = lambda df: df.join(text, "url", "left")
        rules = ask(rows.select("site", F.concat("base", F.lit("/robots.txt")).alias("url"))).select("site", F.col("text").alias("rules"))
        maps = ask(rows.select("site", F.posexplode(F.array(*(F.concat("base", F.lit(p)) for p in SITEMAPS))).alias("place", "url")))
        child = maps.select("site", "place", F.posexplode(sitemap_locations("text", F.lit("sitemap"))).alias("pos", "url"))
        inner = ask(child).select("site", "place", "pos", sitemap_locations("text", F.lit("url")).alias("urls"))
        own = maps.select("site", "place", F.lit(1 << 30).alias("pos"), sitemap_locations("text", F.lit("url")).alias("urls"))
        found = inner.unionByName(own).groupBy("site", "place").agg(F.array_sort(F.collect_list(F.struct("pos", "urls"))).alias("x"))
        found = found.select("site", "place", F.flatten(F.transform("x", lambda x: x["urls"])).alias("urls")).filter(F.size("urls") > 0)
        first = found.groupBy("site").agg(F.min_by("urls", "place").alias("urls"))
        none = F.array().cast("array<string>")
        return rows.join(rules, "site").join(first, "site", "left").select("site", F.when(F.lit(params.respect_robots), F.col("rules")).alias("rules"), F.concat(F.array("start"), F.coalesce("urls", none)).alias("seeds"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rules = [robots_text(b, fetch) if params.respect_robots else None for b in frame["base"]]
            seeds = [[s, *sitemap_urls(b, fetch)] for s, b in zip(frame["start"], frame["base"], strict=True)]
            yield pd.DataFrame({"site": frame["site"], "rules": pd.Series(rules, dtype=object), "seeds": pd.Series(seeds, dtype=object)})

    return rows.mapInPandas(run, "site string, rules string, seeds array<string>")


#: Orders of addresses of a level begin at this many times its depth.
LEVEL = 1 << 32


def crawl_sites(sites: DataFrame, fetch: Fetch | DataFrame, params: Crawl = Crawl(), partitions: int = 1, store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pages of sites (start), each as crawl() has them, and site: one frontier for all, with rules, delay and limits for each site.

    A level is fetched in waves; each wave has of every site as many addresses, in frontier order, as it still wants pages, so no site is asked for more after its
    page limit is reached. Links of a page that has too few words are followed all the same."""
    store = store or stored
    home = store(_homes(sites, fetch, params))
    queue = home.select("site", F.posexplode("seeds").alias("ord", "url")).select("site", F.col("ord").cast("long"), normal_url(F.col("url")).alias("url"), F.when(F.col("ord") == 0, 0).otherwise(1).alias("depth"))
    queue = store(queue.filter(same_domain(F.col("url"), F.col("site"))))
    kept = home.select("site", F.lit(0).cast("long").alias("kept"), F.lit(False).alias("met"), F.lit(-1).cast("long").alias("done"))
    visited, pages = queue.select("site", "url").limit(0), None
    for depth in range(params.max_depth + 1):
        level = queue.filter(F.col("depth") == depth).groupBy("site", "url").agg(F.min("ord").alias("ord")).join(visited, ["site", "url"], "left_anti")
        level = store(level.withColumn("depth", F.lit(depth)).join(home.select("site", "rules"), "site"))
        visited = visited.unionByName(level.select("site", "url"))
        wanted = level.filter(is_page(F.col("url")) & robots_allowed(F.col("rules"), F.lit(params.user_agent), F.col("url"))).drop("rules")
        got = None
        while True:
            place = F.row_number().over(Window.partitionBy("site").orderBy("ord"))
            rest = wanted.join(kept, "site").filter(F.col("ord") > F.col("done")).withColumn("_place", place)
            wave = store(rest.filter(F.col("_place") <= params.max_pages - F.col("kept")).select(*wanted.columns, "met"))
            if wave.isEmpty():
                break
            found = parsed(fetched(wave, fetch, params, partitions).filter(F.col("html").isNotNull()), site=F.col("site"))
            head = F.min("ord").over(Window.partitionBy("site"))  # of a site's wave, which its page limit bounds
            first = ~F.col("met") & (F.col("ord") == head)
            part = store(found.withColumn("_good", F.coalesce(word_gate(first, F.col("word_count"), F.col("title"), params), F.lit(False))).drop("met"))
            sums = part.groupBy("site").agg(F.count_if("_good").alias("_more"))
            taken = wave.groupBy("site").agg(F.max("ord").alias("_done"))
            both = kept.join(taken, "site", "left").join(sums, "site", "left")
            kept = store(both.select("site", (F.col("kept") + F.coalesce("_more", F.lit(0))).alias("kept"), (F.col("met") | F.col("_more").isNotNull()).alias("met"), F.coalesce("_done", "done").alias("done")))
            good = part.filter("_good").drop("_good")
            pages = good if pages is None else pages.unionByName(good)
            got = part if got is None else got.unionByName(part)
        if got is None:
            if depth:
                break
            continue
        links = got.select("site", F.col("ord").alias("_from"), F.posexplode("internal_links").alias("pos", "url")).filter(same_domain(F.col("url"), F.col("site")))
        number = F.row_number().over(Window.partitionBy("site").orderBy("_from", "pos")) - 1  # of a site's links on one level, which its page limit bounds
        links = links.select("site", (number + F.lit(LEVEL) * (depth + 1)).alias("ord"), "url", F.lit(depth + 1).alias("depth"))
        queue = store(queue.filter(F.col("depth") > depth).unionByName(links))
    if pages is None:
        none = home.sparkSession.createDataFrame([], "site string, ord long, url string, depth int, status_code int, content_type string, html string")
        return parsed(none, site=F.col("site"))
    place = F.row_number().over(Window.partitionBy("site").orderBy("depth", "ord"))
    return pages.withColumn("_place", place).filter(F.col("_place") <= params.max_pages).drop("_place")


def crawl(spark: SparkSession, start: str, fetch: Fetch | DataFrame, params: Crawl = Crawl(), partitions: int = 1, store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pages of a site, breadth first, level by level: ord, url, depth, status_code, content_type and the fields of a parsed page."""
    return crawl_sites(spark.createDataFrame([(start,)], "start string"), fetch, params, partitions, store).drop("site").orderBy("depth", "ord")


def reachable(links: DataFrame, start: Column | str, max_depth: int) -> DataFrame:
    """url and least depth of what start reaches over links (src, dst): a frontier of rows that were not visited before, level by level."""
    spark = links.sparkSession
    first = spark.range(1).select((F.lit(start) if isinstance(start, str) else start).alias("url"), F.lit(0).alias("depth"))
    seen = front = first
    for depth in range(1, max_depth + 1):
        step = links.join(front, links["src"] == front["url"]).select(F.col("dst").alias("url")).distinct()
        # a table, as the next level reads it twice
        front = stored(step.join(seen.select("url"), "url", "left_anti").select("url", F.lit(depth).alias("depth")), "frontier")
        seen = seen.unionByName(front)
    return seen

