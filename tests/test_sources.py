"""Exports, captured API rows, pages, sitemaps, crawls, history, and the whole dataflow with recorded replies."""

import json
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.operators import competitors, pages
from lodestone.operators.completion import RateLimited, Recorded, Service, Turn, _send, cache_marks, completed, requests, usage
from lodestone.params import Completion, Crawl, Extraction, Factcheck, Params
from lodestone.plans import cli
from lodestone.plans.pipeline import Analysis
from lodestone.schema import RESPONSE
from lodestone.sources import api, auth, csvio, history, web

QUICK = Completion(spacing=0.0, retries=1, backoff=0.0)


def written(tmp_path, text, name="f.csv"):
    p = tmp_path / name
    p.write_bytes(text.encode("utf-8"))
    return str(p)


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_search_export(spark, tmp_path, sep):
    lines = [["Top queries", "Clicks", "Impressions", "CTR", "Position"], ["red plate", "1234", "9000", "3.5%", "4.2"], ["", "1", "2", "1%", "3"], ["blue cup", "-", "N/A", "0.5%", "x"], ["short"]]
    text = "﻿" + "\n".join(sep.join(x) for x in lines) + "\n"
    out = csvio.search_queries(spark, written(tmp_path, text)).orderBy("ord").collect()
    assert [(r["query"], r["clicks"], r["impressions"], r["ctr"], r["position"]) for r in out] == [("red plate", 1234, 9000, 0.035, 4.2), ("blue cup", 0, 0, 0.5, 0.0), ("short", 0, 0, 0.0, 0.0)]


def test_search_export_with_remarks_and_quotes(spark, tmp_path):
    text = '# export, 2024\nDate range: May\n\nQuery,Click-through_rate,Clicks\n"a, ""b""",12,"1,234"\n'
    out = csvio.search_queries(spark, written(tmp_path, text)).collect()
    assert [(r["query"], r["clicks"], r["ctr"]) for r in out] == [('a, "b"', 1234, 0.12)]


def test_export_with_line_breaks_in_quotes(spark, tmp_path):
    text = 'Query,Clicks,Impressions\n"multi\nline",5,6\nplain,"1,\n000",2\n"a ""b""\n\nc",7,8\n'
    out = csvio.search_queries(spark, written(tmp_path, text)).orderBy("ord").collect()
    assert [(r["query"], r["clicks"], r["impressions"]) for r in out] == [("multi\nline", 5, 6), ("plain", 0, 2), ('a "b"\n\nc', 7, 8)]


@pytest.mark.parametrize("columns", [72, 3000])
def test_export_of_many_columns(spark, tmp_path, columns):
    header = ",".join([*(f"x{i}" for i in range(columns - 2)), "Query", "Clicks"])
    text = header + "\n" + ",".join([*("0" for _ in range(columns - 2)), "red plate", "12"]) + "\n"
    out = csvio.search_queries(spark, written(tmp_path, text)).collect()
    assert [(r["query"], r["clicks"]) for r in out] == [("red plate", 12)]


def test_export_with_many_remarks(spark, tmp_path):
    text = "".join(f"# remark {i}\n" for i in range(205)) + '\nDate range: "May\nQuery,Clicks\n"two\nlines",3\n'
    assert csvio.layout(spark, written(tmp_path, text))[:2] == (",", 207)
    out = csvio.search_queries(spark, written(tmp_path, text)).collect()
    assert [(r["query"], r["clicks"]) for r in out] == [("two\nlines", 3)]


@pytest.fixture
def tiny_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_export_is_read_by_many_tasks(spark, tmp_path, tiny_splits, end):
    """Records that begin in one split and end in others, stray and doubled quotes, blank lines, quotes left open: as of Spark's reader of whole files."""
    rng = random.Random(5)
    quoted = lambda: '"' + "".join(rng.choice(["a", '""', ",", "\n", "b ", "\n\n"]) for _ in range(rng.randrange(6))) + '"'
    odd = lambda: "".join(rng.choice(["a", '"', " ", '""']) for _ in range(rng.randrange(5)))
    lines = [",".join(rng.choice([quoted, quoted, odd, lambda: "é"])() for _ in range(rng.choice([1, 3, 4]))) for _ in range(40)]
    long = '"' + "line of a long cell\n" * 20 + '",1,2'
    path = written(tmp_path, "\n".join(["Query,Clicks,Impressions", *lines, "", long, "last,3,4", '"open', "to the end"]).replace("\n", end))
    rows, header = csvio._rows(spark, path)
    found = rows.orderBy("ord").collect()
    got = [list(r["cells"]) for r in found]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [list(r) for r in spark.read.csv(path, quote='"', escape='"', multiLine=True).collect()]
    assert [header, *got] == want and len(got) > 20
    splits = Counter(r["ord"] >> 33 for r in found)
    assert len(splits) > 10 and max(splits.values()) < len(got) / 2


def test_export_of_many_tasks_with_remarks(spark, tmp_path, tiny_splits):
    text = '# made "by\nDate: x\n"Query",Clicks\n' + "".join(f'"two\nlines {i}","{i},000"\n' for i in range(30))
    rows = csvio.search_queries(spark, written(tmp_path, text)).orderBy("ord").collect()
    assert [(r["query"], r["clicks"]) for r in rows] == [(f"two\nlines {i}", 1000 * i) for i in range(30)]


def test_export_of_many_files(spark, tmp_path):
    """Files follow each other by name, whatever their sizes; a record ends with its file."""
    (tmp_path / "x").mkdir()
    for name, text in (("a", ""), ("b", "# remark\nQuery,Clicks\nred,1\n"), ("c", "".join(f'"q\n{i}",{i}\n' for i in range(500))), ("d", "blue,2\n")):
        written(tmp_path / "x", text, f"{name}.csv")
    rows = csvio.search_queries(spark, str(tmp_path / "x")).orderBy("ord").collect()
    assert [(r["query"], r["clicks"]) for r in rows] == [("red", 1), *((f"q\n{i}", i) for i in range(500)), ("blue", 2)]


def test_export_of_carriage_returns(spark, tmp_path):
    rows = csvio.search_queries(spark, written(tmp_path, '# remark\rQuery,Clicks\r"a\rb",1\rc,2\r')).orderBy("ord").collect()
    assert [(r["query"], r["clicks"]) for r in rows] == [("a\nb", 1), ("c", 2)]


def test_separators_and_places():
    assert [csvio.separator(x) for x in ("a,b;c", "a;b;c,d", "a\tb\tc,d", "a\tb,c", "a;b\tc", "a", "")] == [",", ";", "\t", ",", ";", ",", ","]
    header = ["Avg. position", "top_queries", "Query", "CTR (%)"]
    assert csvio.places(header, csvio.SEARCH_NAMES) == {"query": 1, "clicks": None, "impressions": None, "ctr": 3, "position": 0}


def test_exports_without_key_column_or_file(spark, tmp_path):
    assert csvio.search_queries(spark, written(tmp_path, "foo,bar\n1,2\n")).count() == 0
    assert csvio.search_queries(spark, str(tmp_path / "none.csv")).count() == 0
    assert csvio.traffic_pages(spark, written(tmp_path, "", "empty.csv")).count() == 0


def test_traffic_export_last_row_wins(spark, tmp_path):
    text = "Page path,Sessions,Users,Views,Average session duration,Bounce rate,Conversions\n/a,1,1,1,2.5,55%,0\n/b,5,1,1,1,0.4,1\n/a,9,1,1,3,2,0\n"
    traffic = csvio.traffic_pages(spark, written(tmp_path, text))
    out = traffic.orderBy("ord").collect()
    assert [(r["page_path"], r["sessions"], r["bounce_rate"], r["organic_sessions"]) for r in out] == [("/a", 9, 0.02, 0), ("/b", 5, 0.4, 0)]
    organic = written(tmp_path, "Landing page,Sessions\n/b,3\n/c,4\n/c,6\n", "o.csv")
    both = {r["page_path"]: (r["sessions"], r["organic_sessions"]) for r in csvio.organic_traffic(spark, organic, traffic).collect()}
    assert both == {"/a": (9, 0), "/b": (5, 3), "/c": (0, 6)}


def test_captured_search_rows(spark, tmp_path):
    rows = [{"keys": ["q", "/a"], "clicks": 1, "impressions": 10}, {"keys": ["q", "/b"], "clicks": 2, "impressions": 20}, {"keys": ["x"], "clicks": 9}, {"keys": ["z", "/a"], "clicks": 0, "impressions": 0}]
    path = written(tmp_path, "\n".join(map(json.dumps, rows)), "rows.json")
    got = {r["query"]: (r["clicks"], r["impressions"], r["ctr"], r["pages"]) for r in api.search_queries(api.captured(spark, path)).collect()}
    assert got == {"q": (3, 30, 0.1, ["/a", "/b"]), "z": (0, 0, 0.0, ["/a"])}


def test_requested_rows_are_paged(spark):
    def transport(request):
        return [{"keys": [f"p{request['startRow'] + i}"], "clicks": 1, "impressions": 2, "ctr": 0.5, "position": 3.0} for i in range(min(request["rowLimit"], 3))]

    rows = api.requested(spark, transport, {"siteUrl": "s"}, limit=9, page=3)
    assert sorted(r["page"] for r in api.search_pages(rows).collect()) == [f"p{i}" for i in range(9)]


def test_filters_and_pages_travel_with_the_request(spark, tmp_path):
    def transport(request):
        (tmp_path / f"{request['startRow']}.json").write_text(json.dumps(request))
        rows = [{"keys": [f"q{i % 3}", f"/p{i}"], "clicks": i} for i in range(10)]
        for f in request.get("filters", []):
            at = request["dimensions"].index(f["dimension"])
            same = {"equals": str.__eq__, "contains": str.__contains__, "beginsWith": str.startswith}[f["operator"]]
            rows = [r for r in rows if same(r["keys"][at], f["expression"])]
        return rows[request["startRow"] : request["startRow"] + request["rowLimit"]]

    rows = api.requested(spark, transport, api.search_request("s", "a", "b"), limit=6, page=2, push=True)
    some = rows.filter("query = 'q1' AND page LIKE '/p%' AND page <> '/p7'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "q1" not in plan and "StartsWith" not in plan and "/p7" in plan  # what the service applies has left Spark's filter
    assert sorted(r["page"] for r in some.collect()) == ["/p1", "/p4"]
    asked = [json.loads(f.read_text()) for f in sorted(tmp_path.iterdir())]
    assert [(r["startRow"], r["rowLimit"]) for r in asked] == [(0, 2), (2, 2), (4, 2)]
    assert all({"dimension": "query", "operator": "equals", "expression": "q1"} in r["filters"] and len(r["filters"]) == 2 for r in asked)
    assert rows.count() == 6  # the limit, and no filter of the query before
    plain = api.requested(spark, transport, api.search_request("s", "a", "b"), limit=10, page=4)
    assert sorted(r["page"] for r in plain.filter("query = 'q1'").union(plain.filter("query = 'q2'")).collect()) == ["/p1", "/p2", "/p4", "/p5", "/p7", "/p8"]


def test_landing_pages(spark):
    def rows(*xs):
        return spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(xs)], "ord long, value string")

    both = rows({"pagePath": "/a", "sessions": "5", "totalUsers": "4", "screenPageViews": "9", "averageSessionDuration": "1.5", "bounceRate": "0.3", "conversions": "1"})
    organic = rows({"pagePath": "/a", "sessions": "2", "totalUsers": "1", "screenPageViews": "3", "bounceRate": "0.1"}, {"pagePath": "/b", "sessions": "7", "totalUsers": "6", "screenPageViews": "8", "bounceRate": "0.2"})
    got = {r["page_path"]: (r["sessions"], r["users"], r["organic_sessions"]) for r in api.landing(both, organic).collect()}
    assert got == {"/a": (5, 4, 2), "/b": (0, 6, 7)}
    assert api.site_for(["https://x.org/", "sc-domain:me.com"], "me.com") == "sc-domain:me.com"


def test_main_text_is_that_of_the_densest_box():
    text = lambda body: pages.parse("https://e.com", f"<html><head><title>t</title></head><body>{body}</body></html>")[5]
    menu = '<div><ul><li><a href="/a">One place</a></li><li><a href="/b">Another place</a></li></ul></div>'
    story = "<p>The first sentence of a long story, with commas.</p><p>The second one has <a href='/x'>a link</a> in it.</p>"
    plain_story = "The first sentence of a long story, with commas. The second one has a link in it."
    assert text(f"{menu}<div>{story}</div>{menu}<div>short note</div>") == plain_story
    assert text(f"<div><div>{story}</div>{menu}</div>") == plain_story  # boxes of links inside go, too
    assert text(f"<div><h1>Head</h1><p>{'A few words. ' * 4}</p></div><div>{'An advertisement in prose. ' * 3}</div>").startswith("Head A few words.")
    assert text("<div>one half of it all</div><div>the other half of it</div>") == "one half of it all the other half of it"
    assert text(f"{menu}<main>{story}</main>") == plain_story
    assert text("") == "t" and text(menu) == "t. One place Another place"  # a page of links alone keeps them


HTML = """<html><head><title> Home </title><meta name="description" content="About us"><meta property="og:title" content="OG">
<script type="application/ld+json">{"name": "Shop", "text": 3, "headline": "Big"}</script></head><body><header><h1>hidden</h1></header><nav><a href="/nav">n</a></nav>
<main><h1>One <b>big</b></h1><h2>Two</h2><p>some text here</p><a href="b/c#frag">x</a><a href="https://www.example.com/d/">y</a><a href="https://other.org/p">z</a>
<a href="mailto:a@b.c">m</a><a href="//cdn.org/x">w</a></main><script>var r=["/docs/api-guide", "/static/x", "/a.js"]</script><footer>foot</footer></body></html>"""


def test_references_without_a_semicolon_stay():
    html = '<html><head><title>up &amp &#39 &amp; &lt;b&gt; &amp</title><script>var a = "/x/y" && 1 &amp 2;</script></head><body><main><h1>one &amp</h1><a href="/p?a=1&copy=2&amp;b=3">R&D &copy &eacute;&nbsp;&</a></main></body></html>'
    page = pages._Reader().read(html)
    title, _, h1, *_, inside, _, _ = pages.parse("https://e.com", html)
    assert title == "up &amp &#39 & <b> &amp" and h1 == ["one &amp"]
    assert page.links == ["/p?a=1&copy=2&b=3"] and inside == ["https://e.com/p?a=1&copy=2&b=3", "https://e.com/x/y"]
    assert page.scripts[0][1] == ['var a = "/x/y" && 1 &amp 2;'] and page.texts["main"][-1] == "R&D &copy é\xa0&"


def test_parse_page(spark):
    r = pages.parsed(spark.createDataFrame([("https://example.com/a/", HTML)], "url string, html string")).first()
    assert r["title"] == "Home" and r["meta_description"] == "About us"
    assert r["h1_tags"] == ["Onebig"] and r["h2_tags"] == ["Two"] and r["h3_tags"] == []
    assert r["internal_links"] == ["https://example.com/a/b/c", "https://example.com/docs/api-guide", "https://example.com/nav", "https://www.example.com/d"]
    assert r["external_links"] == ["https://other.org/p"]
    assert r["body_text"].startswith("Home. OG. About us. Shop Big. One big Two some text here") or "some text here" in r["body_text"]
    assert "foot" not in r["body_text"] and "hidden" not in r["body_text"]


def test_all_external_links_of_a_page_are_kept(spark, tmp_path):
    """Also of a page that repeats its first links, and whose others come late; a domain counts with all links to it."""
    links = ["https://ads.org/x"] * 60 + ["/own"] + [f"https://s{i % 3}.org/{i}" for i in range(120)]
    html = page_of(20, *links)
    spark.createDataFrame([(1, "https://e.com/p", html), (2, "https://e.com/q", page_of(20, "/own"))], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = catalog.page_parse(spark, str(tmp_path)).orderBy("page_id").collect()
    assert [(r["internal"], r["external"]) for r in found] == [(1, 121), (1, 0)]
    rows = pages.parsed(spark.read.parquet(f"{tmp_path}/pages.parquet").withColumnRenamed("page_id", "ord"))
    assert rows.orderBy("ord").first()["external_links"] == sorted(set(links) - {"/own"})
    counts = {r["domain"]: r["links"] for r in competitors.linked_domains(rows, F.lit("e.com")).collect()}
    assert counts == {"ads.org": 1, "s0.org": 40, "s1.org": 40, "s2.org": 40}


def test_sitemaps_and_robots(spark):
    index = "<sitemapindex><sitemap><loc>https://e.com/s1.xml</loc></sitemap></sitemapindex>"
    child = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://e.com/p </loc></url></urlset>'
    site = {"https://e.com/sitemap_index.xml": index, "https://e.com/s1.xml": child}

    def fetch(u):
        return (200, "text/xml", site[u]) if u in site else (404, "", "")

    assert web.sitemap_urls("https://e.com", fetch) == ["https://e.com/p"]
    assert web.locations("<broken", "url") == []
    assert web.robots_text("https://e.com", fetch) is None


def page_of(words, *links, title="T"):
    return f"<html><head><title>{title}</title></head><body><main>{' '.join(['word'] * words)}{''.join(f'<a href={chr(34)}{x}{chr(34)}>l</a>' for x in links)}</main></body></html>"


SITE = {
    "https://e.com": page_of(2, "/a", "/b", "/closed", "/file.pdf"),
    "https://e.com/a": page_of(20, "/c", "/b#x", "https://other.org/"),
    "https://e.com/b": page_of(3, "/d"),
    "https://e.com/c": page_of(20, "/", "/e"),
    "https://e.com/d": page_of(20),
    "https://e.com/e": page_of(20, "/f"),
    "https://e.com/f": page_of(20),
}


def fetch_site(u):
    if u.endswith("/robots.txt"):
        return 200, "text/plain", "User-agent: *\nDisallow: /closed"
    if u in SITE:
        return 200, "text/html; charset=utf-8", SITE[u]
    raise OSError("unreachable")


def test_crawl(spark):
    p = Crawl(delay=0.0, max_depth=3)
    out = web.crawl(spark, "e.com", fetch_site, p).orderBy("depth", "ord").collect()
    assert [(r["url"], r["depth"]) for r in out] == [("https://e.com", 0), ("https://e.com/a", 1), ("https://e.com/c", 2), ("https://e.com/d", 2), ("https://e.com/e", 3)]
    few = web.crawl(spark, "e.com", fetch_site, Crawl(delay=0.0, max_pages=2)).collect()
    assert len(few) == 2


def test_crawl_stops_fetching_at_its_limit(spark, tmp_path):
    """Of a level of 40 links only so many are fetched as pages are wanted."""
    log = tmp_path / "fetched"

    def fetch(u):
        with open(log, "a") as f:
            f.write(u + "\n")
        if u == "https://e.com":
            return 200, "text/html", page_of(20, *(f"/p{i}" for i in range(40)))
        return (200, "text/html", page_of(20 if int(u.rsplit("p", 1)[1]) % 2 else 1)) if "/p" in u else (404, "", "")

    out = web.crawl(spark, "e.com", fetch, Crawl(delay=0.0, max_pages=5, respect_robots=False)).collect()
    assert [r["url"] for r in sorted(out, key=lambda r: r["ord"])] == ["https://e.com"] + [f"https://e.com/p{i}" for i in (1, 11, 13, 15)]
    pages = [u for u in log.read_text().split() if "sitemap" not in u]
    assert len(pages) == len(set(pages)) <= 10
    assert web.crawl(spark, "e.com", lambda u: (404, "", ""), Crawl(delay=0.0)).count() == 0


def test_sites_are_crawled_in_one_frontier(spark):
    """Each site's pages are those of a crawl of its own, with its own rules and limit."""
    other = {u.replace("e.com", "f.org"): t for u, t in SITE.items()} | {"https://f.org/closed": page_of(20)}
    both = SITE | other

    def fetch(u):
        if u == "https://e.com/robots.txt":
            return 200, "text/plain", "User-agent: *\nDisallow: /closed"
        if u == "https://f.org/sitemap.xml":
            return 200, "text/xml", "<urlset><url><loc>https://f.org/f</loc></url></urlset>"
        return (200, "text/html", both[u]) if u in both else (404, "", "")

    p = Crawl(delay=0.0, max_depth=3, max_pages=4)
    starts = spark.createDataFrame([("e.com",), ("https://f.org",), ("none.example",), ("f.org",)], "start string")
    got = {}
    for r in web.crawl_sites(starts, fetch, p).collect():
        got.setdefault(r["site"], []).append((r["url"], r["depth"], r["ord"]))
    for site in ("e.com", "f.org"):
        assert sorted(got[site]) == sorted((r["url"], r["depth"], r["ord"]) for r in web.crawl(spark, site, fetch, p).collect())
    assert set(got) == {"e.com", "f.org"}
    assert ("https://f.org/closed", 1) in {x[:2] for x in got["f.org"]} and "https://f.org/f" in {x[0] for x in got["f.org"]}
    # the same from captured answers
    rows = [(u, *fetch(u)) for u in [*both, "https://e.com/robots.txt", "https://f.org/sitemap.xml"]]
    captured = spark.createDataFrame(rows, "url string, status_code int, content_type string, text string")
    again = {}
    for r in web.crawl_sites(starts, captured, p).collect():
        again.setdefault(r["site"], []).append((r["url"], r["depth"], r["ord"]))
    assert {k: sorted(v) for k, v in again.items()} == {k: sorted(v) for k, v in got.items()}


def test_sites_do_not_wait_for_one_another(spark):
    urls = spark.createDataFrame([(f"https://{s}/{i}", s) for s in ("a", "b") for i in range(3)], "url string, site string").coalesce(1)
    began = time.time()
    rows = web.fetched(urls, lambda u: (200, "text/html", repr(time.time())), Crawl(delay=0.4)).collect()
    at = {s: sorted(float(r["html"]) for r in rows if r["site"] == s) for s in ("a", "b")}
    assert all(b - a > 0.39 for own in at.values() for a, b in zip(own, own[1:], strict=False))
    assert time.time() - began < 12


def test_history_is_compacted_beside_a_writer(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    df = lambda i: spark.createDataFrame([(j, f"text {i} {j}", 0.5, "i", "t") for j in range(2)], "ord long, prompt_text string, relevance_score double, search_intent string, topic_cluster string")
    texts = lambda: sorted((r["run_seq"], r["text"]) for r in history.load(spark, path, "d").collect())
    history.compact(spark, path, "d")  # of nothing
    for i in range(13):
        history.append(df(i), path, "d", "2024-01-01 00:00:00")
    history.append(df(99), path, "other", "2024-01-01 00:00:00")
    slow = history._reserved(spark, path, "d", 13)  # a writer that has its number and is not done
    history.append(df(14), path, "d", "2024-01-01 00:00:00")
    reader = history.load(spark, path, "d")
    before = texts()
    history.compact(spark, path, "d")
    assert texts() == before == sorted((r["run_seq"], r["text"]) for r in reader.collect())  # who began before the commit ends
    history.append(df(13), path, "d", "2024-01-01 00:00:00", slow)
    assert {n for n, _ in texts()} == set(range(5, 15))
    for i in range(15, 18):
        history.append(df(i), path, "d", "2024-01-01 00:00:00")
    history.compact(spark, path, "d")
    assert {n for n, _ in texts()} == set(range(8, 18)) and len(texts()) == 20
    left = {r["run_seq"] for r in spark.read.parquet(path).filter("domain = 'd'").select("run_seq").collect()}
    assert left == {13, *range(15, 18)}  # what the first marker stands for is gone
    assert history.load(spark, path, "other").count() == 2
    history.append(df(18), path, "d", "2024-01-01 00:00:00")
    assert max(texts())[0] == 18


def test_two_writers_get_two_run_numbers(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    taken = [history._reserved(spark, path, "d", 0) for _ in range(3)]
    assert taken == [0, 1, 2] and history._reserved(spark, path, "other", 0) == 0
    df = spark.createDataFrame([(0, "a", 0.5, "i", "t")], "ord long, prompt_text string, relevance_score double, search_intent string, topic_cluster string")
    history.append(df, path, "d", "2024-01-01 00:00:00")
    assert [r["run_seq"] for r in history.load(spark, path, "d").collect()] == [3]


def test_logging_goes_to_a_file(tmp_path):
    import logging

    cli.set_up_logging("warning", str(tmp_path / "logs" / "a.log"))
    logging.getLogger("lodestone").warning("seen")
    logging.getLogger("lodestone").info("not seen")
    text = (tmp_path / "logs" / "a.log").read_text()
    assert "WARNING lodestone: seen" in text and "not seen" not in text
    cli.set_up_logging("nonsense")
    assert logging.getLogger().level == logging.INFO


def test_history(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    assert history.load(spark, path, "d").count() == 0
    df = spark.createDataFrame([(0, "a", 0.5, "i", "t")], "ord long, prompt_text string, relevance_score double, search_intent string, topic_cluster string")
    for _ in range(12):
        history.append(df, path, "d", "2024-01-01 00:00:00")
    history.append(df, path, "other", "2024-01-01 00:00:00")
    assert sorted(r["run_seq"] for r in history.load(spark, path, "d").collect()) == list(range(2, 12))
    assert history.load_stage(spark, f"file://{tmp_path}/stages", "x") is None
    assert history.save_stage(df, f"file://{tmp_path}/stages", "x").count() == 1


def test_retries():
    calls = []

    def flaky(request):
        calls.append(1)
        if len(calls) < 3:
            raise RateLimited
        return "ok", {"prompt_tokens": 3}

    assert _send({}, flaky, Completion(spacing=0.0, backoff=0.0), Turn(0.0))["content"] == "ok"
    assert _send({}, lambda r: 1 / 0, QUICK, Turn(0.0))["error"].startswith("ZeroDivisionError")


def test_known_replies_are_not_asked_again(spark):
    rows = spark.createDataFrame([(1, "hello"), (2, "hello")], "id int, t string")
    service = Service(spark.createDataFrame([], RESPONSE), Recorded({"hello": "world"}), QUICK)
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("t").alias("content")))
    assert [r["content"] for r in service.ask(rows, "id", message, 0.3, 10).collect()] == ["world"] * 2
    assert service.known.count() == 1
    service.backend = Recorded({})
    assert [r["content"] for r in service.ask(rows, "id", message, 0.3, 10).collect()] == ["world"] * 2
    assert usage(service.known).first()["calls"] == 1
    rows = spark.createDataFrame([(i, f"hello {i}") for i in range(5)], "id int, t string")
    service.backend = Recorded({"hello": "again"})
    service.ask(rows, "id", message, 0.3, 10)
    assert service.counted == {k: v for k, v in usage(service.known).first().asDict().items() if k in service.counted}
    assert service.counted["calls"] == 6


@pytest.fixture
def chat_server():
    """An endpoint that answers with what it was asked; the first request of a text with 'busy' gets a 429."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from threading import Thread

    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = str(body["messages"][-1]["content"])
            again = any(text == str(b["messages"][-1]["content"]) for b, _ in asked)
            asked.append((body, self.headers.get("Authorization")))
            self.send_response(429 if "busy" in text and not again else 500 if "broken" in text else 200)
            self.end_headers()
            reply = {"choices": [{"message": {"content": None if "empty" in text else f"to {text}"}}], "usage": {"prompt_tokens": 7, "completion_tokens": 2, "prompt_tokens_details": {"cached_tokens": 3}}}
            self.wfile.write(json.dumps(reply).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1/chat", asked
    server.shutdown()


def test_chat_endpoint(spark, chat_server):
    from lodestone.sources.chat import ChatEndpoint

    url, asked = chat_server
    params = Completion(model="m", spacing=0.0, retries=2, backoff=0.0, cache_chars=20)
    service = Service(spark.createDataFrame([], RESPONSE), ChatEndpoint(url, "secret", params), params)
    rows = spark.createDataFrame([(1, "hello"), (2, "busy"), (3, "broken"), (4, "empty")], "id int, t string")
    said = F.array(F.struct(F.lit("system").alias("role"), F.lit("s" * 30).alias("content")), F.struct(F.lit("user").alias("role"), F.col("t").alias("content")))
    got = {r["id"]: (r["content"], (r["error"] or "").split(":")[0]) for r in service.ask(rows, "id", said, 0.3, 10).collect()}
    assert got == {1: ("to hello", ""), 2: ("to busy", ""), 3: (None, "HTTPError"), 4: (None, "ValueError")}
    body, key = asked[0]
    assert key == "Bearer secret" and (body["model"], body["temperature"], body["max_tokens"]) == ("m", 0.3, 10)
    assert body["messages"][0]["content"][0]["cache_control"] == {"type": "ephemeral"} and isinstance(body["messages"][1]["content"], str)
    assert service.counted == {"calls": 4, "prompt_tokens": 14, "completion_tokens": 4, "cached_tokens": 6}


@pytest.mark.parametrize("turns", [1, 3])
def test_endpoint_marks_are_those_of_the_native_form(spark, turns):
    from lodestone.sources.chat import marked

    messages = [("system", "x" * 30), *(("user", "y" * (10 * i + 5)) for i in range(turns + 2) if turns > 1 or i == 2), ("system", "z")]
    column = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in messages))
    native = [x["cache"] for x in spark.range(1).select(cache_marks(column, 20).alias("m")).first()["m"]]
    assert [isinstance(m["content"], list) for m in marked([{"role": r, "content": c} for r, c in messages], 20)] == native


def test_several_tasks_keep_one_spacing(spark, tmp_path):
    def backend(request):
        (tmp_path / request["messages"][0]["content"]).write_text(repr(time.time()))
        return "ok", {}

    rows = spark.createDataFrame([(i, f"call{i}") for i in range(12)], "id int, t string")
    wanted = requests(rows, "id", F.array(F.struct(F.lit("user").alias("role"), F.col("t").alias("content"))), 0.3, 10)
    got = completed(wanted, spark.createDataFrame([], RESPONSE), backend, Completion(spacing=0.2, backoff=0.0), partitions=4).collect()
    assert len(got) == 12
    at = sorted(float((tmp_path / f"call{i}").read_text()) for i in range(12))
    assert min(b - a for a, b in zip(at, at[1:], strict=False)) > 0.12  # 0.2 but for the delay of a sleep


def test_cache_marks(spark):
    m = F.array(*(F.struct(F.lit(r).alias("role"), F.lit("x" * n).alias("content")) for r, n in (("system", 30), ("user", 5), ("user", 40), ("user", 50), ("system", 2))))
    assert [x["cache"] for x in spark.range(1).select(cache_marks(m, 20).alias("m")).first()["m"]] == [True, False, True, False, False]


def test_whole_analysis(spark, tmp_path):
    item = lambda t, s: {"prompt_text": t, "relevance_score": s, "search_intent": "informational", "topic_cluster": "plates", "estimated_volume": "high"}
    replies = {
        "=== PAGE 1 ===": json.dumps({"prompts": [item("red plate", 0.9), item("Red Plate ", 0.95), item("blue cup", 0.5)]}),
        "- https://e.com": json.dumps({"additional_prompts": [item("best shop", 0.7)]}),
        "Argue": '{"confidence": 0.9}', "Attack": "{}", "Answer": "{}",
        "Judge": json.dumps({"accuracy_score": 0.9, "faithfulness_score": 0.9, "quality_score": 0.9, "quality_rating": "high", "overall_score": 0.9}),
        "Round": json.dumps({"verifications": [{"verdict": "verified", "confidence": 0.9}]}),
        "Pages:": json.dumps({"claims": [{"claim_text": "it is a plate"}]}),
        "Matching queries": json.dumps({"data_correlation_score": 0.8, "impact_score": 0.9, "recommendation": "do it", "reasoning": "because"}),
    }
    search = written(tmp_path, "query,clicks,impressions,ctr,position\nred plates,1,200,0.5%,12\n")
    traffic = written(tmp_path, "page path,sessions\n/a,30\n", "t.csv")
    params = Params(crawl=Crawl(delay=0.0), extraction=Extraction(top_n=10), factcheck=Factcheck(rounds=1), completion=QUICK)
    service = Service(spark.createDataFrame([], RESPONSE), Recorded(replies), QUICK)
    told = []
    run = Analysis(spark, params, service, fetch_site, f"file://{tmp_path}/out", "2024-01-01 00:00:00", lambda s, n: told.append(s))
    out = run.run("https://e.com", search_csv=search, traffic_csv=traffic).orderBy("priority_rank").collect()
    assert [r["prompt_text"] for r in out][0] == "red plate" and len(out) == 3
    assert out[0]["recommendation"] == "do it" and out[0]["matches"][0]["query"] == "red plates"
    assert {r["status"] for r in out} == {"factchecked"} and out[0]["traffic"]["page_path"] == "/a"
    assert told[0] == "pages" and told[-1] == "ranked"
    report = json.loads("\n".join(r["value"] for r in spark.read.text(f"file://{tmp_path}/out/report_json").collect()))
    assert report["summary"]["total_prompts"] == 3 and report["top_prompts"][0]["gsc_data"]["query"] == "red plates"
    assert run.results["drift"].first()["has_history"] is False
    again = Analysis(spark, params, service, fetch_site, f"file://{tmp_path}/out", "2024-01-02 00:00:00").run("https://e.com", search_csv=search, traffic_csv=traffic, skip_validation=True, skip_factcheck=True)
    assert again.count() == 3 and history.load(spark, f"file://{tmp_path}/out/runs", "e.com").select("run_seq").distinct().count() == 2


def test_command_line(tmp_path, capsys, spark):
    assert cli.main(["check-config"]) == 0 and "max_pages=500" in capsys.readouterr().out
    assert cli.main(["auth", "--service", "search", "--tokens", str(tmp_path)]) == 1
    assert cli.main(["preview-csv", "--search-csv", written(tmp_path, "query,clicks\nred plate,3\n")]) == 0
    assert "red plate" in capsys.readouterr().out
    assert cli.main(["analyze", "https://e.com"]) == 1


def test_signing_in(tmp_path):
    path, calls = str(tmp_path / "t" / "search.json"), []
    old = auth.Token("a", "r", 1000.0)

    def refresh(token):
        calls.append(token)
        return auth.Token("b", token.refresh, 9000.0)

    assert auth.sign_in(path, refresh) is None  # no token and nobody to ask
    assert auth.sign_in(path, refresh, lambda: old, now=lambda: 0.0) == old == auth.load_token(path) and not calls
    assert auth.sign_in(path, refresh, now=lambda: 100.0) == old  # valid still
    assert auth.sign_in(path, refresh, now=lambda: 950.0).access == "b" and calls == [old] and auth.load_token(path).access == "b"
    assert auth.sign_in(path, lambda t: 1 / 0, now=lambda: 9500.0) is None  # a failure is logged
    (tmp_path / "t" / "search.json").write_text("{broken")
    assert auth.load_token(path) is None


def test_tokens_and_rows_by_http(tmp_path, capsys):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            seen.append((self.path, self.headers.get("Authorization"), body))
            if self.path == "/token":
                grant = parse_qs(body)["grant_type"][0]
                reply = {"access_token": f"by-{grant}", "expires_in": 3600} | ({"refresh_token": "r2"} if grant == "authorization_code" else {})
            else:
                reply = {"rows": [{"keys": ["q"], "clicks": 1}]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(reply).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    file = tmp_path / "credentials.json"
    file.write_text(json.dumps({"installed": {"client_id": "c", "client_secret": "s", "auth_uri": f"{base}/auth", "token_uri": f"{base}/token"}}))
    credentials = auth.load_credentials(str(file))
    asked = []
    first = auth.console_consent(credentials, "read", lambda text: asked.append(text) or " code ")()
    assert first.access == "by-authorization_code" and first.refresh == "r2" and "scope=read" in asked[0]
    assert auth.refresher(credentials)(first) == auth.Token("by-refresh_token", "r2", pytest.approx(first.expires, abs=60))
    rows = auth.http_transport(f"{base}/sites/{{siteUrl}}/query", first)({"siteUrl": "https://a.b/", "startRow": 0})
    assert rows == [{"keys": ["q"], "clicks": 1}] and seen[-1][0] == "/sites/https%3A%2F%2Fa.b%2F/query" and seen[-1][1] == "Bearer by-authorization_code"
    auth.save_token(str(tmp_path / "tokens" / "search.json"), auth.Token("old", "r", 0.0))
    arguments = ["auth", "--credentials", str(file), "--tokens", str(tmp_path / "tokens")]
    assert cli.main([*arguments, "--service", "search"]) == 0 and "search: signed in" in capsys.readouterr().out
    assert cli.main(arguments) == 1 and "traffic: not signed in" in capsys.readouterr().out
    server.shutdown()


def test_analysis_goes_on_without_a_service(spark, tmp_path):
    run = Analysis(spark, Params(), None, fetch_site, f"file://{tmp_path}/out", "2024-01-01 00:00:00")

    def denied():
        raise PermissionError("no token")

    rows = spark.createDataFrame([(0, "/a")], "ord long, page_path string")
    search, traffic = run.metrics(None, None, denied, lambda: rows)
    assert search.count() == 0 and "query" in search.columns and traffic.count() == 1
