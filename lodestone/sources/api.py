"""Rows of the search and analytics services as a Python data source.

A transport (callable) gives one page of a request's rows. Partitions are pages, planned by their first row up to the limit, and are fetched in
parallel. Filters on dimensions that the service can apply (equal, contains, begins with) travel with the request, others stay with
Spark. Captured replies are text files that Spark reads.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringContains, StringStartsWith

from ..operators.dedup import last_wins
from ..operators.metrics import landing_pages, search_rollup

#: (request as a dict) -> rows as dicts.
Transport = Callable[[dict], list[dict]]
API_ROWS = 25_000
#: What the service calls the filters that it applies to a dimension.
PUSHED = {EqualTo: "equals", StringContains: "contains", StringStartsWith: "beginsWith"}
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class _Page(InputPartition):
    def __init__(self, start: int):
        super().__init__(start)
        self.start = start


class _Reader(DataSourceReader):
    def __init__(self, transport: Transport, request: dict, limit: int, page: int, push: bool):
        self.transport, self.request, self.limit, self.page, self.push = transport, request, limit, page, push
        self.filters: list[dict] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  the name that Spark calls
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") else None
            if self.push and type(f) in PUSHED and column in self.request["dimensions"] and isinstance(f.value, str):
                self.filters.append({"dimension": column, "operator": PUSHED[type(f)], "expression": f.value})
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Page(i) for i in range(0, max(self.limit, 1), self.page)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        start = partition.start
        asked = self.request | {"startRow": start, "rowLimit": min(self.page, self.limit - start)}
        for i, row in enumerate(self.transport(asked | ({"filters": self.filters} if self.filters else {}))):
            keys = row.get("keys")
            found = dict(zip(self.request["dimensions"], keys, strict=False)) if keys is not None else row
            yield (start + i, *(found.get(d) for d in self.request["dimensions"]), json.dumps(row))


def service_rows(transport: Transport) -> type[DataSource]:
    """A data source of a service: ord, the request's dimensions as texts, and value, the row as JSON; options request, limit, page and push."""

    class ServiceRows(DataSource):
        @classmethod
        def name(cls) -> str:
            return "service_rows"

        def request(self) -> dict:
            found = json.loads(self.options["request"])
            return found | {"dimensions": found.get("dimensions", [])}

        def schema(self) -> str:
            return ", ".join(["ord long", *(f"`{d}` string" for d in self.request()["dimensions"]), "value string"])

        def reader(self, schema) -> DataSourceReader:
            return _Reader(transport, self.request(), int(self.options.get("limit", 5000)), int(self.options.get("page", API_ROWS)), self.options.get("push") == "true")

    return ServiceRows


def requested(spark: SparkSession, transport: Transport, request: dict, limit: int = 5000, page: int = API_ROWS, push: bool = False) -> DataFrame:
    """Rows (ord, the dimensions, value) of a request; its pages in parallel, up to limit rows, which the service counts after its filters.

    push: filters on dimensions travel with the request. Spark keeps what one scan of a load has pushed for its other scans, too, so a frame with push may stand
    in a query once; in further queries it may be filtered anew."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(service_rows(transport))
    options = {"request": json.dumps(request), "limit": limit, "page": page, "push": str(push).lower()}
    # a filter that always holds makes Spark ask for what is to be pushed in each query
    return spark.read.format("service_rows").options(**options).load().filter("ord >= 0")


def captured(spark: SparkSession, path: str, limit: int = 5000) -> DataFrame:
    """Rows (ord, value) of captured replies: text files of one JSON object for each row, in the service's order."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), "value").orderBy("ord").limit(limit)


def search_request(site: str, start: str, end: str, dimensions: tuple[str, ...] = ("query", "page")) -> dict:
    return {"siteUrl": site, "startDate": start, "endDate": end, "dimensions": list(dimensions)}


def search_queries(rows: DataFrame) -> DataFrame:
    """Queries rolled up from rows of query and page; rows with fewer keys go."""
    r = F.from_json("value", "keys array<string>, clicks double, impressions double")
    read = rows.select("ord", r.alias("r")).filter(F.size("r.keys") >= 2)
    flat = read.select("ord", F.get("r.keys", 0).alias("query"), F.get("r.keys", 1).alias("page"), F.coalesce("r.clicks", F.lit(0)).cast("long").alias("clicks"), F.coalesce("r.impressions", F.lit(0)).cast("long").alias("impressions"))
    order = flat.groupBy("query").agg(F.min("ord").alias("ord"))
    return search_rollup(flat).join(order, "query")


def search_pages(rows: DataFrame) -> DataFrame:
    """Metrics by page; of equal pages the last row."""
    r = F.from_json("value", "keys array<string>, clicks double, impressions double, ctr double, position double")
    flat = rows.select("ord", r.alias("r")).filter(F.size("r.keys") >= 1)
    zero = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(0.0))
    return last_wins(flat.select("ord", F.get("r.keys", 0).alias("page"), zero("clicks").cast("long").alias("clicks"), zero("impressions").cast("long").alias("impressions"), zero("ctr").alias("ctr"), zero("position").alias("position")), "page")


def traffic_request(property_id: str, start: str, end: str, organic: bool, limit: int = 5000) -> dict:
    """A report by page path, most sessions first; the organic one filters by channel at the service."""
    metrics = ["sessions", "totalUsers", "screenPageViews", "bounceRate"] if organic else ["sessions", "totalUsers", "screenPageViews", "averageSessionDuration", "bounceRate", "conversions"]
    request = {"property": property_id, "startDate": start, "endDate": end, "dimensions": ["pagePath"], "metrics": metrics, "orderBy": "-sessions", "limit": limit}
    return request | ({"filter": {"sessionDefaultChannelGroup": "Organic Search"}} if organic else {})


def traffic_pages(rows: DataFrame, organic: bool = False) -> DataFrame:
    """Schema TRAFFIC from report rows, whose values are texts."""
    r = F.from_json("value", "pagePath string, sessions string, totalUsers string, screenPageViews string, averageSessionDuration string, bounceRate string, conversions string")
    v = rows.select("ord", r.alias("r"))
    n = lambda c, t: F.coalesce(F.col(f"r.{c}").try_cast("double"), F.lit(0.0)).cast(t)
    zero = F.lit(0).cast("long")
    return v.select(
        "ord", F.col("r.pagePath").alias("page_path"), (zero if organic else n("sessions", "long")).alias("sessions"), n("totalUsers", "long").alias("users"), n("screenPageViews", "long").alias("pageviews"),
        (F.lit(0.0) if organic else n("averageSessionDuration", "double")).alias("avg_session_duration"), n("bounceRate", "double").alias("bounce_rate"), (zero if organic else n("conversions", "long")).alias("conversions"), (n("sessions", "long") if organic else zero).alias("organic_sessions"),
    )


def landing(pages: DataFrame, organic: DataFrame) -> DataFrame:
    return landing_pages(traffic_pages(pages), traffic_pages(organic, organic=True))


def site_for(sites: list[str], domain: str, configured: str = "") -> str | None:
    """The configured site, else the first listed one that contains the domain."""
    return configured or next((s for s in sites if domain in s), None)
