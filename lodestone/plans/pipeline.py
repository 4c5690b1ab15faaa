"""The dataflow of a whole analysis: crawl, competitors, extraction, reconciliation, validation, fact checks, correlation, reports.

Stages are functions of relations; each stage's result is stored as a table before the next one reads it, since replies of a model and
of the web cannot be had twice.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import authority
from ..operators import claims, competitors, correlate, debate, extraction, lookup, reconcile, report
from ..operators.completion import Service
from ..operators.dedup import merge_new, numbered, top
from ..params import Params
from ..sources import csvio, history, web

Progress = Callable[[str, int], None]
#: A table of a service's rows, or a function that fetches it and may fail.
Rows = DataFrame | Callable[[], DataFrame] | None
log = logging.getLogger("lodestone")


@dataclass
class Analysis:
    """Parameters and collaborators; results appear as relations."""

    spark: SparkSession
    params: Params
    service: Service
    fetch: web.Fetch
    path: str
    timestamp: str
    progress: Progress | None = None
    results: dict[str, DataFrame] = field(default_factory=dict)

    def _store(self, name: str, df: DataFrame) -> DataFrame:
        out = history.save_stage(df, self.path, name)
        self.results[name] = out
        if self.progress:
            self.progress(name, out.count())
        return out

    def crawl(self, url: str) -> DataFrame:
        pages = self._store("pages", web.crawl(self.spark, url, self.fetch, self.params.crawl))
        if not pages.take(1):
            raise RuntimeError(f"no pages of {url}")
        return pages

    def competitors(self, url: str, pages: DataFrame, manual: list[str], limit: int = 5, max_pages: int = 15) -> tuple[DataFrame, DataFrame | None]:
        from dataclasses import replace

        near = replace(self.params.crawl, max_pages=max_pages, max_depth=3, respect_robots=True)
        rows, prompts = competitors.analyse(pages, url, manual, self.service, lambda sites: web.crawl_sites(self.spark.createDataFrame([(d,) for d in sites], "start string"), self.fetch, near), limit, self.params.extraction)
        return self._store("competitors", rows), None if prompts is None else self._store("competitor_prompts", prompts)

    def extract(self, pages: DataFrame, theirs: DataFrame | None = None, name: str = "prompts") -> DataFrame:
        mine = extraction.extract(pages, self.service, self.params.extraction)
        if theirs is not None:
            mine = numbered(merge_new(mine, theirs), "part", "ord").drop("part")
        prompts = self._store(name, mine)
        if not prompts.take(1):
            raise RuntimeError("no prompts were found")
        return prompts

    def reconcile(self, url: str, passes: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
        """Consensus of the passes, anchored to the domain's history; the drift from its last run; the run is appended before the cut to the wanted number."""
        p = self.params.reconcile
        domain = self.spark.range(1).select(authority(F.lit(url)).alias("d")).first()["d"]
        rows = None
        for i, df in enumerate(passes):
            part = df.withColumn("domain", F.lit(domain)).withColumn("pass", F.lit(i)).withColumn("ord", F.col("ord") + F.lit(i << 32))
            rows = part if rows is None else rows.unionByName(part)
        agreed = self._store("consensus", numbered(reconcile.consensus(rows, params=p).drop("pass", "appearances", "domain"), F.desc("relevance_score"), "ord"))
        runs = history.load(self.spark, f"{self.path}/runs", domain, p)
        stables = numbered(reconcile.stable(runs, p), F.desc("avg_score"), "ord")
        raised = reconcile.boosts(stables, agreed, p).drop("boost")
        back = reconcile.recovered(stables, agreed, p).select((F.col("ord") + F.lit(1 << 40)).alias("ord"), F.col("text").alias("prompt_text"), "relevance_score", "search_intent", "topic_cluster")
        both = self._store("anchored", raised.unionByName(back, allowMissingColumns=True).fillna({"status": "extracted", "estimated_volume": "medium", "difficulty": "medium"}).withColumn("source_urls", F.coalesce("source_urls", F.array().cast("array<string>"))))
        report_ = self._store("drift", reconcile.drift_report(both.select("ord", F.col("prompt_text").alias("text")), runs, p))
        history.append(both, f"{self.path}/runs", domain, self.timestamp)
        return self._store("reconciled", top(both, "relevance_score", self.params.extraction.top_n)), report_

    def validate(self, prompts: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
        results = self._store("validations", debate.debate(prompts, pages, self.service))
        return self._store("validated", lookup.with_status(prompts, results, self.params.extraction.min_quality)), results

    def check(self, prompts: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
        wanted = prompts.filter(F.col("status") == "validated")
        results = self._store("factchecks", claims.check(wanted, pages, self.service, self.params.factcheck))
        return self._store("factchecked", lookup.factchecked(prompts, results)), results

    def correlate(self, prompts: DataFrame, search: DataFrame, traffic: DataFrame, validations: DataFrame | None, factchecks: DataFrame | None) -> DataFrame:
        rows = lookup.active(prompts)
        for name, results in (("validation", validations), ("factcheck", factchecks)):
            if results is not None:
                rows = lookup.with_results(rows, results, name)
        return self._store("ranked", correlate.correlate(rows, search, traffic, self.service, self.params.match_threshold))

    def report(self, ranked: DataFrame, url: str, pages: int) -> None:
        if not ranked.take(1):
            raise ValueError("there is nothing to report")
        report.write_lines(report.json_report(ranked, url, self.timestamp, pages), f"{self.path}/report_json")
        report.write_csv(ranked, f"{self.path}/report_csv")
        text = report.text_report(ranked, url, self.timestamp, pages)
        self.spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(f"{self.path}/report_text")

    def _asked(self, service: str, source: Rows) -> DataFrame | None:
        """The rows of a service, stored; none if it cannot be signed in to or asked: the analysis goes on without it."""
        if source is None or isinstance(source, DataFrame):
            return source
        try:
            return self._store(f"{service}_rows", source())
        except Exception as e:  # noqa: BLE001
            log.warning("%s data are left out: %s", service, e)
            return None

    def metrics(self, search_csv: str | None, traffic_csv: str | None, search: Rows = None, traffic: Rows = None) -> tuple[DataFrame, DataFrame]:
        """Of each service: the export, else the rows of its API, a table or a function that signs in and fetches them, else none."""
        found = csvio.search_queries(self.spark, search_csv) if search_csv else self._asked("search", search)
        seen = csvio.traffic_pages(self.spark, traffic_csv) if traffic_csv else self._asked("traffic", traffic)
        none = lambda kind: self.spark.createDataFrame([], kind)
        from ..schema import SEARCH, TRAFFIC

        return (none(SEARCH) if found is None else found), (none(TRAFFIC) if seen is None else seen)

    def run(self, url: str, *, manual: list[str] | None = None, with_competitors: bool = False, passes: int = 1, skip_validation: bool = False, skip_factcheck: bool = False, search_csv: str | None = None, traffic_csv: str | None = None, search: Rows = None, traffic: Rows = None) -> DataFrame:
        """Every stage in order; the ranked prompts."""
        pages = self.crawl(url)
        theirs = self.competitors(url, pages, manual or [])[1] if with_competitors or manual else None
        found = [self.extract(pages, theirs)] + [self.extract(pages, name=f"prompts_{i}") for i in range(1, passes)]
        prompts, _ = self.reconcile(url, found)
        validations = factchecks = None
        if skip_validation:
            prompts = lookup.skipped_validation(prompts)
        else:
            prompts, validations = self.validate(prompts, pages)
        if skip_factcheck:
            prompts = lookup.factchecked(prompts, None)
        else:
            prompts, factchecks = self.check(prompts, pages)
        ranked = self.correlate(prompts, *self.metrics(search_csv, traffic_csv, search, traffic), validations, factchecks)
        self.report(ranked, url, pages.count())
        return ranked
