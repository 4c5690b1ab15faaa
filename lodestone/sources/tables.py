"""Table functions for SQL: one page or sitemap in, a row for each address out.

    SELECT page_id, link.href FROM pages, LATERAL page_links(html) AS link
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.pages import links_of
from .web import locations


class SitemapUrls:
    """pos and url of a sitemap's entries, in order; none for null and for what is not well formed."""

    def eval(self, xml: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(locations(xml, "url") if xml is not None else [])


class PageLinks:
    """pos and href of a page's links, as the page has them, in order; none for null."""

    def eval(self, html: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(links_of(html) if html is not None else [])


def register(spark: SparkSession) -> None:
    """Makes sitemap_urls(xml) and page_links(html) known to SQL."""
    spark.udtf.register("sitemap_urls", F.udtf(SitemapUrls, returnType="pos int, url string", useArrow=True))
    spark.udtf.register("page_links", F.udtf(PageLinks, returnType="pos int, href string", useArrow=True))
