"""URL columns: normal forms, domains, page predicates."""

from __future__ import annotations

from urllib.parse import urljoin
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Endings of paths that are no pages.
FILE_ENDINGS = (
    "pdf", "jpg", "jpeg", "png", "gif", "svg", "webp", "mp4", "mp3", "avi", "mov", "zip", "tar", "gz",
    "css", "js", "xml", "json", "ico", "woff", "woff2", "ttf", "eot", "map",
)
# Parts of paths that hold no content.
CLOSED_PATHS = ("/wp-admin", "/wp-login", "/admin", "/login", "/logout", "/cart", "/checkout", "/account", "/api/", "/feed")
# Domains that are never competitors; a domain that contains one is skipped, too.
GENERAL_DOMAINS = (
    "google.com", "youtube.com", "facebook.com", "twitter.com", "instagram.com", "linkedin.com", "github.com", "wikipedia.org",
    "amazon.com", "apple.com", "microsoft.com", "w3.org", "schema.org", "fonts.googleapis.com", "cdn.jsdelivr.net", "cloudflare.com",
    "googleapis.com", "gstatic.com", "pinterest.com", "reddit.com", "tiktok.com", "x.com",
)


def normal_url(u: Column) -> Column:
    """Without fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(u, r"#.*$", ""), r"/+$", "")


def authority(u: Column) -> Column:
    """The part between // and the path, with user and port; empty if there is none."""
    return F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path(u: Column) -> Column:
    """The path without query, fragment and parameters of its last part."""
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*:(?=//)", "")
    rest = F.regexp_replace(rest, r"^//[^/?#]*", "")
    return F.regexp_replace(F.regexp_extract(rest, r"^([^?#]*)", 1), r";[^/]*$", "")


def domain(u: Column) -> Column:
    """The authority in lower case without www."""
    return bare(authority(u))


def bare(d: Column) -> Column:
    return F.regexp_replace(F.lower(d), r"^www\.", "")


def same_domain(u: Column, site: Column) -> Column:
    """Sub-domains are foreign. site: an authority."""
    return domain(u) == bare(site)


def is_page(u: Column) -> Column:
    p = F.lower(path(u))
    files = r"\.(?:" + "|".join(FILE_ENDINGS) + ")$"
    return ~p.rlike(files) & ~p.rlike("|".join(CLOSED_PATHS))


def competitor_domain(d: Column, target: Column) -> Column:
    """True for a domain that may be a competitor of target."""
    general = F.array(*(F.lit(x) for x in GENERAL_DOMAINS))
    return (d != "") & (d != bare(target)) & ~F.exists(general, lambda g: F.contains(d, g))


def manual_domain(c: Column) -> Column:
    """A domain as typed by hand: scheme, www and trailing slashes go."""
    t = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    for prefix in ("https://", "http://", r"www\."):
        t = F.regexp_replace(t, f"^{prefix}", "")
    return F.regexp_replace(t, r"/+$", "")


def other_slash(p: Column) -> Column:
    """The path with its trailing slashes taken off, or with one if it has none."""
    return F.when(F.endswith(p, F.lit("/")), F.regexp_replace(p, r"/+$", "")).otherwise(F.concat(p, F.lit("/")))


@F.pandas_udf(T.StringType())
def url_join(base: pd.Series, ref: pd.Series) -> pd.Series:
    """ref resolved against base; null where either is null or no URL."""

    def one(b, r):
        try:
            return None if b is None or r is None else urljoin(b, r)
        except ValueError:
            return None

    return pd.Series([one(b, r) for b, r in zip(base, ref, strict=True)], dtype="object")


@F.pandas_udf(T.BooleanType())
def robots_allowed(robots: pd.Series, agent: pd.Series, url: pd.Series) -> pd.Series:
    """Whether the rules in the text of a robots file let agent fetch url; no text allows all."""
    parsers: dict[str, RobotFileParser] = {}

    def one(text, who, u):
        if text is None:
            return True
        if text not in parsers:
            parsers[text] = RobotFileParser()
            parsers[text].parse(text.splitlines())
        return parsers[text].can_fetch(who, u)

    return pd.Series([one(*x) for x in zip(robots, agent, url, strict=True)], dtype="bool")
