"""Parameters of all operators, passed explicitly; nothing reads the environment but load()."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Crawl:
    max_pages: int = 500
    delay: float = 1.0
    timeout: int = 30
    respect_robots: bool = True
    max_depth: int = 5
    user_agent: str = "lodestone/1.0"
    first_words: int = 5
    other_words: int = 10


@dataclass(frozen=True)
class Extraction:
    top_n: int = 500
    batch: int = 10
    chunk: int = 100
    min_quality: float = 0.7


@dataclass(frozen=True)
class Factcheck:
    threshold: float = 0.8
    max_claims: int = 10
    rounds: int = 3


@dataclass(frozen=True)
class Completion:
    model: str = "default"
    temperature: float = 0.3
    max_tokens: int = 4096
    timeout: int = 120
    retries: int = 3
    spacing: float = 0.5
    #: Seconds of the first pause after a failed call; it doubles with each.
    backoff: float = 1.0
    cache_chars: int = 2048


@dataclass(frozen=True)
class Reconcile:
    similarity: float = 0.80
    consensus: float = 0.5
    anchor_weight: float = 0.3
    recover_stability: float = 0.6
    recover_factor: float = 0.9
    kept_runs: int = 10
    recent_runs: int = 5
    #: True: appearances count passes, not occurrences, and the minimum is rounded up.
    strict: bool = False


@dataclass(frozen=True)
class Params:
    crawl: Crawl = field(default_factory=Crawl)
    extraction: Extraction = field(default_factory=Extraction)
    factcheck: Factcheck = field(default_factory=Factcheck)
    completion: Completion = field(default_factory=Completion)
    reconcile: Reconcile = field(default_factory=Reconcile)
    match_threshold: float = 0.5
    match_top: int = 10
    lookback_days: int = 90
    row_limit: int = 5000
    site_url: str = ""
    property_id: str = ""
    output_dir: str = "output"


def truthy(text: str) -> bool:
    return text.strip().lower() in ("true", "1", "yes")


def load(env: Mapping[str, str] | None = None) -> Params:
    """Parameters from settings such as CRAWL_MAX_PAGES; what is missing or empty keeps its default."""
    env = os.environ if env is None else env

    def group(kind: type, prefix: str):
        default = kind()
        found = {}
        for name, value in vars(default).items():
            raw = env.get(f"{prefix}_{name}".upper(), "")
            if raw:
                found[name] = truthy(raw) if isinstance(value, bool) else type(value)(raw)
        return kind(**found)

    plain = Params()
    return Params(
        crawl=group(Crawl, "crawl"),
        extraction=group(Extraction, "extraction"),
        factcheck=group(Factcheck, "factcheck"),
        completion=group(Completion, "completion"),
        reconcile=group(Reconcile, "reconcile"),
        match_threshold=float(env.get("MATCH_THRESHOLD") or plain.match_threshold),
        lookback_days=int(env.get("LOOKBACK_DAYS") or plain.lookback_days),
        row_limit=int(env.get("ROW_LIMIT") or plain.row_limit),
        site_url=env.get("SITE_URL", ""),
        property_id=env.get("PROPERTY_ID", ""),
        output_dir=env.get("OUTPUT_DIR") or plain.output_dir,
    )
