"""Command line: analyze, crawl, check-config, auth, preview-csv."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import impact_tier
from ..operators.completion import Recorded, Service
from ..params import Params, load
from ..schema import RESPONSE
from ..sources import auth, csvio, web
from ..sources.chat import ChatEndpoint
from .pipeline import Analysis


def session() -> SparkSession:
    return SparkSession.builder.appName("lodestone").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--log-level", default="INFO")
    p.add_argument("--log-file", help="file that gets what is logged, too")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze", help="analyse a site")
    a.add_argument("url")
    a.add_argument("--max-pages", type=int, default=0)
    a.add_argument("--top-n", type=int, default=0)
    a.add_argument("--model", default="")
    a.add_argument("--passes", type=int, default=1)
    a.add_argument("--competitors", default="", help="domains, separated by commas")
    a.add_argument("--find-competitors", action="store_true")
    a.add_argument("--skip-validation", action="store_true")
    a.add_argument("--skip-factcheck", action="store_true")
    a.add_argument("--search-csv")
    a.add_argument("--traffic-csv")
    a.add_argument("--output-dir", default="")
    a.add_argument("--replies", help="JSON file: fragments of requests to recorded replies")
    a.add_argument("--endpoint", help="address that takes chat messages")
    a.add_argument("--key-env", default="COMPLETION_KEY", help="environment variable that holds the endpoint's key")
    a.add_argument("--tasks", type=int, default=1, help="tasks that call at once; together they keep the spacing of calls")
    a.add_argument("--verbose", action="store_true")
    c = sub.add_parser("crawl", help="list a site's pages")
    c.add_argument("url")
    c.add_argument("--max-pages", type=int, default=50)
    sub.add_parser("check-config", help="show the parameters")
    u = sub.add_parser("auth", help="sign in to services, or renew their tokens")
    u.add_argument("--service", choices=("search", "traffic", "both"), default="both")
    u.add_argument("--credentials", default="credentials.json", help="JSON file with client_id, client_secret, auth_uri and token_uri")
    u.add_argument("--tokens", default="tokens", help="folder of the services' tokens")
    u.add_argument("--scope", default="", help="scope to ask consent for")
    v = sub.add_parser("preview-csv", help="show what would be read from exports")
    v.add_argument("--search-csv")
    v.add_argument("--traffic-csv")
    return p


def set_up_logging(level: str, file: str | None = None) -> None:
    """Messages of a level and above go to standard error and, if one is named, to a file, whose folder is made; an unknown level counts as INFO."""
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if file:
        os.makedirs(os.path.dirname(os.path.abspath(file)), exist_ok=True)
        handlers.append(logging.FileHandler(file, encoding="utf-8"))
    known = logging.getLevelNamesMapping().get(level.upper(), logging.INFO)
    logging.basicConfig(level=known, format="%(asctime)s %(levelname)s %(name)s: %(message)s", handlers=handlers, force=True)
    logging.getLogger("py4j").setLevel(logging.WARNING)


def overridden(params: Params, args: argparse.Namespace) -> Params:
    """Parameters with those of the command line that are set; 0 and empty count as not set."""
    if args.max_pages:
        params = replace(params, crawl=replace(params.crawl, max_pages=args.max_pages))
    if args.top_n:
        params = replace(params, extraction=replace(params.extraction, top_n=args.top_n))
    if args.model:
        params = replace(params, completion=replace(params.completion, model=args.model))
    if args.output_dir:
        params = replace(params, output_dir=args.output_dir)
    return params


def analyze(args: argparse.Namespace, params: Params) -> int:
    spark = session()
    if args.replies:
        with open(args.replies, encoding="utf-8") as f:
            backend = Recorded(json.load(f))
    elif args.endpoint:
        backend = ChatEndpoint(args.endpoint, os.environ.get(args.key_env, ""), params.completion)
    else:
        print("a completion backend is needed: pass --endpoint or --replies, or use plans.pipeline with one of your own", file=sys.stderr)
        return 1
    service = Service(spark.createDataFrame([], RESPONSE), backend, params.completion, args.tasks)
    now = datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
    log = logging.getLogger("lodestone")
    tell = (lambda stage, n: log.info("%s: %s rows", stage, n)) if args.verbose else None
    run = Analysis(spark, params, service, web.http_fetch(params.crawl), params.output_dir, now, tell)
    manual = [d for d in args.competitors.split(",") if d.strip()]
    ranked = run.run(web.with_scheme(args.url), manual=manual, with_competitors=args.find_competitors, passes=args.passes, skip_validation=args.skip_validation, skip_factcheck=args.skip_factcheck, search_csv=args.search_csv, traffic_csv=args.traffic_csv)
    shown = ranked.orderBy("priority_rank").limit(20)
    shown.select("priority_rank", "prompt_text", "impact_score", impact_tier(F.col("impact_score")).alias("tier"), "recommendation").show(20, truncate=60)
    return 0


def preview(args: argparse.Namespace) -> int:
    spark = session()
    for path, read in ((args.search_csv, csvio.search_queries), (args.traffic_csv, csvio.traffic_pages)):
        if path:
            rows = read(spark, path)
            n = rows.count()
            rows.orderBy("ord").limit(20).drop("ord").show(20, truncate=50)
            if n > 20:
                print(f"... and {n - 20} more")
    return 0


def check(params: Params) -> int:
    print(params)
    folder = os.path.isdir(params.output_dir)
    print(f"output folder {params.output_dir}: {'there' if folder else 'will be made'}")
    return 0


def sign_in(args: argparse.Namespace) -> int:
    """A valid token of each service in the folder of tokens; 1 if one cannot be had."""
    services = ("search", "traffic") if args.service == "both" else (args.service,)
    try:
        credentials = auth.load_credentials(args.credentials)
        refresh, consent = auth.refresher(credentials), auth.console_consent(credentials, args.scope) if args.scope else None
    except (OSError, ValueError, StopIteration):
        logging.getLogger("lodestone").warning("no credentials at %s: tokens cannot be renewed", args.credentials)
        credentials, refresh, consent = None, None, None
    done = True
    for service in services:
        token = auth.sign_in(os.path.join(args.tokens, f"{service}.json"), refresh, consent)
        print(f"{service}: {'signed in' if token else 'not signed in'}")
        done = done and token is not None
    return 0 if done else 1


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    set_up_logging(args.log_level, args.log_file)
    params = load()
    try:
        if args.command == "analyze":
            return analyze(args, overridden(params, args))
        if args.command == "crawl":
            small = replace(params.crawl, max_pages=args.max_pages)
            web.crawl(session(), args.url, web.http_fetch(small), small).select("url", "depth", "word_count", "title").show(args.max_pages, truncate=60)
            return 0
        if args.command == "check-config":
            return check(params)
        if args.command == "auth":
            return sign_in(args)
        return preview(args)
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
