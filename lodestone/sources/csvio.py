"""Search and traffic exports: separator and header are found line by line, columns by the header's cells; Spark reads the records.

An export is a file, or a folder whose files follow each other by name; no record goes over the end of a file. Its splits are read by as many tasks. A first pass
finds for each split whether it ends within quotes, if it began outside of them and if it began within; from that follows how each begins. Then each task
puts its lines together to records, which are stored, and pieces of records that lie in several splits meet by a shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import number, percent, whole
from ..functions.text import trimmed
from ..operators.dedup import last_wins
from ..operators.metrics import merge_organic
from ..storage import leave_at_exit, shared_dir, stored

# Names that exports give to their columns, in the order in which they are tried.
SEARCH_NAMES = {
    "query": ["top queries", "queries", "query", "search query", "keyword", "top query"],
    "clicks": ["clicks", "click"],
    "impressions": ["impressions", "impression"],
    "ctr": ["ctr", "click-through rate", "click through rate"],
    "position": ["position", "average position", "avg position", "avg. position"],
}
SEARCH_PAGE_NAMES = {
    "page": ["top pages", "pages", "page", "url", "landing page"],
    "clicks": ["clicks", "click"],
    "impressions": ["impressions", "impression"],
    "ctr": ["ctr", "click-through rate", "click through rate"],
    "position": ["position", "average position", "avg position", "avg. position"],
}
TRAFFIC_NAMES = {
    "page_path": ["page path", "page path + query string", "page", "pages", "page path and screen class", "landing page", "landing page + query string", "page title and screen class", "page title"],
    "sessions": ["sessions", "session"],
    "users": ["users", "total users", "active users"],
    "pageviews": ["views", "pageviews", "page views", "screen page views", "screenPageViews"],
    "avg_session_duration": ["avg. session duration", "average session duration", "avg engagement time", "average engagement time per session", "avg. engagement time"],
    "bounce_rate": ["bounce rate", "bounceRate", "bounce rate (%)"],
    "conversions": ["conversions", "key events", "goal completions"],
}
SEPARATORS = ",;\t"  # of equally frequent ones the first
BOM = "\ufeff"


def _plain(name: str) -> str:
    return name.strip().lower().translate(str.maketrans("_-", "  "))


def separator(line: str) -> str:
    return max(SEPARATORS, key=line.count)


def places(header: list[str], names: dict[str, list[str]]) -> dict[str, int | None]:
    """For each field the cell that names it: of all cells that hold one of its names, the one of the earliest name, then the leftmost."""
    cells = [_plain(c) for c in header]
    out = {}
    for field, known in names.items():
        hits = ((rank, at) for at, c in enumerate(cells) for rank, name in enumerate(known) if _plain(name) in c)
        out[field] = min(hits, default=(None, None))[1]
    return out


def _may_be_header(line: Column, sep: str) -> Column:
    """A line with several cells of which one is like a known name; or any other that is neither blank nor a remark, "# ..." or "name: ..."."""
    known = sorted({x for names in (SEARCH_NAMES, TRAFFIC_NAMES) for many in names.values() for x in many})
    text = trimmed(line)
    cells = F.split(text, sep, -1)
    like = F.exists(F.transform(cells, lambda c: F.translate(F.lower(trimmed(c)), "_-", "  ")), lambda c: F.exists(F.array(*map(F.lit, known)), lambda k: F.contains(c, k) | F.contains(k, c)))
    remark = F.startswith(text, F.lit("#")) | F.contains(F.get(cells, 0), F.lit(":"))
    return (text != "") & (((F.size(cells) > 1) & like) | ~remark)


def layout(spark: SparkSession, path: str) -> tuple[str, int, str] | None:
    """The separator, the number of the line at which the header starts, and the path of that file; None for an empty export.

    The first line's characters give the separator. However many remarks stand before the header, the first line that may be one
    is looked for line by line; without one the export counts from its first line."""
    found = _start(spark, path)
    return found and (found.sep, found.at, found.file)


class Start(NamedTuple):
    """Where the records of an export begin: its separator, the header's line, the path to read, the first file in it that counts and the lines to skip there, and the end of
    its lines: line feed, with a carriage return or not, or None if carriage returns alone end them."""

    sep: str
    at: int
    path: str
    file: str
    skip: int
    end: str | None


def _lines(spark: SparkSession, path: str, sep: str | None = "\n") -> DataFrame:
    lines = spark.read.text(path, lineSep=sep)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _start(spark: SparkSession, path: str) -> Start | None:
    for file in sorted(spark.read.text(path).inputFiles()):
        first = _lines(spark, file).first()
        if first is not None:
            break
    else:
        return None
    value = first["value"].removeprefix(BOM)
    end = "\n" if "\r" not in value else "\r\n" if value.index("\r") == len(value) - 1 else None
    lines = _lines(spark, file, end and "\n").withColumn("at", F.monotonically_increasing_id())
    sep = separator(value if end else lines.first()["value"].removeprefix(BOM))
    found = lines.filter(_may_be_header(F.regexp_replace("value", f"^{BOM}", ""), sep)).select("at", "block").first()
    at = found["at"] if found else 0
    if not at or (end and not found["block"]):
        return Start(sep, at, path, first["file"], at, end)
    # a header beyond the first split of the file, or after carriage returns: one task copies the lines from it on, line by line, as a file keeps their order
    rest = f"{shared_dir(spark)}/lodestone-export-{uuid.uuid4().hex}"
    lines.filter(F.col("at") >= at).coalesce(1).select("value").write.text(rest)
    leave_at_exit(spark, rest)
    return Start(sep, at, rest, rest, 0, "\n")


def within_quotes(line: str, sep: str, within: bool) -> bool:
    """Whether a line ends within quotes. They open at the beginning of a cell alone and close at a quote that stands by itself; what follows up to the separator belongs to the cell."""
    if within or line.startswith('"'):
        at = 0 if within else 1
    else:
        at = line.find(f'{sep}"') + 2
        if at == 1:
            return False
    while True:
        at = line.find('"', at)
        while at >= 0 and line.startswith('"', at + 1):
            at = line.find('"', at + 2)
        if at < 0:
            return True
        at = line.find(f'{sep}"', at + 1) + 2
        if at == 1:
            return False


def _runs(batch: pa.RecordBatch, done: dict, start: Start) -> Iterator[tuple[tuple[str, int], int, list[str]]]:
    """The splits of a batch with the number of their first line in the batch, and their lines from the header on. done: lines of each split so far."""
    lines, files, blocks = (batch.column(i) for i in range(3))
    keys = list(zip(files.to_pylist(), blocks.to_pylist(), strict=True))
    a = 0
    while a < len(keys):
        b, key = a + 1, keys[a]
        while b < len(keys) and keys[b] == key:
            b += 1
        first = done.get(key, 0)
        done[key] = first + b - a
        drop = b - a if start.skip and key[0] < start.file else max(0, start.skip - first) if key == (start.file, 0) else 0
        some = [x.removesuffix("\r") if start.end == "\r\n" else x for x in lines.slice(a, b - a).to_pylist()[drop:]]
        if some:
            yield key, first + drop, some
        a = b


@contextmanager
def _same_splits(spark: SparkSession) -> Iterator[None]:
    """Within it, files are split alike each time, also if executors come or go."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _records(spark: SparkSession, start: Start) -> DataFrame:
    """ord, record: the records of an export from its header on, whatever splits they lie in."""
    lines, sep = _lines(spark, start.path), start.sep

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple[str, int], int] = {}
        now: dict[tuple[str, int], list[bool]] = {}
        for batch in batches:
            for key, _, some in _runs(batch, done, start):
                out, inside, closed = now.get(key, (False, True, False))
                for line in some:
                    # once both ways lead to the same state they stay together
                    both = out == inside
                    out = within_quotes(line, sep, out)
                    inside = out if both else within_quotes(line, sep, inside)
                    closed = closed or not inside
                now[key] = [out, inside, closed]
        if now:
            yield pa.RecordBatch.from_pydict({"file": [k[0] for k in now], "block": [k[1] for k in now], **{c: [x[i] for x in now.values()] for i, c in enumerate(("out", "inside", "closed"))}})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple[str, int], int] = {}
        key, held, at, within, owner = None, [], 0, False, -1
        for batch in batches:
            out: list[tuple[int, int, int, str]] = []
            for own, first, some in _runs(batch, done, start):
                n, of, begun = begins[own]
                if own != key:
                    if held:  # open at the end of a split
                        m = begins[key][0]
                        out.append((at, owner if owner >= 0 else m, m, "\n".join(held)))
                    key, held, at, within, owner = own, [], (n << 33) + first, begun, of if begun else -1
                for i, line in enumerate(some):
                    if not held:
                        if not (line or within):
                            continue
                        at = (n << 33) + first + i
                    held.append(line)
                    within = within_quotes(line, sep, within)
                    if not within:
                        out.append((at, owner, n, "\n".join(held)))
                        held, owner = [], -1
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["ord", "owner", "piece", "record"])
        if held:
            m = begins[key][0]
            yield pa.RecordBatch.from_pydict({"ord": [at], "owner": [owner if owner >= 0 else m], "piece": [m], "record": ["\n".join(held)]})

    with _same_splits(spark):
        splits = lines.mapInArrow(ends, "file string, block long, out boolean, inside boolean, closed boolean").collect()  # a row for each
        # in order, a split begins as the one before ended, and a file outside of quotes
        begins: dict[tuple[str, int], tuple[int, int, bool]] = {}
        last, within, owner, pieces = None, False, 0, False
        for n, x in enumerate(sorted(splits)):
            within = within and x["file"] == last
            begins[x["file"], x["block"]] = (n, owner, within)
            pieces = pieces or within or x["out"]
            if not within or x["closed"]:
                owner = n  # what is open at its end began in it
            last, within = x["file"], x["inside"] if within else x["out"]
        found = stored(lines.mapInArrow(whole, "ord long, owner long, piece long, record string"), "export")
    out = found.filter("owner < 0").select("ord", "record")
    if not pieces:
        return out
    parts = found.filter("owner >= 0").groupBy("owner").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("piece", "record"))).alias("all"))
    return out.unionByName(parts.select("ord", F.array_join("all.record", "\n").alias("record")))


def _rows(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]] | None:
    """Records after the header (ord, cells), and the header's cells. As many columns as the header may have; quoted cells may hold line breaks."""
    found = _start(spark, path)
    if found is None:
        return None
    sep = found.sep
    options = {"sep": sep, "quote": '"', "escape": '"', "header": False, "maxCharsPerColumn": -1}
    separators = lambda c: F.length(c) - F.length(F.replace(c, F.lit(sep), F.lit("")))
    if found.end is None:  # Spark splits no file at carriage returns alone
        most = spark.read.text(path).agg(F.max(separators("value"))).first()[0]
        records = spark.read.csv(path, multiLine=True, inferSchema=False, maxColumns=max(20_480, 4 * most), **options)
        if not records.columns:
            return None
        records = records.select(F.array(*(F.col(f"`{c}`") for c in records.columns)).alias("cells")).withColumn("ord", F.monotonically_increasing_id())
        header = records.first()
        if header is None:
            return None
        first, cells = header["ord"], header["cells"]
    else:
        texts = _records(spark, found)
        head = texts.agg(F.max(separators("record")).alias("most"), F.min(F.struct("ord", "record")).alias("first")).first()
        if head["first"] is None:
            return None
        first, record = head["first"]
        options["maxColumns"] = max(20_480, 2 + head["most"])
        kinds = ", ".join(f"_c{i} string" for i in range(record.count(sep) + 1))
        row = F.from_csv("record", F.lit(kinds), {k: str(v) for k, v in options.items()}).alias("row")
        records = texts.select("ord", row).select("ord", F.array("row.*").alias("cells"))
        cells = spark.createDataFrame([(record,)], "record string").select(row).select(F.array("row.*")).first()[0]
    cells = [c or "" for c in cells]
    return records.filter(F.col("ord") > first).select("ord", "cells"), [cells[0].removeprefix(BOM).strip('"') if i == 0 else c for i, c in enumerate(cells)]


def _cell(at: int | None) -> Column:
    return F.lit(None).cast("string") if at is None else F.get("cells", at)


def search_queries(spark: SparkSession, path: str) -> DataFrame:
    """A search-performance export (schema SEARCH). Rows without a query go; a file without a query column, or with an unreadable path, gives none."""
    return _search(spark, path, SEARCH_NAMES, "query")


def search_pages(spark: SparkSession, path: str) -> DataFrame:
    """The same by page."""
    return _search(spark, path, SEARCH_PAGE_NAMES, "page")


def _search(spark: SparkSession, path: str, names: dict[str, list[str]], first: str) -> DataFrame:
    empty = spark.createDataFrame([], f"ord long, {first} string, clicks long, impressions long, ctr double, position double, pages array<string>, date_range string")
    found = _read(spark, path)
    if found is None:
        return empty
    rows, header = found
    at = places(header, names)
    if at[first] is None:
        return empty
    rows = rows.withColumn("_key", trimmed(_cell(at[first]))).filter(F.coalesce(F.col("_key"), F.lit("")) != "")
    return rows.select("ord", F.col("_key").alias(first), whole(_cell(at["clicks"])).alias("clicks"), whole(_cell(at["impressions"])).alias("impressions"), percent(_cell(at["ctr"])).alias("ctr"), number(_cell(at["position"])).alias("position"), F.array().cast("array<string>").alias("pages"), F.lit("imported from CSV").alias("date_range"))


def _read(spark: SparkSession, path: str):
    """_rows(), or None where the path cannot be read."""
    from pyspark.errors import AnalysisException

    try:
        return _rows(spark, path)
    except AnalysisException:
        return None


def traffic_pages(spark: SparkSession, path: str) -> DataFrame:
    """A traffic export (schema TRAFFIC), organic sessions 0; of equal paths the last row in the first one's place."""
    found = _read(spark, path)
    kinds = "sessions long, users long, pageviews long, avg_session_duration double, bounce_rate double, conversions long, organic_sessions long"
    empty = spark.createDataFrame([], f"ord long, page_path string, {kinds}")
    if found is None:
        return empty
    rows, header = found
    at = places(header, TRAFFIC_NAMES)
    if at["page_path"] is None:
        return empty
    rows = rows.withColumn("_key", trimmed(_cell(at["page_path"]))).filter(F.coalesce(F.col("_key"), F.lit("")) != "")
    values = [whole(_cell(at[c])).alias(c) for c in ("sessions", "users", "pageviews")] + [number(_cell(at["avg_session_duration"])).alias("avg_session_duration"), percent(_cell(at["bounce_rate"])).alias("bounce_rate"), whole(_cell(at["conversions"])).alias("conversions"), F.lit(0).cast("long").alias("organic_sessions")]
    return last_wins(rows.select("ord", F.col("_key").alias("page_path"), *values), "page_path")


def organic_traffic(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """existing (schema TRAFFIC) with the sessions of an organic export as organic_sessions."""
    if existing is None:
        existing = traffic_pages(spark, path).limit(0)
    found = _read(spark, path)
    if found is None:
        return existing
    rows, header = found
    at = places(header, TRAFFIC_NAMES)
    page, sessions = at["page_path"], at["sessions"]
    if page is None:
        return existing
    rows = rows.withColumn("page_path", trimmed(_cell(page))).filter(F.coalesce(F.col("page_path"), F.lit("")) != "")
    return merge_organic(existing, rows.select("ord", "page_path", whole(_cell(sessions)).alias("organic_sessions")))
