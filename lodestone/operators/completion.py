"""The boundary to a completion service.

Requests are rows with a hash; replies are a table by hash. Only requests without a reply are sent, by mapInPandas over
few partitions, and what comes back is stored before anything reads it, so that a retried task or a lost executor costs calls but never
changes a reply that was used. Replies are parsed natively.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..params import Completion
from ..schema import RESPONSE
from ..storage import stored

#: A backend takes a request (dict of REQUEST's fields) and gives (content, usage dict); it raises RateLimited or any other error.
Backend = Callable[[dict], tuple[str, dict]]


#: Requests that a task holds as Python objects at a time.
AT_ONCE = 64


class RateLimited(Exception):
    """The service asks for a pause."""


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def requests(df: DataFrame, key: str, messages: Column, temperature: float, max_tokens: int) -> DataFrame:
    """key, request_hash, messages, temperature, max_tokens."""
    hashed = F.sha2(F.concat_ws("\u0001", F.to_json(messages), F.lit(str(temperature)), F.lit(str(max_tokens))), 256)
    return df.select(F.col(key).alias("key"), hashed.alias("request_hash"), messages.alias("messages"), F.lit(temperature).alias("temperature"), F.lit(max_tokens).alias("max_tokens"))


class Turn:
    """When a task may call: one task keeps the spacing since its last call; several, which a barrier starts together, have turns one spacing apart.

    The tasks agree on the latest of their clocks as the beginning; a task that is late takes its next turn and leaves the others theirs."""

    def __init__(self, spacing: float, tasks: int = 1):
        self.spacing, self.tasks, self.own, self.next, self.last = spacing, tasks, 0, 0, -math.inf
        if tasks > 1:
            together = BarrierTaskContext.get()
            self.own = together.partitionId()
            self.start = max(map(float, together.allGather(repr(time.time()))))

    def wait(self) -> None:
        if self.tasks == 1 or not self.spacing:
            time.sleep(max(0.0, self.spacing - (time.monotonic() - self.last)))
            self.last = time.monotonic()
            return
        first, every = self.start + self.own * self.spacing, self.tasks * self.spacing
        turn = max(self.next, math.ceil((time.time() - first) / every))
        time.sleep(max(0.0, first + turn * every - time.time()))
        self.next = turn + 1


def _send(request: dict, backend: Backend, params: Completion, turn: Turn) -> dict:
    """One call with pauses and retries; a pause of the service's asking follows the last try, too."""
    error = None
    for attempt in range(params.retries):
        if attempt == 0:
            turn.wait()
        try:
            content, usage = backend(request)
            return {"content": content, "error": None} | {k: int(usage.get(k, 0)) for k in ("prompt_tokens", "completion_tokens", "cached_tokens")}
        except RateLimited as e:
            error = e
            time.sleep(params.backoff * min(2 ** (attempt + 1), 60))
        except Exception as e:  # noqa: BLE001  any failure of a service is a failed reply
            error = e
            time.sleep(params.backoff * 2**attempt)
    return {"content": None, "error": f"{type(error).__name__}: {error}", "prompt_tokens": 0, "completion_tokens": 0, "cached_tokens": 0}


def completed(wanted: DataFrame, known: DataFrame, backend: Backend | None, params: Completion = Completion(), partitions: int | None = 1) -> DataFrame:
    """Replies (schema RESPONSE) to wanted that known lacks. partitions: how many tasks may call at once; together they keep the spacing.

    More than one run in a barrier stage, for which the cluster needs as many free slots. None: as many as the requests' shuffle
    makes, for a backend without spacing. Store the result before use. Without a backend nothing is sent."""
    if partitions is None and params.spacing:
        raise ValueError("calls with a spacing need a number of tasks")
    fresh = wanted.dropDuplicates(["request_hash"]).join(known.select("request_hash"), "request_hash", "left_anti")
    if backend is None:
        return known.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([(name, pa.string() if of == "string" else pa.int64()) for name, of in (x.split() for x in RESPONSE.split(", "))])
        turn = Turn(params.spacing, partitions or 1)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                rows = [{"request_hash": r["request_hash"]} | _send(r, backend, params, turn) for r in batch.slice(at, AT_ONCE).to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, kind)

    asked = fresh.select("request_hash", "messages", "temperature", "max_tokens")
    return (asked if partitions is None else asked.repartition(partitions)).mapInArrow(run, RESPONSE, barrier=(partitions or 1) > 1)


def answered(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """key, content and error of each request."""
    return wanted.select("key", "request_hash").join(known.select("request_hash", "content", "error"), "request_hash", "left").drop("request_hash")


def rescued(reply: Column) -> Column:
    """A reply's JSON as text: the whole, else from the first { to the last }, else {"items": [...]} of the brackets; null if none parses."""
    between = lambda a, b: F.regexp_extract(reply, rf"(?s)(\{a}.*\{b})", 1)
    good = lambda c: F.when(F.try_parse_json(F.nullif(c, F.lit(""))).isNotNull(), c)
    items = F.concat(F.lit('{"items":'), good(between("[", "]")), F.lit("}"))
    return F.coalesce(good(reply), good(between("{", "}")), items)


def read_reply(reply: Column, schema: str) -> Column:
    """The reply as a struct; null if it is no JSON."""
    return F.from_json(rescued(reply), schema)


def cache_marks(messages: Column, least: int = 2048) -> Column:
    """messages with a flag cache: long system messages, and the first long user message if there are several user messages."""
    users = F.size(F.filter(messages, lambda m: m["role"] == "user"))
    long_ = lambda m: F.length(F.coalesce(m["content"], F.lit(""))) >= least
    first = F.array_position(F.transform(messages, lambda m: (m["role"] == "user") & long_(m)), F.lit(True))
    return F.transform(
        messages,
        lambda m, i: F.struct(m["role"].alias("role"), m["content"].alias("content"), (((m["role"] == "system") & long_(m)) | ((users > 1) & (i + 1 == first))).alias("cache")),
    )


TOKENS = ("prompt_tokens", "completion_tokens", "cached_tokens")


def _counters() -> list[Column]:
    return [F.count(F.lit(1)).alias("calls"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in TOKENS)]


def usage(calls: DataFrame) -> DataFrame:
    """One row: calls, tokens, cached tokens and the share of cost that caching saved."""
    sums = calls.agg(*_counters())
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    saved = F.when(total > 0, F.round(F.lit(0.9) * F.col("cached_tokens") / F.greatest(F.col("prompt_tokens"), F.lit(1)) * 100, 1)).otherwise(F.lit(0.0))
    return sums.select("*", saved.alias("estimated_savings_pct"))


class Recorded:
    """A backend that replays: fragments of the last message's content to replies; the first that is contained answers."""

    def __init__(self, replies: dict[str, str]):
        self.replies = replies

    def __call__(self, request: dict) -> tuple[str, dict]:
        last = list(request["messages"])[-1]
        content = last["content"]
        for fragment, reply in self.replies.items():
            if fragment in content:
                return reply, {"prompt_tokens": len(content) // 4, "completion_tokens": len(reply) // 4}
        raise LookupError("no recorded reply")


class Service:
    """Runs requests through known replies and a backend; store(df) makes a table of new replies that later steps read.

    counted has the calls and tokens so far, observed while new replies are written."""

    def __init__(self, known: DataFrame, backend: Backend | None = None, params: Completion = Completion(), partitions: int | None = 1, store: Callable[[DataFrame], DataFrame] | None = None):
        self.known, self.backend, self.params, self.partitions = known, backend, params, partitions
        self.store = store or stored
        self.counted = dict.fromkeys(("calls", *TOKENS), 0)

    def ask(self, df: DataFrame, key: str, messages: Column, temperature: float, max_tokens: int) -> DataFrame:
        """key, content, error for each row of df."""
        wanted = requests(df, key, messages, temperature, max_tokens)
        if self.backend is not None:
            seen = Observation()
            new = self.store(completed(wanted, self.known, self.backend, self.params, self.partitions).observe(seen, *_counters()))
            self.counted = {k: n + seen.get[k] for k, n in self.counted.items()}
            self.known = self.known.unionByName(new)
        return answered(wanted, self.known).withColumnRenamed("key", key)

    def turns(self, df: DataFrame, key: str, system: Column, said: list[Column], temperature: float = 0.3, max_tokens: int = 4096) -> DataFrame:
        """df with replies (array): what is said in turn, each with all turns and replies before it. A failed reply is null and stays out of the dialogue."""
        rows = df.withColumn("messages", F.array(message("system", system))).withColumn("replies", F.array().cast("array<string>"))
        for user in said:
            rows = rows.withColumn("messages", F.concat("messages", F.array(message("user", user))))
            got = self.ask(rows, key, F.col("messages"), temperature, max_tokens).withColumnRenamed("content", "_reply").drop("error")
            rows = self.store(rows.join(got, key, "left"))
            answer = F.when(F.col("_reply").isNotNull(), F.array(message("assistant", F.col("_reply")))).otherwise(F.slice("messages", 1, 0))
            rows = rows.withColumn("messages", F.concat("messages", answer)).withColumn("replies", F.concat("replies", F.array("_reply"))).drop("_reply")
        return rows
