"""Quality rules judged by host.

Rules fail single documents; failures are summed by host, the hosts' failure rates are
shrunk towards a beta prior that is fitted to all hosts by moments, and hosts whose shrunk
rate is too high lose all their documents. Expressions are native throughout.

Defined cases: a null text counts as empty (no words, so the base rule fails); documents
of a null host form one host; repeated rows count each; of hosts that fail alike all are judged alike; texts of any length are read whole; an empty table gives no rows;
columns that docs has besides are kept by judge() and never clash, as docs' row travels
in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, keyed, lookup_join, table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5
#: A document fails a rule if its condition holds. The first two are the base rules.
RULES: dict[str, str] = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "lengths": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}
#: A host is rejected if the shrunk rate of one of the rules is above this.
HOST_RATE = 0.5
#: The prior counts as so many documents at least and at most.
PRIOR_STRENGTH = (2.0, 10_000.0)


def _flagged(sorted_windows: str) -> Column:
    """Places of the windows that have an equal neighbour in the sorted (hash, place) array."""
    at = F.col(sorted_windows)
    same = lambda k, j: F.coalesce(F.get(at, k)["h"] == F.get(at, j)["h"], F.lit(False))
    ranks = F.filter(F.sequence(F.lit(0), F.size(at) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
    return F.sort_array(F.transform(ranks, lambda k: F.get(at, k)["i"]))


def measure(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of keep and the measures of every whole text: n_words, word_chars, n_symbols,
    n_lines (with a word), n_dup_lines, n_repeat_words; linear in the text but for one sort.

    Equal windows are found by a 64-bit hash within one document."""
    t = F.col("_t")
    one = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t")).select(
        *keep,
        F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("_words"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    words, n = F.col("_words"), F.size("_words")
    one = one.select("*", F.transform(words, lambda w: F.xxhash64(w)).alias("_hashes"))  # each word is hashed once
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(WINDOW))))
    two = one.select(
        *keep, "word_chars", "n_symbols",
        n.cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, hashes).alias("_win"),
    )
    names = [*keep, "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines"]
    pairs = F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    three = two.select(*names, F.when(F.size(F.array_distinct("_win")) < F.size("_win"), pairs).alias("_pairs"))
    four = three.select(*names, F.when(F.col("_pairs").isNotNull(), _flagged("_pairs")).alias("_dup"))
    dup = F.col("_dup")
    steps = F.transform(dup, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(dup, k + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return four.select(*names, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """One row for each host: n, and for each rule the failures and the shrunk rate.

    Sums are combined before the shuffle, so a hot host costs one row a task."""
    sums = [F.sum(F.expr(f"IF({rule}, 1L, 0L)")).alias(f"f_{name}") for name, rule in RULES.items()]
    hosts = table(measured.groupBy(host).agg(F.count(F.lit(1)).alias("n"), *sums), "hosts")
    stats = hosts.agg(
        F.sum("n").alias("n"),
        *(F.sum(f"f_{r}").alias(f"f_{r}") for r in RULES),
        *(F.sum(F.col(f"f_{r}") / F.col("n") * F.col(f"f_{r}")).alias(f"q_{r}") for r in RULES),
        F.count(F.lit(1)).alias("hosts"),
        F.sum(1 / F.col("n")).alias("inverse"),
    ).first()  # one row of sums
    shrunk = []
    for r in RULES:
        a, b = _prior(stats["n"] or 0, stats[f"f_{r}"] or 0, stats[f"q_{r}"] or 0.0, stats["hosts"])
        shrunk.append(((F.col(f"f_{r}") + F.lit(a)) / (F.col("n") + F.lit(a + b))).alias(f"rate_{r}"))
    return hosts.select(host, "n", *(f"f_{r}" for r in RULES), *shrunk)


def _prior(n: int, failures: int, squares: float, hosts: int) -> tuple[float, float]:
    """a and b of the beta prior whose mean and variance are those of the hosts' rates, each weighted by its documents.

    squares: sum of failures^2 / documents over hosts. The sampling variance within hosts is taken off."""
    low, high = PRIOR_STRENGTH
    mean = (failures + 0.5) / (n + 1)
    if n == 0 or hosts < 2:
        return mean * low, (1 - mean) * low
    rate = failures / n
    between = squares / n - rate * rate - (hosts - 1) * rate * (1 - rate) / n
    strength = high if between <= 0 else min(high, max(low, mean * (1 - mean) / between - 1))
    return mean * strength, (1 - mean) * strength


def judge(docs: DataFrame, host: str = "source", text: str = "text", keep_rows: bool = True) -> DataFrame:
    """docs' rows (struct row if keep_rows, else struct of doc_id), their measures, base_failed, host_rejected and kept."""
    row = F.struct(*(docs.columns if keep_rows else ["doc_id"])).alias("row")
    narrow = docs.select(row, keyed(F.col(host)).alias("host"), F.col(text).alias("_text"))
    measured = table(measure(narrow, "_text", ("row", "host")), "measures")
    rates = host_rates(measured, "host")
    bad = F.greatest(*(F.col(f"rate_{r}") for r in RULES)) > HOST_RATE
    verdicts = table(rates.select("host", bad.alias("host_rejected")), "verdicts")
    failed = F.expr(f"({RULES['short']}) OR ({RULES['repeats']})")
    return (
        lookup_join(measured, verdicts, "host")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    )


def keep(docs: DataFrame) -> DataFrame:
    """docs without the rows that their own text or their host makes fail; columns unchanged."""
    return judge(docs).filter("kept").select("row.*")
