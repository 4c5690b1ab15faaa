"""Reconciliation of prompts over passes and runs: consensus, stability, drift, anchoring.

In fuzzy clustering a text joins the first leader it resembles, else leads; leaders() finds the same clusters in parallel rounds.
Sums are native.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import boosted
from ..functions.text import normal
from ..functions.textblock import TextBlock
from ..params import Reconcile
from ..storage import stored
from .matching import best_match, one_group
from .tiles import group_key, tiled

#: Bits of a row's place within its run.
RUN_BITS = 48


#: Texts of a group that the first wave decides; each wave takes twice as many.
WAVE = 1024


def leaders(df: DataFrame, by: str, threshold: float) -> DataFrame:
    """by, norm and leader (the normal text that leads the cluster) of the distinct texts of rows with by, ord, norm.

    In order, a text joins the first leader that it resembles, else it leads. This is the lexicographically first independent set of
    the graph of similar texts, and is found in parallel: the undecided texts of a group that come first form a wave; those without
    a similar undecided text before them lead, those with a leader before them follow, again and again until the wave is
    decided; then the wave's leaders take what resembles them from all later texts. Waves double in size. Edges are
    compared within waves only, after earlier leaders have taken theirs, so a large group of similar texts has no more
    edges than those of a wave."""
    key = group_key(F.col(by))
    first = df.groupBy(key.alias("g"), F.col("norm").alias("a")).agg(F.min("ord").alias("ord"), F.first(by).alias("by"))
    left = stored(first.filter(F.col("a").isNotNull()), "texts")
    done = [left.select("g", "a", F.lit(None).cast("string").alias("leader")).limit(0)]
    size = WAVE
    while not left.isEmpty():
        place = F.row_number().over(Window.partitionBy("g").orderBy("ord"))
        wave = stored(left.withColumn("_place", place).filter(F.col("_place") <= size).drop("_place"), "wave")
        heads = stored(_leading(wave, threshold), "leaders")
        joined = stored(_joining(left.join(heads.select("g", "a"), ["g", "a"], "left_anti"), heads, threshold), "followers")
        done += [heads.select("g", "a", F.col("a").alias("leader")), joined]
        left = stored(left.join(heads.select("g", "a").unionByName(joined.select("g", "a")), ["g", "a"], "left_anti"), "texts")
        size *= 2
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return first.join(found, ["g", "a"]).select(F.col("by").alias(by), F.col("a").alias("norm"), "leader")


def _leading(wave: DataFrame, threshold: float) -> DataFrame:
    """g, a, ord of the leaders among the texts of a wave."""

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("ord")
        block, places = TextBlock(b.b.tolist()), b.ord.to_numpy()
        rows = [(g, o, places[i]) for g, x, o in zip(a.g, a.a, a.ord, strict=True) for i in block.every(x, threshold, int(places.searchsorted(o)))]
        return pd.DataFrame(rows, columns=["g", "ord", "before"])

    edges = stored(tiled(wave, wave.withColumnRenamed("a", "b"), "g", one, "g string, ord long, before long"), "similar")
    open_, heads = wave, None
    while True:
        new = open_.join(edges.select("g", "ord"), ["g", "ord"], "left_anti")
        heads = new if heads is None else heads.unionByName(new)
        if edges.isEmpty():
            return heads
        new = stored(new, "leaders")
        # who has a leader before it follows
        follow = stored(edges.join(new.select("g", F.col("ord").alias("before")), ["g", "before"], "left_semi").select("g", "ord").distinct(), "followers")
        open_ = stored(open_.join(new.select("g", "ord").unionByName(follow), ["g", "ord"], "left_anti"), "texts")
        gone = edges.join(follow, ["g", "ord"], "left_anti").join(follow.withColumnRenamed("ord", "before"), ["g", "before"], "left_anti")
        edges = stored(gone.select("g", "ord", "before"), "similar")


def _joining(texts: DataFrame, heads: DataFrame, threshold: float) -> DataFrame:
    """g, a and leader of the texts that resemble one of the leaders, the first of them."""

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("ord")
        block, places = TextBlock(b.b.tolist()), b.ord.to_numpy()
        met = [(g, x, o, block.first(x, threshold)) for g, x, o in zip(a.g, a.a, a.ord, strict=True)]
        rows = [(g, x, block.texts[i], places[i]) for g, x, o, i in met if i is not None and places[i] < o]
        return pd.DataFrame(rows, columns=["g", "a", "leader", "place"])

    met = tiled(stored(texts, "texts"), heads.withColumnRenamed("a", "b"), "g", one, "g string, a string, leader string, place long")
    return met.groupBy("g", "a").agg(F.min_by("leader", "place").alias("leader"))


def clustered(df: DataFrame, by: str, text: str, threshold: float, fuzzy: bool) -> DataFrame:
    """df with leader, the normal text that leads its cluster."""
    rows = df.withColumn("norm", normal(F.col(text)))
    if not fuzzy:
        return rows.withColumnRenamed("norm", "leader")
    heads = leaders(rows, by, threshold).select(F.col(by).alias("_by"), F.col("norm").alias("_norm"), "leader")
    return rows.join(heads, F.col(by).eqNullSafe(F.col("_by")) & (F.col("norm") == F.col("_norm"))).drop("_by", "_norm", "norm")


def consensus(prompts: DataFrame, by: str = "domain", params: Reconcile = Reconcile(), fuzzy: bool = True) -> DataFrame:
    """Prompts that recur over passes: best row of each cluster with its mean score, appearances and the ord of its first row.

    prompts: by, pass, ord (over all passes), prompt_text, relevance_score, extraction_reasoning and others. Domains of one pass stay as they are."""
    rows = with_count(clustered(prompts, by, "prompt_text", params.similarity, fuzzy), by, "pass", "passes")
    rest = [c for c in prompts.columns if c not in (by, "relevance_score", "ord")]
    seen = F.count_distinct("pass") if params.strict else F.count(F.lit(1))
    best = F.max_by(F.struct(*rest), F.struct("relevance_score", (-F.col("ord")).alias("first")))
    sums = rows.filter("passes > 1").groupBy(by, "leader", "passes").agg(best.alias("b"), seen.alias("appearances"), F.avg("relevance_score").alias("relevance_score"), F.min("ord").alias("ord"))
    least = F.ceil(F.col("passes") * params.consensus) if params.strict else F.floor(F.col("passes") * params.consensus)
    kept = sums.filter(F.col("appearances") >= F.greatest(F.lit(1), least))
    mark = F.concat(F.lit("[Consensus: "), F.col("appearances").cast("string"), F.lit("/"), F.col("passes").cast("string"), F.lit(" passes, avg score: "), F.format_string("%.2f", "relevance_score"), F.lit("] "), F.coalesce(F.col("b.extraction_reasoning"), F.lit("")))
    out = kept.select(by, "relevance_score", "appearances", "ord", *((mark if c == "extraction_reasoning" else F.col(f"b.{c}")).alias(c) for c in rest))
    single = rows.filter("passes = 1").withColumn("appearances", F.lit(1).cast("long")).select(out.columns)
    return out.unionByName(single)


def with_count(rows: DataFrame, by: str, of: str, name: str) -> DataFrame:
    """rows with how many values of a column their group has. Values are made distinct before a shuffle, so no group's rows meet in one task."""
    counts = rows.groupBy(F.col(by).alias("_by")).agg(F.count_distinct(of).cast("int").alias(name))
    return rows.join(counts, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def _aged(runs: DataFrame, n: int) -> DataFrame:
    """Rows of each domain's last n runs with _age, 1 for the last. Runs are ranked, not their rows."""
    place = F.row_number().over(Window.partitionBy("_domain").orderBy(F.desc("_run")))
    last = runs.select(F.col("domain").alias("_domain"), F.col("run_seq").alias("_run")).distinct().withColumn("_age", place).filter(F.col("_age") <= n)
    return runs.join(last, F.col("domain").eqNullSafe(F.col("_domain")) & F.col("run_seq").eqNullSafe(F.col("_run"))).drop("_domain", "_run")


def recent(runs: DataFrame, n: int) -> DataFrame:
    """Rows of each domain's last n runs."""
    return _aged(runs, n).drop("_age")


def stable(runs: DataFrame, params: Reconcile = Reconcile(), fuzzy: bool = True) -> DataFrame:
    """Texts that recur over a domain's recent runs: domain, text, avg_score, appearances, total_runs, stability, and ord, which follows their first rows.

    runs: domain, run_seq, ord (within the run), text, score. Domains with one run have none."""
    near = with_count(_aged(runs, params.recent_runs), "domain", "run_seq", "total_runs").filter("total_runs > 1")
    # the runs' order before that within a run
    rows = near.withColumn("ord", F.shiftleft(F.lit(params.recent_runs) - F.col("_age").cast("long"), RUN_BITS) + F.col("ord")).drop("_age")
    sums = clustered(rows, "domain", "text", params.similarity, fuzzy).groupBy("domain", "leader", "total_runs").agg(
        F.min_by("text", "ord").alias("text"), F.avg("score").alias("avg_score"), F.count(F.lit(1)).alias("appearances"), F.min("ord").alias("ord")
    )
    least = F.greatest(F.lit(2), F.floor(F.col("total_runs") * 0.6))
    return sums.filter(F.col("appearances") >= least).select(
        "domain", "text", "avg_score", "appearances", "total_runs", (F.col("appearances") / F.col("total_runs")).alias("stability"), "ord"
    )


def previous_run(runs: DataFrame) -> DataFrame:
    return recent(runs, 1)


def _keyed(df: DataFrame, text: str, order: str) -> DataFrame:
    """Normal texts of df, each once: norm, ord (of the first), text (of the last)."""
    return df.groupBy(normal(F.col(text)).alias("norm")).agg(F.min(order).alias("ord"), F.max_by(F.col(text), order).alias("text"))


def drift(current: DataFrame, previous: DataFrame, params: Reconcile = Reconcile(), fuzzy: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New texts, dropped texts (both ord, text), and one row of counts with drift_score. current, previous: ord, text."""
    now, then = stored(_keyed(current, "text", "ord"), "now"), stored(_keyed(previous, "text", "ord"), "then")
    if fuzzy:
        met = best_match(now.select("ord", F.col("norm").alias("a")), then.select(F.col("ord").alias("cand_ord"), F.col("norm").alias("b")), params.similarity)
    else:
        met = now.join(then.select("norm", F.col("ord").alias("cand_ord")), "norm").select("ord", "cand_ord")
    met = stored(met.select("ord", "cand_ord"), "met")
    new = now.join(met.select("ord"), "ord", "left_anti").select("ord", "text")
    dropped = then.join(met.select(F.col("cand_ord").alias("ord")).distinct(), "ord", "left_anti").select("ord", "text")
    counts = (
        new.agg(F.count(F.lit(1)).alias("new_count"))
        .join(dropped.agg(F.count(F.lit(1)).alias("dropped_count")), F.lit(True))
        .join(now.select("norm").union(then.select("norm")).distinct().agg(F.count(F.lit(1)).alias("union_count")), F.lit(True))
        .join(now.agg(F.count(F.lit(1)).alias("current_count")), F.lit(True))
        .join(then.agg(F.count(F.lit(1)).alias("previous_count")), F.lit(True))
    )  # one row each
    score = F.least(F.coalesce(F.try_divide(F.col("new_count") + F.col("dropped_count"), F.nullif(F.col("union_count"), F.lit(0))), F.lit(0.0)), F.lit(1.0))
    return new, dropped, counts.withColumn("drift_score", score)


def drift_report(current: DataFrame, runs: DataFrame, params: Reconcile = Reconcile(), listed: int = 20, fuzzy: bool = True) -> DataFrame:
    """One row: the drift of current (ord, text) from the last of runs (of one domain), lists cut to listed texts; counts are null without history."""
    last = previous_run(runs)
    new, dropped, counts = drift(current, last, params, fuzzy)
    stables = stable(runs, params, fuzzy).select((-F.col("avg_score")).alias("ord"), "text")
    # at most listed rows reach the lists
    first = lambda df, name: df.orderBy("ord", "text").limit(listed).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias(name))
    texts = first(stables, "stable_prompts").join(stables.agg(F.count(F.lit(1)).alias("stable_count")), F.lit(True))
    history = runs.agg(F.count_distinct("run_seq").alias("total_historical_runs"))
    one = F.lit(True)
    row = counts.join(first(new, "new_prompts"), one).join(first(dropped, "dropped_prompts"), one).join(texts, one).join(history, one)
    has = F.col("total_historical_runs") > 0
    return row.select(
        has.alias("has_history"),
        F.when(has, F.col("drift_score")).otherwise(0.0).alias("drift_score"),
        *(F.when(has, F.col(c)).alias(c) for c in ("previous_count", "current_count", "new_count", "dropped_count", "stable_count")),
        *(F.when(has, F.col(c)).otherwise(F.array().cast("array<string>")).alias(c) for c in ("new_prompts", "dropped_prompts", "stable_prompts")),
        "total_historical_runs",
        F.when(~has, F.lit("First run - no history to compare against")).alias("message"),
    )


def boosts(stables: DataFrame, current: DataFrame, params: Reconcile = Reconcile(), fuzzy: bool = True) -> DataFrame:
    """current (ord, prompt_text, relevance_score, …) with the scores of prompts that stable texts (ord, text, stability) resemble raised.

    Several stable texts may raise one prompt; as boosts are not negative, one cap at the end equals a cap at each. Of equal texts the last is raised."""
    keyed = current.groupBy(normal(F.col("prompt_text")).alias("b")).agg(F.min("ord").alias("cand_ord"), F.max("ord").alias("held"))
    s = stables.select("ord", normal(F.col("text")).alias("a"), "stability")
    if fuzzy:
        met = best_match(s.select("ord", "a"), keyed.select("cand_ord", "b"), params.similarity).join(s.select("ord", "stability"), "ord")
    else:
        met = s.join(keyed, F.col("a") == F.col("b")).select("ord", "cand_ord", "stability")
    sums = met.join(keyed.select("cand_ord", "held"), "cand_ord").groupBy(F.col("held").alias("ord")).agg(F.sum(F.lit(params.anchor_weight) * F.col("stability")).alias("boost"))
    joined = current.join(sums, "ord", "left")
    return joined.withColumn("relevance_score", F.when(F.col("boost").isNotNull(), boosted(F.col("relevance_score"), F.col("boost"))).otherwise(F.col("relevance_score")))


def recovered(stables: DataFrame, current: DataFrame, params: Reconcile = Reconcile(), fuzzy: bool = True) -> DataFrame:
    """Stable texts that current lacks, as prompts with a lowered score: text, relevance_score, search_intent, topic_cluster.

    With fuzzy, a recovered text is a candidate for those after it: of the texts without a match the leaders stay."""
    keyed = current.select(normal(F.col("prompt_text")).alias("b"), F.col("ord").alias("cand_ord"))
    s = stables.select("ord", "text", normal(F.col("text")).alias("a"), "stability", "avg_score")
    if fuzzy:
        met = best_match(s.select("ord", "a"), keyed, params.similarity).select("ord")
        missing = s.join(met, "ord", "left_anti")
    else:
        missing = s.join(keyed.select("b").distinct(), F.col("a") == F.col("b"), "left_anti")  # each text once, else equal ones would meet in pairs
    missing = missing.filter(F.col("stability") >= params.recover_stability)
    if fuzzy:
        heads = leaders(missing.select(one_group(), "ord", F.col("a").alias("norm")), "g", params.similarity).filter("leader = norm")
        firsts = missing.groupBy("a").agg(F.min("ord").alias("ord")).join(heads.select(F.col("norm").alias("a")), "a")
        missing = missing.join(firsts.select("ord"), "ord", "left_semi")
    return missing.select("ord", "text", (F.col("avg_score") * params.recover_factor).alias("relevance_score"), F.lit("informational").alias("search_intent"), F.lit("").alias("topic_cluster"))
