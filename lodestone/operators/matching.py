"""Theta joins of prompts with queries, leaders and pages.

Texts are normalised and made distinct before they are compared, so that repeats cost nothing. They are compared in tiles of
bounded size (tiles.py); what a text is not similar to is told by bounds (textblock.py), and a tile gives only as many
rows for a text as may be wanted, so hot words and large groups of similar texts make no quadratic result.
"""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal
from ..functions.textblock import TextBlock
from ..functions.urls import other_slash, path
from ..storage import stored
from .tiles import tiled


def one_group() -> Column:
    return F.lit("").alias("g")



def best_pairs(left: DataFrame, right: DataFrame, threshold: float, k: int, containment: bool, ratio: bool = True) -> DataFrame:
    """a, b, score: for each distinct normal text of left (column a) its k best of right (b, ord), if they reach threshold.

    Of equal scores the text of the least ord comes first. A few more than k may be given, never others in their place."""
    lefts = stored(left.select(one_group(), "a").filter(F.col("a").isNotNull()).distinct(), "texts")
    rights = stored(right.filter(F.col("b").isNotNull()).groupBy("b").agg(F.min("ord").alias("ord")).select(one_group(), "b", "ord"), "texts")

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        texts = b.sort_values("ord").b.tolist()
        block = TextBlock(texts, ratio)
        rows = [(x, texts[i], s) for x in a.a for i, s in block.best(x, threshold, k, containment)]
        return pd.DataFrame(rows, columns=["a", "b", "score"])

    return tiled(lefts, rights, "g", one, "a string, b string, score double")


def top_matches(prompts: DataFrame, metrics: DataFrame, threshold: float = 0.5, k: int = 10, containment: bool = True, ratio: bool = True) -> DataFrame:
    """Each prompt's k best queries: prompt_ord, query_ord, match_score, match_rank. prompts: ord, prompt_text; metrics: ord, query."""
    p = prompts.select(F.col("ord").alias("prompt_ord"), normal(F.col("prompt_text")).alias("a"))
    q = metrics.select(F.col("ord").alias("query_ord"), normal(F.col("query")).alias("b"))
    pairs = best_pairs(p, q.select("b", F.col("query_ord").alias("ord")), threshold, k, containment, ratio)
    ranked = Window.partitionBy("a").orderBy(F.desc("score"), "query_ord")
    best = pairs.join(q, "b").withColumn("match_rank", F.row_number().over(ranked)).filter(F.col("match_rank") <= k)
    return p.join(best, "a").select("prompt_ord", "query_ord", F.col("score").alias("match_score"), "match_rank")


def best_match(texts: DataFrame, candidates: DataFrame, threshold: float, ratio: bool = True) -> DataFrame:
    """For each text (ord, a) the candidate (cand_ord, b) of the highest similarity, the first of equal ones: ord, cand_ord, score; texts without one are left out."""
    pairs = best_pairs(texts, candidates.select("b", F.col("cand_ord").alias("ord")), threshold, 1, containment=False, ratio=ratio)
    firsts = candidates.groupBy("b").agg(F.min("cand_ord").alias("cand_ord"))
    best = pairs.join(firsts, "b").groupBy("a").agg(F.max_by(F.struct("cand_ord", "score"), F.struct("score", (-F.col("cand_ord")).alias("first"))).alias("best"))
    return texts.join(best, "a").select("ord", "best.cand_ord", "best.score")


def inside_or_around(paths: DataFrame, pages: DataFrame) -> DataFrame:
    """p and ord: for each distinct text p of paths the least ord of a text of pages (t, ord) that holds it or that it holds.

    A tile builds an automaton of its pages and runs it over the paths, and one of its paths for the pages; of all that
    meet only the least is kept."""
    lefts = stored(paths.filter(F.col("p").isNotNull()).select(one_group(), F.col("p").alias("a")).distinct(), "paths")
    rights = stored(pages.filter(F.col("t").isNotNull()).groupBy(F.col("t").alias("b")).agg(F.min("ord").alias("ord")).select(one_group(), "b", "ord"), "pages")

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        best: dict[str, int] = {}
        pages_, paths_ = automaton(b.b), automaton(a.a)
        order = dict(zip(b.b, b.ord, strict=True))
        for p in a.a:
            met = (order[t] for t in found(pages_, p))
            best[p] = min(met, default=None)
        if "" in order:  # a text without characters is in every text
            best = {p: order[""] if n is None else min(n, order[""]) for p, n in best.items()}
        if "" in best:
            best[""] = min(order.values())
        for t, n in order.items():
            for p in found(paths_, t):
                if best[p] is None or n < best[p]:
                    best[p] = n
        return pd.DataFrame([(p, n) for p, n in best.items() if n is not None], columns=["p", "ord"])

    met = tiled(lefts, rights, "g", one, "p string, ord long")
    return met.groupBy("p").agg(F.min("ord").alias("ord"))


def automaton(texts: pd.Series) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for t in texts:
        if t:
            out.add_word(t, t)
    out.make_automaton()
    return out


def found(texts: ahocorasick.Automaton, inside: str) -> list[str]:
    """The automaton's texts that another holds."""
    return [t for _, t in texts.iter(inside)] if len(texts) else []


def traffic_cascade(prompts: DataFrame, traffic: DataFrame) -> DataFrame:
    """The traffic row of each prompt: prompt_ord, traffic_ord.

    Its URLs are tried in order; for each the equal path, the path with the other ending slash, then the first page of which one path
    contains the other. prompts: ord, source_urls; traffic: ord, page_path (each path once)."""
    urls = prompts.select(F.col("ord").alias("prompt_ord"), F.posexplode("source_urls").alias("pos", "url")).withColumn("p", path(F.col("url")))
    t = traffic.select(F.col("ord").alias("traffic_ord"), F.col("page_path").alias("t"))
    exact = urls.join(t, F.col("p") == F.col("t")).select("prompt_ord", "pos", F.lit(0).alias("rule"), "traffic_ord")
    slash = urls.join(t, other_slash(F.col("p")) == F.col("t")).select("prompt_ord", "pos", F.lit(1).alias("rule"), "traffic_ord")
    paths, pages = urls.select("p").distinct(), t.select("t", "traffic_ord")
    inside = inside_or_around(paths, pages.withColumnRenamed("traffic_ord", "ord")).withColumnRenamed("ord", "traffic_ord")
    partial = urls.join(inside, "p").select("prompt_ord", "pos", F.lit(2).alias("rule"), "traffic_ord")
    every = exact.unionByName(slash).unionByName(partial)
    return every.groupBy("prompt_ord").agg(F.min_by("traffic_ord", F.struct("pos", "rule", "traffic_ord")).alias("traffic_ord"))
