"""Fact checks: claims of a prompt are split off, reworded, verified in rounds and summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import score_or
from ..params import Factcheck
from ..schema import CLAIM
from .completion import Service, message, read_reply
from .context import claims_payload, factcheck_text, prompt_pages, verdicts_payload
from .lookup import page_context

DECOMPOSE = 'Split the query and its tie to the pages into claims that can be checked. JSON: {"claims": [{claim_text, source_context, is_verifiable}]}.'
REWORD = 'Reword each claim so that it stands alone. JSON: {"decontextualized_claims": [{decontextualized_claim}]}.'
VERIFY = 'Check each claim against the pages. JSON: {"verifications": [{verdict, confidence, evidence, reasoning}]}.'
SUM_UP = 'Sum the verdicts up. JSON: {overall_score, is_factually_sound, confidence_level, summary}.'


def new_claims(items: Column, limit: int) -> Column:
    """The first limit claims of a reply; of these, those with a text."""
    made = F.transform(
        F.slice(items, 1, limit),
        lambda c: F.struct(F.coalesce(c["claim_text"], F.lit("")).alias("claim_text"), F.coalesce(c["source_context"], F.lit("")).alias("source_context"), F.coalesce(c["is_verifiable"], F.lit(True)).alias("is_verifiable"), F.lit("pending").alias("verification_status"), F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("evidence"), F.lit("").alias("reasoning")),
    )
    return F.filter(made, lambda c: c["claim_text"] != "").cast(f"array<{CLAIM}>")


def own_claim(prompt: Column) -> Column:
    """The claim that stands in when a prompt cannot be split."""
    text = F.concat(F.lit("The search prompt '"), prompt, F.lit("' is relevant to the source content"))
    return new_claims(F.array(F.struct(text.alias("claim_text"), F.lit("").alias("source_context"), F.lit(True).alias("is_verifiable"))), 1)


def _with(c: Column, **new: Column) -> Column:
    for name, value in new.items():
        c = c.withField(name, value)
    return c


def reworded(claims: Column, replies: Column) -> Column:
    """Claims with the texts of the replies at their places; empty or missing ones leave a claim, extra ones are ignored."""
    return F.transform(claims, lambda c, i: _with(c, claim_text=F.coalesce(F.nullif(F.get(replies, i)["decontextualized_claim"], F.lit("")), c["claim_text"])))


def verified(claims: Column, replies: Column) -> Column:
    """Claims with the verdicts of the replies at their places."""
    def one(c: Column, i: Column) -> Column:
        r = F.get(replies, i)
        new = _with(c, verification_status=F.coalesce(r["verdict"], F.lit("unverifiable")), confidence=F.coalesce(score_or(r["confidence"]), F.lit(0.5)), evidence=F.coalesce(r["evidence"], F.array().cast("array<string>")), reasoning=F.coalesce(r["reasoning"], F.lit("")))
        return F.when(r.isNotNull(), new).otherwise(c)

    return F.transform(claims, one)


def unverified(claims: Column) -> Column:
    """Claims after a failed round: what is pending becomes unverifiable."""
    return F.transform(claims, lambda c: F.when(c["verification_status"] == "pending", _with(c, verification_status=F.lit("unverifiable"), confidence=F.lit(0.3))).otherwise(c))


def summed(claims: Column) -> Column:
    """Score, soundness, confidence and summary of claims without a model."""
    n = F.size(claims)
    count = lambda v: F.size(F.filter(claims, lambda c: c["verification_status"] == v))
    score = F.when(n > 0, count("verified") / n).otherwise(0.5)
    sound = (n == 0) | ((count("refuted") == 0) & (score >= 0.5))
    total = F.aggregate(claims, F.lit(0.0), lambda a, c: a + c["confidence"])
    said = F.concat(F.lit("Manual aggregation: "), count("verified").cast("string"), F.lit("/"), n.cast("string"), F.lit(" verified, "), count("refuted").cast("string"), F.lit(" refuted"))
    return F.struct(score.alias("overall_factual_score"), sound.alias("is_factually_sound"), F.when(n > 0, total / n).otherwise(0.5).alias("confidence_level"), F.when(n > 0, said).otherwise("No claims to verify").alias("verification_summary"))


def check(prompts: DataFrame, pages: DataFrame, service: Service, params: Factcheck = Factcheck()) -> DataFrame:
    """ord, prompt_text, claims, overall_factual_score, is_factually_sound, confidence_level, verification_summary."""
    texts = prompt_pages(page_context(prompts, pages), pages, factcheck_text()).withColumnRenamed("prompt_ord", "ord").withColumnRenamed("content", "_pages")
    rows = prompts.select("ord", "prompt_text", "search_intent", "topic_cluster").join(texts, "ord", "left")
    query = F.concat(F.lit("Query: "), F.col("prompt_text"))
    about = F.concat_ws("\n", query, F.lit("Pages:"), F.coalesce("_pages", F.lit("")))

    def ask(df: DataFrame, system: str, user: Column, temperature: float, tokens: int) -> DataFrame:
        got = service.ask(df, "ord", F.array(message("system", F.lit(system)), message("user", user)), temperature, tokens)
        return service.store(df.drop("content", "error").join(got, "ord", "left"))  # else the next step would plan all of this twice

    found = "claims array<struct<claim_text:string,source_context:string,is_verifiable:boolean>>"
    rows = ask(rows, DECOMPOSE, about, 0.2, 2048).withColumn("_r", read_reply(F.col("content"), found))
    rows = rows.withColumn("claims", F.when(F.col("_r").isNull(), own_claim(F.col("prompt_text"))).otherwise(F.coalesce(new_claims(F.col("_r.claims"), params.max_claims), new_claims(F.array().cast("array<struct<claim_text:string,source_context:string,is_verifiable:boolean>>"), 1))))
    rows = ask(rows, REWORD, F.concat_ws("\n", query, claims_payload(F.col("claims"), None)), 0.2, 2048)
    rows = rows.withColumn("_r", read_reply(F.col("content"), "decontextualized_claims array<struct<decontextualized_claim:string>>"))
    rows = rows.withColumn("claims", reworded(F.col("claims"), F.col("_r.decontextualized_claims"))).withColumn("_stopped", F.lit(False))
    for i in range(params.rounds):
        head = F.lit(f"Round {i + 1} of {params.rounds}")
        rows = ask(rows, VERIFY, F.concat_ws("\n", head, query, claims_payload(F.col("claims"), i == 0), F.coalesce("_pages", F.lit(""))), 0.1, 2048)
        rows = rows.withColumn("_r", read_reply(F.col("content"), "verifications array<struct<verdict:string,confidence:string,evidence:array<string>,reasoning:string>>"))
        now = F.when(F.col("_stopped"), F.col("claims")).when(F.col("_r").isNull(), unverified(F.col("claims"))).otherwise(verified(F.col("claims"), F.col("_r.verifications")))
        rows = rows.withColumn("claims", now).withColumn("_stopped", F.col("_stopped") | F.col("_r").isNull())
    rows = ask(rows, SUM_UP, F.concat_ws("\n", query, verdicts_payload(F.col("claims"))), 0.2, 1024)
    rows = rows.withColumn("_r", read_reply(F.col("content"), "overall_score string, is_factually_sound boolean, confidence_level string, summary string"))
    model = F.struct(score_or(F.col("_r.overall_score")).alias("overall_factual_score"), F.coalesce(F.col("_r.is_factually_sound"), F.lit(False)).alias("is_factually_sound"), score_or(F.col("_r.confidence_level")).alias("confidence_level"), F.coalesce(F.col("_r.summary"), F.lit("")).alias("verification_summary"))
    usable = F.col("_r").isNotNull() & (F.size("claims") > 0) & score_or(F.col("_r.overall_score")).isNotNull() & score_or(F.col("_r.confidence_level")).isNotNull()
    return rows.withColumn("_s", F.when(usable, model).otherwise(summed(F.col("claims")))).select("ord", "prompt_text", "claims", "_s.*")


def statistics(results: DataFrame, params: Factcheck = Factcheck()) -> DataFrame:
    """Prompts checked, prompts at the threshold or above, and verified claims."""
    verified_ = F.size(F.filter("claims", lambda c: c["verification_status"] == "verified"))
    return results.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("overall_factual_score") >= params.threshold).alias("at_threshold"), F.coalesce(F.sum(verified_), F.lit(0)).cast("long").alias("verified_claims"))
