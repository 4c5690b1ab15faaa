"""Validation by a debate of four dependent turns: proposer, challenger, defender, judge.

Each turn is a stage of its own: a request from the messages so far, a reply, and the reply appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import rating, score_or, verdict_default
from .completion import Service, message, read_reply
from .context import debate_text, prompt_pages, truncated
from .lookup import page_context

SYSTEM = "You take part in a debate on whether a search query fits the pages of a site. Reply with JSON only."
TURNS = (
    ("proposer", "Argue that the query is accurate, faithful to the pages and useful. JSON: {confidence, key_evidence}.", 0.4, {"confidence": 0.5}),
    ("challenger", "Attack the argument above. JSON: {overall_challenge_strength, weaknesses}.", 0.5, {"overall_challenge_strength": 0.5}),
    ("defender", "Answer the attack; concede what is right. JSON: {updated_confidence, rebuttals, concessions}.", 0.3, {"updated_confidence": 0.5}),
    ("judge", "Judge the debate. JSON: {accuracy_score, is_accurate, accuracy_reasoning, faithfulness_score, is_faithful, faithfulness_reasoning, quality_score, quality_rating, quality_reasoning, overall_score, verdict, verdict_reasoning}.", 0.2, {}),
)
VERDICT = (
    "accuracy_score string, is_accurate boolean, accuracy_reasoning string, faithfulness_score string, is_faithful boolean, faithfulness_reasoning string, "
    "quality_score string, quality_rating string, quality_reasoning string, overall_score string, verdict string, verdict_reasoning string"
)
FAILED = "Judge analysis failed"


def _first(turn: str) -> Column:
    return F.concat_ws("\n", F.lit(turn), F.concat(F.lit("Query: "), F.col("prompt_text")), F.concat(F.lit("Intent: "), F.coalesce("search_intent", F.lit(""))), F.concat(F.lit("Topic: "), F.coalesce("topic_cluster", F.lit(""))), F.concat(F.lit("Reasoning: "), F.coalesce(F.nullif(F.col("extraction_reasoning"), F.lit("")), F.lit("N/A"))), F.concat(F.lit("Pages:\n"), F.col("content")))


def debate(prompts: DataFrame, pages: DataFrame, service: Service) -> DataFrame:
    """Validation of each prompt (schema VALIDATION without its time, and ord)."""
    texts = prompt_pages(page_context(prompts, pages), pages, debate_text())
    rows = prompts.join(texts.withColumnRenamed("prompt_ord", "ord"), "ord", "left").withColumn("content", F.coalesce("content", F.lit("")))
    rows = rows.withColumn("messages", F.array(message("system", F.lit(SYSTEM)))).withColumn("debate_summary", F.array().cast("array<string>"))
    for role, turn, temperature, default in TURNS:
        said = _first(turn) if role == "proposer" else F.lit(turn)
        rows = rows.withColumn("messages", F.concat("messages", F.array(message("user", said))))
        replies = service.ask(rows, "ord", F.col("messages"), temperature, 1024).withColumnRenamed("content", "_reply")
        rows = service.store(rows.join(replies, "ord", "left"))  # else the next turn would plan all of this twice
        if role != "judge":
            fallback = F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in default.items())))
            rows = rows.withColumn("messages", F.concat("messages", F.array(message("assistant", F.coalesce("_reply", fallback)))))
        mark = F.concat(F.lit(f"{role.upper()}: "), F.coalesce(truncated(F.col("_reply"), 150), F.concat(F.lit("FAILED - "), F.coalesce("error", F.lit("no reply")))))
        rows = rows.withColumn("debate_summary", F.concat("debate_summary", F.array(mark)))
        rows = rows.withColumn("_judge", F.col("_reply")).drop("_reply", "error")
    return judged(rows)


def judged(rows: DataFrame) -> DataFrame:
    """Validations from the judge's reply (_judge). No reply, or a score that is no number, is a failed judgement: 0.5 throughout."""
    v = read_reply(F.col("_judge"), VERDICT)
    rows = rows.withColumn("_v", F.when(F.col("_judge").isNotNull(), F.coalesce(v, F.from_json(F.lit("{}"), VERDICT))))
    scores = {c: score_or(F.col(f"_v.{c}")) for c in ("accuracy_score", "faithfulness_score", "quality_score", "overall_score")}
    ok = F.col("_v").isNotNull()
    for c in scores.values():
        ok = ok & c.isNotNull()
    rows = rows.withColumn("_ok", ok)
    score = lambda c: F.when(F.col("_ok"), scores[c]).otherwise(0.5)
    text = lambda c: F.when(F.col("_ok"), F.coalesce(F.col(f"_v.{c}"), F.lit(""))).otherwise(FAILED)
    flag = lambda c, s: F.when(F.col("_ok"), verdict_default(F.col(f"_v.{c}"), scores[s])).otherwise(True)
    return rows.select(
        "ord", "prompt_text",
        flag("is_accurate", "accuracy_score").alias("is_accurate"), score("accuracy_score").alias("accuracy_score"), text("accuracy_reasoning").alias("accuracy_reasoning"),
        flag("is_faithful", "faithfulness_score").alias("is_faithful"), score("faithfulness_score").alias("faithfulness_score"), text("faithfulness_reasoning").alias("faithfulness_reasoning"),
        F.when(F.col("_ok"), rating(F.coalesce(F.col("_v.quality_rating"), F.lit("medium")))).otherwise("medium").alias("quality_rating"), score("quality_score").alias("quality_score"), text("quality_reasoning").alias("quality_reasoning"),
        score("overall_score").alias("overall_score"), "debate_summary",
    )


def weighted_overall(accuracy: Column, faithfulness: Column, quality: Column) -> Column:
    """The overall score as the instructions define it, for a strict mode."""
    return 0.3 * accuracy + 0.3 * faithfulness + 0.4 * quality


def statistics(validations: DataFrame, min_quality: float = 0.7) -> DataFrame:
    passed = F.count_if((F.col("overall_score") >= min_quality) & (F.col("quality_rating") != "rejected"))
    return validations.agg(F.count(F.lit(1)).alias("validated"), passed.alias("passed"), F.coalesce(F.avg("overall_score"), F.lit(0.0)).alias("mean_overall"))
