"""Model-fit findings: the tier of the model against the demand of the prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def models_seen(prompts: DataFrame) -> DataFrame:
    return prompts.where("model is not null and model <> ''").groupBy("source").agg(F.array_sort(F.collect_set("model")).alias("models"))


def eligible(prompts: DataFrame) -> DataFrame:
    return prompts.where((F.col("origin") == "human") & (F.length("content") >= X.SUBSTANTIVE))


def _tiered(prompts: DataFrame) -> DataFrame:
    return eligible(prompts).select("source", X.prompt_ref().alias("prompt_ref"), "model", X.model_tier().alias("tier"), X.demand_tier().alias("demand"))


def _direction():
    under = (F.col("demand") == "high") & (F.col("tier") == "small")
    over = (F.col("demand") == "low") & (F.col("tier") == "large")
    return F.when(under, "underpowered").when(over, "overpowered")


def findings(prompts: DataFrame) -> DataFrame:
    return _tiered(prompts).withColumn("direction", _direction()).where("direction is not null")


def suggestions(prompts: DataFrame) -> DataFrame:
    """Findings with a model of the same source to use instead: a medium one, else one of the other end, the last by name."""
    seen = prompts.where("model is not null").select("source", "model", X.model_tier().alias("tier")).where("tier is not null")
    best = lambda t: F.max(F.when(F.col("tier") == t, F.col("model"))).alias(t)
    by_source = seen.groupBy("source").agg(best("small"), best("medium"), best("large"))
    other = F.when(F.col("direction") == "underpowered", F.col("large")).otherwise(F.col("small"))
    return findings(prompts).join(by_source, "source", "left").select("source", "prompt_ref", "model", "tier", "demand", "direction", F.coalesce("medium", other).alias("suggestion"))


def summary(prompts: DataFrame) -> DataFrame:
    rows = _tiered(prompts).withColumn("direction", _direction())
    return rows.agg(
        F.count("*").alias("eligible"),
        F.count("tier").alias("coverage"),
        F.count_if(F.col("direction") == "underpowered").alias("underpowered"),
        F.count_if(F.col("direction") == "overpowered").alias("overpowered"),
    )
