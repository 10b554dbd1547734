"""The thirteen-rule scorecard: long-format scores, seeded stratified sample, aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..schema import RULES, TIE

TEXT_RULES = ("A4", "A5", "A6", "A7", "A9", "A10", "A11", "A12", "A13")
SEED = 1337


def flag_columns() -> list[Column]:
    names = ("heading_list", "fence_tag", "verify", "self_check", "reasoning", "sampling", "contract")
    return [X.has(n).alias(n) for n in names]


def _score(condition: Column) -> Column:
    return condition.cast("double")


def _machine_only(name: str) -> Column:
    return F.when(F.col("origin") == "machine", _score(X.has(name)))


def rule_scores() -> dict[str, Column]:
    n, end = F.length("content"), X.tail("content")
    return {
        "A4": F.when(n >= X.STRUCTURE_FROM, _score(X.has("heading_list") | X.has("fence_tag"))),
        "A5": _score(X.has("contract") | X.has("structured")),
        "A6": _score(X.has("example")),
        "A7": _machine_only("reasoning"),
        "A9": _machine_only("verify"),
        "A10": _machine_only("self_check"),
        "A11": F.when(n >= X.LONG, _score(X.has("contract", end) | X.has("verify", end) | X.has("constraint", end))),
        "A12": F.lit(None).cast("double"),
        "A13": _machine_only("sampling"),
    }


def scores(prompts: DataFrame) -> DataFrame:
    """(prompt_ref, origin, timestamp, rule, score) for the nine rules judged by text; null means not applicable."""
    wide = prompts.select(X.prompt_ref().alias("prompt_ref"), "origin", "timestamp", *(c.alias(r) for r, c in rule_scores().items()))
    pairs = ", ".join(f"'{r}', {r}" for r in TEXT_RULES)
    return wide.select("prompt_ref", "origin", "timestamp", F.expr(f"stack({len(TEXT_RULES)}, {pairs}) as (rule, score)"))


def substantive(prompts: DataFrame) -> DataFrame:
    return prompts.where(F.length("content") >= X.SUBSTANTIVE)


def summary(long_scores: DataFrame) -> DataFrame:
    """All thirteen rules: means by origin, coverage, and the first best and worst prompt.

    The order of equal scores is (timestamp, prompt_ref).
    """
    spark = long_scores.sparkSession
    rules = spark.createDataFrame(RULES, "rule string, title string, judge string")
    known = long_scores.where("score is not null")
    mean = lambda o: F.avg(F.when(F.col("origin") == o, F.col("score"))).alias(f"{o}_mean")
    # max_by takes the greatest key: for the first of the best, lower order must win, so best is the least of (-score, order).
    early = lambda s: F.struct(s, "timestamp", "prompt_ref")
    agg = known.groupBy("rule").agg(mean("human"), mean("machine"), F.count("*").alias("coverage"), F.min_by("prompt_ref", early((-F.col("score")).alias("s"))).alias("best_ref"), F.min_by("prompt_ref", early(F.col("score").alias("s"))).alias("worst_ref"))
    out = rules.join(agg, "rule", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0)))
    return out.withColumn("applicable", F.col("coverage") > 0)


def stratified_sample(prompts: DataFrame, size: int, seed: int = SEED) -> DataFrame:
    """At most size prompts, balanced over (source, origin): the newest half of each share, the rest by a seeded hash.

    Strata with few rows give what they have; the cut to size follows the strata's order.
    Shares are rounded half to even. Of each stratum only the ``size`` newest and the ``size`` rows
    of lowest hash, without content, leave their partitions; the few picked ones are joined back.
    A prompt's reference must be unique.
    """
    strata = prompts.groupBy("source", "origin").agg(F.count("*").alias("_n"))
    total = strata.agg(F.sum("_n").alias("_total"))
    share = F.greatest(F.lit(1), F.bround(F.lit(size).cast("double") * F.col("_n") / F.col("_total"), 0).cast("int"))
    plan = strata.crossJoin(F.broadcast(total)).withColumn("_share", share)  # one row
    plan = F.broadcast(plan.withColumn("_recent", F.floor(F.col("_share") / 2).cast("int") + F.col("_share") % 2).withColumn("_random", F.floor(F.col("_share") / 2).cast("int")))  # strata: sources x 2
    rows = prompts.select("source", "origin", "timestamp", X.prompt_ref().alias("_ref"))
    by = Window.partitionBy("source", "origin")
    lowest = by.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("_ref"))), "_ref")
    newest = rows.withColumn("_new", F.row_number().over(by.orderBy(F.desc("timestamp"), "_ref"))).where(F.col("_new") <= size)
    late = newest.join(plan, ["source", "origin"]).where("_new <= _recent")
    # A stratum's late rows and random ones are at most its share, so the size lowest hold all that may be picked.
    low = rows.withColumn("_pick", F.row_number().over(lowest)).where(F.col("_pick") <= size).drop("_pick").join(late.select("_ref"), "_ref", "left_anti")
    low = low.withColumn("_pick", F.row_number().over(lowest)).join(plan, ["source", "origin"]).where("_total <= %d or _pick <= _random" % size)
    picked = late.select("source", "origin", "_ref", F.lit(True).alias("_late"), F.col("_new").alias("_part")).unionByName(low.select("source", "origin", "_ref", F.lit(False).alias("_late"), F.col("_pick").alias("_part")))
    place = F.row_number().over(Window.orderBy("source", "origin", F.desc("_late"), "_part", "_ref"))  # at most size + strata rows
    small = picked.withColumn("sample_pos", place).where(F.col("sample_pos") <= size).select("_ref", "sample_pos")
    return prompts.withColumn("_ref", X.prompt_ref()).join(F.broadcast(small), "_ref").select(*prompts.columns, "sample_pos")


def order_window() -> tuple[str, ...]:
    return ("timestamp", *TIE)
