"""Style metrics, counts and weekly volumes over the prompt relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..schema import TIE

MEASURES = ("prompts", "sessions", "avg_tokens", "median_tokens", "prompts_per_session", "refinement_rate", "example_rate", "constraint_rate", "structured_rate", "first_message_ratio")
WEEK = 7 * 86400


def order_key() -> Column:
    return F.struct("timestamp", *TIE)


def _per_segment(prompts: DataFrame) -> DataFrame:
    flags = prompts.select("source", "session_id", "origin", order_key().alias("at"), F.length("content").alias("n"), *(X.has(p).cast("int").alias(p) for p in ("example", "constraint", "structured")))
    return flags.withColumn("segment", F.explode(F.array("origin", F.lit("overall"))))


def session_ratios(prompts: DataFrame) -> DataFrame:
    """Per segment and session: prompts, characters, and the share of the first message in them."""
    return (
        _per_segment(prompts)
        .groupBy("segment", "source", "session_id")
        .agg(F.count("*").alias("prompts"), F.sum("n").alias("chars"), F.min_by("n", "at").alias("first_chars"))
        .withColumn("ratio", F.when(F.col("chars") > 0, F.col("first_chars").cast("double") / F.col("chars")))
    )


def style_metrics(prompts: DataFrame) -> DataFrame:
    """One row of MEASURES for each segment there is: human, machine, overall.

    Sessions weigh alike in the session measures and prompts in the others, so the two
    are separate aggregates joined on the segment (three rows).
    """
    rows = _per_segment(prompts)
    tokens = F.col("n").cast("double") / 4.0
    each = rows.groupBy("segment").agg(F.count("*").alias("prompts"), F.avg(tokens).alias("avg_tokens"), F.median(tokens).alias("median_tokens"), *(F.avg(p).alias(f"{p}_rate") for p in ("example", "constraint", "structured")))
    sessions = session_ratios(prompts).groupBy("segment").agg(F.count("*").alias("sessions"), F.avg((F.col("prompts") > 1).cast("int")).alias("refinement_rate"), F.coalesce(F.avg("ratio"), F.lit(0.0)).alias("first_message_ratio"))
    both = each.join(sessions, "segment").withColumn("prompts_per_session", F.col("prompts") / F.col("sessions"))
    return both.select("segment", *MEASURES)


def stats_table(prompts: DataFrame) -> DataFrame:
    """The measures as rows (all but the prompt count), a column each for human and machine."""
    wide = style_metrics(prompts)
    names = MEASURES[1:]
    tall = wide.select("segment", F.expr(f"stack({len(names)}, " + ", ".join(f"'{m}', cast({m} as double)" for m in names) + ") as (measure, value)"))
    pick = lambda s: F.max(F.when(F.col("segment") == s, F.col("value"))).alias(s)
    return tall.groupBy("measure").agg(pick("human"), pick("machine"))


def counts_by_source(prompts: DataFrame) -> DataFrame:
    """Rows and sessions of each source, and a total row that adds them up."""
    each = prompts.groupBy("source").agg(F.count("*").alias("prompts"), F.countDistinct("session_id").alias("sessions"))
    total = each.agg(F.lit("total").alias("source"), F.coalesce(F.sum("prompts"), F.lit(0)).alias("prompts"), F.coalesce(F.sum("sessions"), F.lit(0)).alias("sessions"))
    return each.unionByName(total)


def table_info(prompts: DataFrame, memo: DataFrame) -> DataFrame:
    """(item, n): rows of each source and of all, and the keys of the memo table."""
    each = prompts.groupBy(F.col("source").alias("item")).agg(F.count("*").alias("n"))
    rows = each.agg(F.lit("prompts").alias("item"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return each.unionByName(rows).unionByName(memo.agg(F.lit("memo").alias("item"), F.count_distinct("key").alias("n")))


def window_totals(prompts: DataFrame) -> DataFrame:
    return prompts.agg(F.count("*").alias("prompts"), F.count_distinct("source", "session_id").alias("sessions"))


def empty_state(prompts: DataFrame, start: Column) -> DataFrame:
    """One row that tells an empty table from a quiet window."""
    n = prompts.agg(F.count("*").alias("all_rows"), F.count_if(F.col("timestamp") >= start).alias("window_rows"))
    return n.withColumn("state", F.when(F.col("all_rows") == 0, "empty table").when(F.col("window_rows") == 0, "quiet window").otherwise("ok"))


def weekly_volumes(prompts: DataFrame, now: int, weeks: int = 12) -> DataFrame:
    """Zero-filled (source, week, n), oldest week first, of the sources seen in the window.

    Rows before the window are dropped, future rows count to the last week.
    """
    start = now - weeks * WEEK
    age = F.unix_seconds("timestamp") - start
    n = prompts.where(age >= 0).groupBy("source", F.least(F.lit(weeks - 1), F.floor(age / WEEK)).cast("int").alias("week")).agg(F.count("*").alias("n"))
    grid = n.select("source").distinct().withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))))
    return grid.join(n, ["source", "week"], "left").select("source", "week", F.coalesce("n", F.lit(0)).alias("n"))


def volume_ordered(volumes: DataFrame, pinned: str) -> DataFrame:
    """Sources by total volume, the pinned one first, with their place."""
    total = volumes.groupBy("source").agg(F.sum("n").alias("total"))
    first = Window.orderBy(F.col("source") != pinned, F.desc("total"), "source")  # one row a source
    return total.withColumn("place", F.row_number().over(first))


def top_with_remainder(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank, and a row of how many more there are."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    head = ranked.where(F.col("rank") <= k).withColumn("more", F.lit(None).cast("bigint"))
    rest = ranked.where(F.col("rank") > k).groupBy(group).agg(F.count("*").alias("more")).withColumn("rank", F.lit(k + 1))
    return head.unionByName(rest, allowMissingColumns=True)
