"""Composite jobs: named frames of the report and the dashboard, and their cells in one long frame.

No frame holds prompt content.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import docs, fit, metrics, rubric


def report(prompts: DataFrame, patterns: DataFrame | None = None, titles: DataFrame | None = None, states: DataFrame | None = None) -> dict[str, DataFrame]:
    """The frames of the report.

    Merged patterns (pattern, support) come only where a model gave some: without them the frame "model"
    says 0 and the rules that a model judges have no mean. titles are those of readers.session_titles, states (source, state) name failed sources.
    """
    more = {} if patterns is None else {"patterns": patterns.select(F.col("pattern").alias("row"), "support")}
    if titles is not None:
        more["titles"] = titles.groupBy(F.concat_ws(" ", "day", "title").alias("row")).agg(F.count("*").alias("sessions"))
    if states is not None:
        more["skipped"] = states.where("state = 'failed'").select(F.col("source").alias("row"), F.lit(1).alias("failed"))
    return {
        "totals": metrics.window_totals(prompts).withColumn("row", F.lit("window")),
        "sources": metrics.counts_by_source(prompts).withColumnRenamed("source", "row"),
        "style": metrics.stats_table(prompts).withColumnRenamed("measure", "row"),
        "rubric": rubric.summary(rubric.scores(rubric.substantive(prompts))).select(F.col("rule").alias("row"), "human_mean", "machine_mean", "coverage"),
        "fit": fit.summary(prompts).withColumn("row", F.lit("all")),
        **more,
    }


def report_since(prompts: DataFrame, start: Column, patterns: DataFrame | None = None, titles: DataFrame | None = None, states: DataFrame | None = None) -> dict[str, DataFrame]:
    """The report of a window with the frame "model"; of an empty window or table one frame alone, "state", that says which it is."""
    window = prompts.where(F.col("timestamp") >= start)
    if window.isEmpty():
        return {"state": metrics.empty_state(prompts, start).select(F.col("state").alias("row"), "all_rows", "window_rows")}
    available = prompts.sparkSession.createDataFrame([("available", int(patterns is not None))], "row string, model int")
    return {**report(window, patterns, titles, states), "model": available}


def dashboard(prompts: DataFrame, now: int, documents: DataFrame | None = None, home: str = "/") -> dict[str, DataFrame]:
    """The frames of the dashboard; documents (dir, name) add the summary of those near the working directories."""
    frames = report(prompts)
    more = {} if documents is None else {"docs": docs.summary(prompts.where("cwd is not null"), documents, home).withColumn("row", F.lit("all"))}
    volumes = metrics.weekly_volumes(prompts, now).groupBy("source").pivot("week", list(range(12))).agg(F.sum("n"))
    volumes = volumes.select(F.col("source").alias("row"), *(F.col(str(i)).alias(f"w{i}") for i in range(12)))
    return {"volumes": volumes, "style": frames["style"], "rubric": frames["rubric"], "fit": frames["fit"], **more}


def cells(frames: dict[str, DataFrame]) -> DataFrame:
    """(section, row, col, value) of all frames; null cells are left out."""
    out = []
    for section, df in frames.items():
        columns = [c for c in df.columns if c != "row"]
        pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
        out.append(df.select(F.lit(section).alias("section"), "row", F.expr(f"stack({len(columns)}, {pairs}) as (col, value)")).where("value is not null"))
    return reduce(DataFrame.unionByName, out)


def write(cells: DataFrame, path: str) -> None:
    """The cells as one CSV file in order of section, row and column: sources, weeks, rules and patterns bound their number, not prompts."""
    cells.coalesce(1).sortWithinPartitions("section", "row", "col").write.option("header", True).csv(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("section string, row string, col string, value double").csv(path)
