"""Data-quality report: small aggregates over the iwf table, the run status and the diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingscope.operators import compare, members, models
from ratingscope.schema import KEYS


def event_counts(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("event").agg(F.count("*").alias("n"))


def distinct_teams(ratings: DataFrame) -> DataFrame:
    """Bare team names and sessions; a team name in several sessions counts once."""
    session = F.element_at(F.split("csv_path", "/"), -1)
    return ratings.agg(F.count_distinct("team").alias("unique_teams"), F.count_distinct(session).alias("sessions"))


def failures(status: DataFrame) -> DataFrame:
    return status.where("error is not null")


def convergence_stats(convergence: DataFrame) -> DataFrame:
    """By iterative model; runs without iterations count as runs, a model that has none with is left out."""
    out = convergence.groupBy("model").agg(
        F.count("*").alias("total_runs"),
        F.count_if("converged").alias("converged"),
        F.count_if(~F.col("converged")).alias("non_converged"),
        F.avg("iterations").alias("mean_iterations"),
        F.percentile("iterations", 0.5).alias("median_iterations"),
        F.min("iterations").alias("min_iterations"),
        F.max("iterations").alias("max_iterations"),
    )
    return out.where("max_iterations is not null")


def non_converged(convergence: DataFrame) -> DataFrame:
    return convergence.where("not converged")


def team_sizes(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    n = ratings.groupBy(*keys).agg(F.count_distinct("recipient").alias("n"))
    return n.agg(F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.avg("n").alias("mean_size"), F.percentile("n", 0.5).alias("median_size"), F.count("*").alias("matrices"))


def iwf_range(iwf: DataFrame, model: str = "baseline") -> DataFrame:
    x = iwf.where((F.col("model") == model) & F.col("iwf").isNotNull())
    return x.agg(F.min("iwf").alias("min_iwf"), F.max("iwf").alias("max_iwf"), F.avg("iwf").alias("mean_iwf"), F.stddev_pop("iwf").alias("std_iwf"))


def totals(status: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    matrix = F.struct(*keys)
    return status.agg(F.count_distinct("csv_path").alias("files"), F.count_distinct(matrix).alias("matrices"), F.count("*").alias("runs"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def report(ratings: DataFrame, delta: float = 1.5, keys: list[str] = KEYS) -> dict[str, DataFrame]:
    """All parts of the report by name. Scores are computed once and kept."""
    left = members.kept(ratings, keys=keys)
    iwf = models.score(left, keys=keys).persist()
    status, conv = models.run_status(iwf, keys), models.convergence(iwf, keys)
    checks = members.diagnostics(ratings, keys=keys)
    summary = compare.reversal_summary(iwf, delta, keys=keys)
    return {
        "totals": totals(status, keys),
        "events": event_counts(checks),
        "teams": distinct_teams(left),
        "failures": failures(status),
        "convergence": convergence_stats(conv),
        "non_converged": non_converged(conv),
        "reversals": compare.reversal_aggregate(summary).withColumn("delta_iwf", F.lit(delta)),
        "sizes": team_sizes(left, keys),
        "baseline_range": iwf_range(iwf),
    }
