"""Members of teams, the four notions of a rater that is missing, and the checks on ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingscope.schema import KEYS


def members(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, email, idx): everyone who gives or receives, numbered by e-mail from 0."""
    all_ = ratings.select(*keys, F.explode(F.array("giver", "recipient")).alias("email")).distinct()
    return all_.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy("email")) - 1)


def grid(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The complete matrix of every team: members x members, left-joined with the ratings. The last non-missing score of a
    cell counts; give ``pos`` to order repeated cells."""
    m = members(ratings, keys)
    cells = m.withColumnRenamed("email", "giver").drop("idx").join(m.withColumnRenamed("email", "recipient").drop("idx"), keys)
    order = "pos" if "pos" in ratings.columns else "score"
    known = ratings.where("score is not null").groupBy(*keys, "giver", "recipient").agg(F.max_by("score", order).alias("score"))
    return cells.join(known, [*keys, "giver", "recipient"], "left")


def raters(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, giver, n_scores, n_peer): how many scores each giver has given, and to others."""
    peer = F.when(F.col("giver") != F.col("recipient"), F.col("score"))
    return ratings.groupBy(*keys, "giver").agg(F.count("score").alias("n_scores"), F.count(peer).alias("n_peer"))


def missing_in_file(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(a) Givers with rows, all of whose scores are missing, the one for themselves too."""
    return raters(ratings, keys).where("n_scores = 0").select(*keys, "giver")


def without_peer_scores(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(b) Members who have scored none of the others, whether or not they scored themselves or have rows at all."""
    gave = raters(ratings, keys).where("n_peer > 0").select(*keys, F.col("giver").alias("email"))
    return members(ratings, keys).join(gave, [*keys, "email"], "left_anti").select(*keys, F.col("email").alias("giver"))


def without_scores(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(c) Members without any score given, self included, whether or not they have rows."""
    gave = raters(ratings, keys).where("n_scores > 0").select(*keys, F.col("giver").alias("email"))
    return members(ratings, keys).join(gave, [*keys, "email"], "left_anti").select(*keys, F.col("email").alias("giver"))


def active_raters(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(d) Givers with a score, self included, ranked by e-mail from 1: those whom perturbations change."""
    gave = raters(ratings, keys).where("n_scores > 0")
    return gave.select(*keys, "giver", F.row_number().over(Window.partitionBy(*keys).orderBy("giver")).alias("rater_rank"))


def team_counts(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, n_members, n_missing): members, and missing raters under (a)."""
    size = ratings.groupBy(*keys).agg(F.count_distinct("recipient").alias("n_members"))
    gone = missing_in_file(ratings, keys).groupBy(*keys).agg(F.count("*").alias("n_missing"))
    return size.join(gone, keys, "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0)))


def excluded_teams(ratings: DataFrame, share: float = 0.5, keys: list[str] = KEYS) -> DataFrame:
    """Teams in which ``share`` of the members or more are missing raters."""
    return team_counts(ratings, keys).where(F.col("n_missing") >= share * F.col("n_members"))


def kept(ratings: DataFrame, share: float = 0.5, keys: list[str] = KEYS) -> DataFrame:
    """The ratings of teams that aren't excluded. Counts come from a window over the keys, so that what follows by team
    needs no further shuffle."""
    by_giver, by_team = Window.partitionBy(*keys, "giver"), Window.partitionBy(*keys)
    first = (F.col("giver") == F.col("recipient")).cast("int")
    out = ratings.withColumn("_given", F.count("score").over(by_giver))
    out = out.withColumns({"_n": F.sum(first).over(by_team), "_gone": F.sum(first * (F.col("_given") == 0).cast("int")).over(by_team)})
    return out.where(F.col("_gone") < share * F.col("_n")).drop("_given", "_n", "_gone")


def of_teams(ratings: DataFrame, teams: list[str]) -> DataFrame:
    """The ratings of the named teams; names that no rating has are an error."""
    found = {r.team for r in ratings.where(F.col("team").isin(*teams)).select("team").distinct().collect()} if teams else set()  # as many as were named
    if unknown := [t for t in teams if t not in found]:
        raise ValueError(f"unknown teams: {', '.join(unknown)}")
    return ratings.where(F.col("team").isin(*teams)) if teams else ratings.limit(0)


# ---------------------------------------------------------------- diagnostics


def rater_missing(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return missing_in_file(ratings, keys).select(*keys, F.lit("rater_missing").alias("event"), F.lit("no scores submitted").alias("detail"), F.col("giver").alias("student_email"))


def team_excluded(ratings: DataFrame, share: float = 0.5, keys: list[str] = KEYS) -> DataFrame:
    detail = F.format_string("%d/%d raters missing", "n_missing", "n_members")
    return excluded_teams(ratings, share, keys).select(*keys, F.lit("team_excluded").alias("event"), detail.alias("detail"), F.lit(None).cast("string").alias("student_email"))


def point_totals(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, giver, total, team_median): what each submitter has given away, self included, and the team's exact median."""
    totals = ratings.groupBy(*keys, "giver").agg(F.sum("score").alias("total")).where("total is not null")
    return totals.withColumn("team_median", F.percentile("total", 0.5).over(Window.partitionBy(*keys)))


def point_total_mismatch(ratings: DataFrame, tolerance: float = 1.0, keys: list[str] = KEYS) -> DataFrame:
    detail = F.format_string("total %.0f, team median %.1f", "total", "team_median")
    off = point_totals(ratings, keys).where(F.abs(F.col("total") - F.col("team_median")) > tolerance)
    return off.select(*keys, F.lit("point_total_mismatch").alias("event"), detail.alias("detail"), F.col("giver").alias("student_email"))


def summary_cross_check(ratings: DataFrame, summary: DataFrame, tolerance: float = 1.0, keys: list[str] = KEYS) -> DataFrame:
    """Received totals against the totals that the file itself states (keys, email, stated)."""
    got = ratings.groupBy(*keys, F.col("recipient").alias("email")).agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("received"))
    off = got.join(summary, [*keys, "email"]).where(F.abs(F.col("received") - F.col("stated")) > tolerance)
    detail = F.format_string("received %.0f, summary says %.0f", "received", "stated")
    return off.select(*keys, F.lit("summary_cross_check").alias("event"), detail.alias("detail"), F.col("email").alias("student_email"))


def diagnostics(ratings: DataFrame, summary: DataFrame | None = None, keys: list[str] = KEYS) -> DataFrame:
    """All checks in one table. Totals are checked only in teams that aren't excluded."""
    left = kept(ratings, keys=keys)
    out = rater_missing(ratings, keys).unionByName(team_excluded(ratings, keys=keys)).unionByName(point_total_mismatch(left, keys=keys))
    return out if summary is None else out.unionByName(summary_cross_check(left, summary, keys=keys))


def shape_errors(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Teams whose rows aren't a square: members x members, each cell once."""
    n = members(ratings, keys).groupBy(*keys).agg(F.count("*").alias("n_members"))
    cells = ratings.groupBy(*keys).agg(F.count("*").alias("n_cells"), F.count_distinct("giver", "recipient").alias("n_distinct"))
    return cells.join(n, keys).where("n_cells <> n_members * n_members or n_distinct <> n_cells")
