"""Named queries over the ratings view, and their SQL twins for DuckDB.

Numbers that come from sums of floats are rounded to six digits on both sides, for the order of additions differs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingscope.operators import archetypes, atypical, compare, fingerprint, inside, members, models, perturb, report
from ratingscope.operators.models import Teams
from ratingscope.plans import sql
from ratingscope.schema import KEYS
from ratingscope.shared import written
from ratingscope.sources import sessions
from ratingscope.sources.ratings_view import ratings, teams, teams_to_be

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = sql.ORACLE_SQL


def _query(fn: Callable[[DataFrame], DataFrame], whole: bool = False, name: str | None = None, packed: bool = False, view: Callable | None = None) -> Callable:
    """Register a query over the kept ratings (all of them if ``whole``), as packed teams if ``packed``, or as another ``view`` has them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn((view or (teams if packed else ratings))(spark, sf_dir, None if whole else 0.5))

    QUERIES[name or fn.__name__] = run
    return fn


def _packed(fn: Callable[[DataFrame], DataFrame]) -> Callable:
    return _query(fn, packed=True)


def _in_tasks(fn: Callable[[Teams], DataFrame]) -> Callable:
    """Over teams that are made in the tasks that ask of them."""
    return _query(fn, view=teams_to_be)


def _digits(c: str, n: int) -> Column:
    """Rounded as the SQL twins' engine does it: the product with a power of ten, half away from zero. Spark's own rounds the shortest decimal that
    names the number, which differs where that ends in a five and the product lies below the half."""
    return F.round(F.col(c) * 10.0**n) / 10.0**n


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    """Six digits, and no negative zero."""
    return df.withColumns({c: _digits(c, 6) + 0.0 for c in cols})


def _distances(df: DataFrame, *cols: str) -> DataFrame:
    """Six digits of what nine say: means of distances often end in a five in the seventh digit, as scores are halves and eighths."""
    return _rounded(df.withColumns({c: _digits(c, 9) for c in cols}), *cols)


def _counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def _model(name: str) -> None:
    def run(r: DataFrame) -> DataFrame:
        iwf = models.score(r, (name,)).where("error is null")
        hub = ["hub"] if "peerhits" in name else []
        return _rounded(iwf.select(*KEYS, "email", "iwf", *hub), "iwf", *hub)

    _query(run, packed=name not in ("baseline", "webpa"), name=f"{name.replace('-', '_')}_iwf")


for _name in (*models.NAMES, "peerrank", "peerhits"):
    _model(_name)


@_in_tasks
def run_failures(r: Teams) -> DataFrame:
    """Teams for which a model fails."""
    return inside.run_status(r, only_failed=True).select(*KEYS, "model", "error")


@_in_tasks
def convergence_stats(r: Teams) -> DataFrame:
    out = report.convergence_stats(inside.convergence(r))
    return _rounded(out, "mean_iterations", "median_iterations")


@_query
def iwf_pivot(r: DataFrame) -> DataFrame:
    wide = compare.side_by_side(models.score(r, ("baseline", "webpa")), ("baseline", "webpa"))
    return _rounded(wide, "baseline", "webpa", "max_delta")


@_in_tasks
def iwf_side_by_side(r: Teams) -> DataFrame:
    """All six models."""
    wide = inside.side_by_side(r)
    names = [n.replace("-", "_") for n in models.NAMES]
    return _rounded(wide.toDF(*KEYS, "email", *names, "max_delta"), *names, "max_delta")


@_query
def iwf_bands(r: DataFrame) -> DataFrame:
    return compare.banded(models.score(r, ("baseline", "webpa"))).groupBy("model", "band").agg(F.count("*").alias("n"))


@_packed
def session_results(r: DataFrame) -> DataFrame:
    """The result rows of a run, all models, as they are written to files."""
    return inside.results(written(r, "teams"))


@_query
def member_grades(r: DataFrame) -> DataFrame:
    return _rounded(compare.grades(models.webpa(r), 80.0).where("error is null").select(*KEYS, "email", "grade"), "grade")


def _whole(fn):
    return _query(fn, whole=True)


@_whole
def team_exclusions(r: DataFrame) -> DataFrame:
    return _counts(members.excluded_teams(r).select(*KEYS, "n_members", "n_missing"), "n_members", "n_missing")


@_whole
def rater_missing(r: DataFrame) -> DataFrame:
    return members.rater_missing(r).select(*KEYS, "student_email")


@_query
def point_total_mismatch(r: DataFrame) -> DataFrame:
    off = members.point_totals(r).where(F.abs(F.col("total") - F.col("team_median")) > 1.0)
    return _rounded(off.select(*KEYS, "giver", "total", "team_median"), "total", "team_median")


@_whole
def diagnostic_events(r: DataFrame) -> DataFrame:
    return report.event_counts(members.diagnostics(r))


@_whole
def non_submitter_kinds(r: DataFrame) -> DataFrame:
    """How many raters are missing under each of the four notions."""
    kinds = {"a": members.missing_in_file(r), "b": members.without_peer_scores(r), "c": members.without_scores(r), "d": members.active_raters(r)}
    out = None
    for k, df in kinds.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@_packed
def rank_reversal_pairs(r: DataFrame) -> DataFrame:
    pairs = compare.reversal_pairs(models.score(r))
    return _rounded(pairs, "base_diff", "adv_diff", "magnitude")


@_in_tasks
def rank_reversal_summary(r: Teams) -> DataFrame:
    s = inside.reversal_summary(r)
    return _rounded(s, "rate")


@_in_tasks
def rank_reversal_aggregate(r: Teams) -> DataFrame:
    s = inside.reversal_summary(r)
    return _rounded(compare.reversal_aggregate(s), "mean_rate", "pooled_rate")


@_in_tasks
def cross_model_delta(r: Teams) -> DataFrame:
    return _distances(inside.cross_model_delta(r), "delta")


@_in_tasks
def model_pair_delta(r: Teams) -> DataFrame:
    return _distances(inside.pair_delta(r), "delta")


@_in_tasks
def batch_totals(r: Teams) -> DataFrame:
    return report.totals(inside.run_status(r))


@_query
def distinct_teams(r: DataFrame) -> DataFrame:
    return report.distinct_teams(r)


@_query
def team_size_stats(r: DataFrame) -> DataFrame:
    return _rounded(_counts(report.team_sizes(r), "min_size", "max_size"), "mean_size", "median_size")


@_query
def iwf_range(r: DataFrame) -> DataFrame:
    return _rounded(report.iwf_range(models.baseline(r)), "min_iwf", "max_iwf", "mean_iwf", "std_iwf")


def _transform(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    _query(lambda r: _rounded(fn(r).select(*KEYS, "giver", "recipient", "score"), "score"), name=name)


_transform("uniform_inflation", perturb.uniform_inflation)
_transform("zero_self_full", perturb.zero_self)
_transform("zero_self_partial", lambda r: perturb.zero_self(r, colluders=2))
_transform("targeted_downvote", perturb.targeted_downvote)
_query(lambda r: _rounded(perturb.outliers_in_tasks(r), "score"), name="single_outlier", view=teams_to_be)
_transform("strategic_silence", perturb.strategic_silence)
_transform("sabotage_of_the_best", perturb.sabotage_of_the_best)


@_packed
def attack_delta(r: DataFrame) -> DataFrame:
    """Every perturbation under all six models, by team."""
    d = perturb.runs(_table(r))
    return _distances(d.where("error is null").select(*KEYS, "variant", "model", "delta"), "delta")


@_packed
def attack_runs(r: DataFrame) -> DataFrame:
    """Every perturbation under all six models, by team; a run that fails is a row with its error."""
    slim = _table(r)
    d = perturb.runs(slim).select(*KEYS, "variant", "model", "delta", "error")
    return _distances(d.unionByName(perturb.failures(slim), allowMissingColumns=True), "delta")


@_packed
def attack_failures(r: DataFrame) -> DataFrame:
    """Teams that a perturbation can't be applied to, and why."""
    return perturb.failures(r)


@_packed
def permutation_robustness(r: DataFrame) -> DataFrame:
    """A hundred permutations of one rater under all six models."""
    return _distances(perturb.permutation_robustness(perturb.team_summaries(_table(r), 100, only=("single_outlier",))), "mean_delta", "std_delta", "min_delta", "max_delta", "mean_iterations")


@_packed
def two_permutations(r: DataFrame) -> DataFrame:
    """The same code at two permutations, which its SQL twin can follow."""
    out = perturb.permutation_robustness(perturb.team_summaries(_table(r), 2, only=("single_outlier",))).select(*KEYS, "model", "n_perms", "mean_delta", "std_delta", "min_delta", "max_delta")
    return _distances(out, "mean_delta", "std_delta", "min_delta", "max_delta")


def _matrix(r: DataFrame, n_perms: int) -> DataFrame:
    wide = perturb.robustness_matrix(perturb.attack_summary(perturb.team_summaries(_table(r), n_perms)))
    names = [n.replace("-", "_") for n in models.NAMES]
    return _distances(wide.toDF("variant", *names), *names)


@_packed
def robustness_matrix(r: DataFrame) -> DataFrame:
    """Mean deltas of every perturbation under every model, a hundred permutations of one rater among them."""
    return _matrix(r, 100)


@_packed
def robustness_of_two_permutations(r: DataFrame) -> DataFrame:
    """The same code at two permutations."""
    return _matrix(r, 2)


def _table(r: DataFrame) -> DataFrame:
    """Packed teams, written once: operators ask of them whether there are teams that are no matrices, and read them more than once."""
    return written(r.select(*KEYS, "n", "emails", "cells", "arcs"), "teams")


def _feature(name: str, fn: Callable[[DataFrame], DataFrame], *cols: str, packed: bool = False) -> None:
    _query(lambda r: _rounded(fn(r).select(*KEYS, *cols), *cols), name=name, packed=packed)


_feature("reciprocity", fingerprint.pair_features, "reciprocity")
_feature("asymmetry", fingerprint.pair_features, "asymmetry")
_feature("gini_in_degree", fingerprint.gini, "gini_in_degree")
_feature("rater_std", fingerprint.rater_spread, "mean_rater_std", "std_rater_std")
_feature("self_share", fingerprint.submission, "non_submitter_frac", "mean_self_share")
_feature("assortativity", fingerprint.assortativity, "assortativity")
_feature("clustering", lambda r: fingerprint.triple_features(_table(r)), "clustering", packed=True)
_feature("triad_census", lambda r: fingerprint.triple_features(_table(r)), *(f"triad_{t}" for t in fingerprint.TRIADS), packed=True)
_feature("member_degrees", lambda r: fingerprint.degrees(r).withColumn("question", F.concat_ws("/", "question", "email")), "in_weight", "out_weight")
_feature("scaled_edges", lambda r: fingerprint.scaled_edges(r).withColumn("question", F.concat_ws("/", "question", "giver", "recipient")), "scaled")


@_in_tasks
def feature_matrix(r: Teams) -> DataFrame:
    return _rounded(_counts(fingerprint.feature_table(r), "n_students", "non_submitter_count"), *fingerprint.FEATURES)


@_in_tasks
def degenerate_cause(r: Teams) -> DataFrame:
    return atypical.degenerate(fingerprint.feature_table(r)).select(*KEYS, "cause")


def _behaviour(r: Teams) -> DataFrame:
    """Six features, written once: their ends or ranks are taken first."""
    return fingerprint.feature_table(r, fingerprint.BEHAVIOUR[:6]).select(*KEYS, *fingerprint.BEHAVIOUR[:6])


@_in_tasks
def metric_profile(r: Teams) -> DataFrame:
    return _rounded(fingerprint.metric_profile(_behaviour(r)), *fingerprint.BEHAVIOUR[:6])


@_in_tasks
def metric_percentiles(r: Teams) -> DataFrame:
    """The same features by rank among all teams. Features count to six digits, so that rounding in the last place makes no ranks."""
    f = _rounded(_behaviour(r), *fingerprint.BEHAVIOUR[:6])
    return _rounded(fingerprint.metric_profile(f, percentile=True), *fingerprint.BEHAVIOUR[:6])


def _scaled(r: Teams, delta: bool = False) -> tuple[DataFrame, DataFrame, atypical.Scale]:
    # a written table, or the whole fingerprint would be computed for each statistic; it has a number for every feature, so none is imputed
    f = atypical.degenerate(fingerprint.feature_table(r, delta=delta))
    scale = atypical.fit_scale(f)
    return f, atypical.standardised(f, scale), scale


@_in_tasks
def standardised_features(r: Teams) -> DataFrame:
    _, z, scale = _scaled(r)
    return _rounded(z.select(*KEYS, *scale.names), *scale.names)


@_in_tasks
def standardised_long(r: Teams) -> DataFrame:
    _, z, scale = _scaled(r)
    return _rounded(atypical.standardised_long(z, scale), "z")


@_in_tasks
def atypicality(r: Teams) -> DataFrame:
    _, z, scale = _scaled(r)
    return _rounded(atypical.atypicality(z, scale).select(*KEYS, "cause", "distance", "flag"), "distance")


@_in_tasks
def nearest_prototype(r: Teams) -> DataFrame:
    _, z, scale = _scaled(r)
    out = atypical.nearest_prototype(z, scale, atypical.prototype_features(z.sparkSession))
    numbers = [c for c in out.columns if c.startswith(("dist_", "weight_"))]
    return _rounded(out.select(*KEYS, "label", *numbers), *numbers)


@_in_tasks
def delta_by_label(r: Teams) -> DataFrame:
    _, z, scale = _scaled(r, delta=True)
    labelled = atypical.nearest_prototype(z, scale, atypical.prototype_features(z.sparkSession))
    return _distances(atypical.delta_by_label(labelled), "mean", "std", "median", "max")


@_in_tasks
def delta_correlation(r: Teams) -> DataFrame:
    _, z, scale = _scaled(r, delta=True)
    return _rounded(atypical.delta_correlation(atypical.atypicality(z, scale)), "r", "p")


@_in_tasks
def principal_components(r: Teams) -> DataFrame:
    _, z, scale = _scaled(r)
    return _rounded(atypical.principal_components(z, scale)[0].select(*KEYS, "pc1", "pc2"), "pc1", "pc2")


@_in_tasks
def archetype_weights(r: Teams) -> DataFrame:
    """Three archetypes, the best of five starts: each team's weights."""
    _, z, scale = _scaled(r)
    _, rows, _ = archetypes.fit_best(z.select(*KEYS, *scale.names), scale.names, k=3, max_iter=400, restarts=5)
    return rows.select(*KEYS, *(F.round(F.col("w")[j], 6).alias(f"weight_{j}") for j in range(3)))


@_in_tasks
def archetype_sweep(r: Teams) -> DataFrame:
    """Residual and stability of two to eight archetypes, and which number is the elbow."""
    _, z, scale = _scaled(r)
    fits = archetypes.sweep(written(z.select(*scale.names), "standardised"), scale.names)
    return _rounded(fits.crossJoin(archetypes.elbow(fits)).select("k", "rss", "stability", (F.col("k") == F.col("elbow")).alias("is_elbow")), "rss", "stability")


@_whole
def session_parse_roundtrip(r: DataFrame) -> DataFrame:
    """The view rendered as session exports and parsed again."""
    return sessions.parse(sessions.as_lines(r))["ratings"].select(*KEYS, "year", "semester", F.col("session_number").cast("long").alias("session_number"), "giver", "recipient", "score")
