import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingscope.operators import archetypes, atypical, models, perturb
from ratingscope.schema import KEYS
from ratingscope.sources import sinks
from tests.test_models import F1, F2, table


def test_all_or_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    good = spark.range(10).withColumn("x", F.lit("a,b"))
    bad = spark.range(10).repartition(4).withColumn("y", F.when(F.col("id") == 7, F.raise_error(F.lit("seven")).cast("int")))
    with pytest.raises(Exception, match="seven"):
        sinks.publish(spark, {"good": good, "bad": bad}, folder)
    assert not os.path.exists(folder) or os.listdir(folder) == []
    assert sinks.publish(spark, {"good": good}, folder) == ["good"]
    assert {n for n in os.listdir(folder) if not n.startswith(".")} == {"good", sinks.MANIFEST}
    assert sorted(map(tuple, sinks.read_published(spark, folder)["good"].collect())) == [(k, "a,b") for k in range(10)]
    with pytest.raises(FileExistsError, match="good"):
        sinks.publish(spark, {"good": good}, folder)


def test_result_and_attack_rows(spark, tmp_path):
    r = table(spark, F1, F2)
    iwf = models.score(r)
    names = r.select(*KEYS, F.col("recipient").alias("email")).distinct().withColumn("name", F.upper("email"))
    rows = sinks.result_rows(iwf, r, names)
    assert tuple(rows.columns) == sinks.RESULT_COLUMNS and rows.count() == 6 * 7
    one = rows.where("model = 'webpa' and team = 't0' and student_email = 's0'").first()
    assert (one.session, one.student_name, one.iwf, one.converged) == ("S1-2024", "S0", 7.6596, None)
    summary = sinks.attack_rows(perturb.attack_summary(perturb.runs(r, 2, ("baseline",))))
    assert tuple(summary.columns) == sinks.ATTACK_COLUMNS
    got = {x.attack: x for x in summary.collect()}
    assert got["single_outlier"].mc_std is not None and got["uniform_inflation"].mc_std is None and got["zero_self_full"].n == 2


def test_dynamics_are_six_tables(spark, tmp_path):
    r = np.random.default_rng(11)
    ratings = table(spark, *[r.integers(0, 20, (5, 5)).tolist() for _ in range(12)])
    parts = atypical.team_dynamics(ratings, models.score(ratings, ("baseline", "webpa")))
    z = parts["standardised"]
    fits = archetypes.sweep(z.drop(*KEYS), [c for c in z.columns if c not in KEYS], range(2, 4), max_iter=4, n_bootstrap=2, restarts=1)
    tables, kinds = sinks.dynamics_tables(parts, fits)
    sinks.publish(spark, tables, str(tmp_path / "dynamics"), kinds)
    back = sinks.read_published(spark, str(tmp_path / "dynamics"))
    assert {n: df.count() for n, df in back.items()} == {"atypicality_summary": 2, "classifications": 12, "delta_by_label": 5, "feature_matrix": 12, "archetypes": 2, "archetype_stability": 2}
    assert {"delta", "atypicality", "degenerate", "dynamic_label", "dist_cohesive", "weight_free_rider"} <= set(back["classifications"].columns)
    with pytest.raises(ValueError, match="at least 4"):
        atypical.team_dynamics(table(spark, F1, F2), models.score(table(spark, F1, F2), ("baseline", "webpa")))
