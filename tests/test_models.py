import numpy as np
import pytest

from ratingscope.operators import compare, members, models, report
from ratingscope.schema import KEYS

X = None


def table(spark, *teams):
    """Ratings of teams given as matrices: rows are recipients, columns givers, None is missing."""
    rows = [("f", "2024", "S1", 1, f"t{k}", "q", f"s{j}", f"s{i}", None if x is None else float(x)) for k, m in enumerate(teams) for i, row in enumerate(m) for j, x in enumerate(row)]
    return spark.createDataFrame(rows, "csv_path string, year string, semester string, session_number int, team string, question string, giver string, recipient string, score double")


def iwf(df, model, team="t0"):
    rows = sorted((r.email, r.iwf) for r in df.where(f"model = '{model}' and team = '{team}'").collect())
    return [x for _, x in rows]


F1 = [[10, 6, 8], [12, 10, 14], [8, 14, 12]]
F2 = [[10, 8, 12, X], [12, 10, 8, X], [8, 12, 10, X], [6, 6, 6, X]]
F5 = [[0, 6, 3], [3, 0, 6], [6, 4, 0]]
F9 = [[0, 6, X], [3, 0, X], [6, 4, X]]
F12 = [[10.0] * 5 + [X]] * 6
F13 = [[12, 0, 12, 0, 12]] * 4 + [[12, 60, 12, 60, 12]]


def test_averages(spark):
    r = table(spark, F1, F2, [[10, 6, 8], [15, 10, 5], [5, 8, 17]], [[20, 6, 8], [5, 10, 5], [5, 8, 17]], F13, [[0, 0], [0, 0]])
    s = models.score(r, ("baseline", "webpa"))
    assert iwf(s, "baseline") == [7, 13, 11]
    assert iwf(s, "webpa") == pytest.approx([240 / 31.3333333333, 360 / 31.3333333333, 340 / 31.3333333333])
    assert iwf(s, "baseline", "t1") == [10, 10, 10, 6] and iwf(s, "webpa", "t1") == pytest.approx([300 / 27] * 3 + [180 / 27])
    assert iwf(s, "baseline", "t2") == [7, 10, 6.5]
    assert iwf(s, "webpa", "t3")[0] == pytest.approx(34 / 28 * 10)
    assert iwf(s, "baseline", "t4") == pytest.approx([6, 9, 6, 9, 36])
    failed = {(x.team, x.model) for x in models.run_status(s).where("error is not null").collect()}
    assert failed == {("t5", "webpa")}


def test_peerrank(spark):
    r = table(spark, F5, F12, F13, [[5, 0], [0, 5]])
    s = models.score(r, models.ITERATIVE).persist()
    assert iwf(s, "peerrank") == pytest.approx([9.27786038, 10.19588629, 10.52625333], abs=1e-7)
    run = s.where("model = 'peerrank' and team = 't0'").first()
    assert run.converged and run.iterations == 104 and run.final_l1 < 1e-6
    assert iwf(s, "peerrank", "t1") == pytest.approx([9.474] * 5 + [12.631], abs=1e-3)
    assert iwf(s, "peerrank-impute", "t1") == pytest.approx([10] * 6)
    assert iwf(s, "peerrank-exclude", "t1")[:5] == pytest.approx([10] * 5) and iwf(s, "peerrank-exclude", "t1")[5] is None
    assert iwf(s, "peerhits", "t1") == pytest.approx([9.6] * 5 + [12.0], abs=1e-3)
    assert iwf(s, "peerrank", "t2") == pytest.approx([5.906, 7.326, 5.906, 7.326, 23.536], abs=1e-3)
    assert iwf(s, "peerhits", "t2") == pytest.approx([1.054, 1.991, 1.054, 1.991, 43.911], abs=1e-3)
    errors = {(x.team, x.model): x.error for x in models.run_status(s).where("error is not null").collect()}
    assert set(errors) == {("t3", "peerrank"), ("t3", "peerrank-impute"), ("t3", "peerrank-exclude")} and "s0" in errors["t3", "peerrank"]
    assert models.solve(np.array([F5], float), "peerrank")[2][0]


def test_exclusion_equals_the_reduced_team(spark):
    r = table(spark, F9, [[0, 6], [3, 0]], [[0, X], [5, X]], [[X] * 3] * 3)
    s = models.score(r, ("peerrank-exclude", "peerhits-exclude", "peerrank", "peerhits")).persist()
    for m in ("peerrank", "peerhits"):
        assert iwf(s, f"{m}-exclude")[:2] == pytest.approx(iwf(s, m, "t1")) and iwf(s, f"{m}-exclude")[2] is None
        for t in ("t2", "t3"):
            rows = s.where(f"model = '{m}-exclude' and team = '{t}'").collect()
            assert all(x.iwf is None and x.converged is None and x.iterations is None and x.error is None for x in rows)
    assert iwf(s, "peerhits", "t1") == pytest.approx([20, 0], abs=1e-3)


def test_hits_order_and_equal_teams(spark):
    same = [[[10] * n] * n for n in (3, 4, 5, 6)]
    r = table(spark, [[10, 2, 3], [15, 10, 14], [15, 8, 10]], [[10, 8, 8], [8, 10, 8], [8, 8, 30]], *same)
    s = models.score(r, (*models.NAMES, "peerrank", "peerhits")).persist()
    h = iwf(s, "peerhits")
    assert h[1] > h[2] > h[0]
    assert iwf(s, "peerhits", "t1") == pytest.approx([10] * 3)
    for k in range(4):
        for m in (*models.NAMES, "peerrank", "peerhits"):
            assert iwf(s, m, f"t{k + 2}") == pytest.approx([10] * (k + 3))
    with pytest.raises(ValueError):
        models.score(r, ("nonsense",))


def pairs(spark, base, adv):
    rows = [("f", "t", "q", f"s{i}", m, float(x)) for m, v in (("baseline", base), ("other", adv)) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "csv_path string, team string, question string, email string, model string, iwf double").selectExpr("*", "cast(null as string) as error")


@pytest.mark.parametrize(
    "base, adv, want",
    [([12, 10, 8], [9, 11, 10], (2, 3, 3)), ([12, 10, 8], [14, 10, 6], (0, 3, 3)), ([12, 10, 5], [9.5, 10.5, 10], (2, 3, 3)), ([10] * 4, [10.1, 9.9, 10.2, 9.8], (0, 0, 6)), ([12, 8], [7, 13], (1, 1, 1)), ([10.5, 10, 5], [9, 11, 10], (1, 2, 3))],
)
def test_reversals(spark, base, adv, want):
    got = compare.reversal_summary(pairs(spark, base, adv)).first()
    assert (got.reversed, got.eligible, got.pairs) == want
    agg = compare.reversal_aggregate(compare.reversal_summary(pairs(spark, base, adv))).first()
    assert agg.pooled_rate == pytest.approx(want[0] / want[1] if want[1] else 0)


def test_counted_reversals_equal_pairs(spark):
    r = np.random.default_rng(6)
    rows = []
    for t, n in enumerate((1, 2, 5, 5, 30, 70)):
        for m in ("baseline", "other", "third"):
            for k in range(n - (m == "third" and n == 5)):
                v = float(r.integers(0, 12)) / 2 + (1e-12 if r.random() < 0.2 else 0)
                rows.append(("f", f"t{t}", "q", f"s{k:02}", m, None if r.random() < 0.1 else v, "failed" if m == "third" and t == 3 else None))
    df = spark.createDataFrame(rows, "csv_path string, team string, question string, email string, model string, iwf double, error string").persist()
    listed = compare._judged(compare.member_pairs(df), 1.5).groupBy("team", "model").agg(models.F.count_if("reversed").alias("r"), models.F.count_if("eligible").alias("e"), models.F.count("*").alias("p"))
    want = sorted(map(tuple, listed.collect()))
    for pairwise in (64, 1, 5):
        got = compare.reversal_summary(df, pairwise=pairwise).select("team", "model", "reversed", "eligible", "pairs")
        assert sorted(map(tuple, got.collect())) == want and len(want) == 9
    base, adv = r.normal(size=3000) * 3, r.normal(size=3000) * 3
    assert compare.counted_reversals(base, adv, 1.5) == tuple(int(x[0]) for x in compare._pairwise(base[None], adv[None], 1.5))
    with pytest.raises(ValueError):
        compare.reversal_summary(df, 0)


def test_runs_of_other_members_are_an_error(spark):
    same = pairs(spark, [12, 10, 8], [9, 11, 10])
    assert compare.with_same_members(same).count() == 6
    with pytest.raises(Exception, match="members differ between baseline and other"):
        compare.with_same_members(same.where("not (model = 'other' and email = 's2')")).collect()
    assert {(x.email, x.only_in) for x in compare.mismatched_members(same.where("model = 'baseline'"), same.where("model = 'other' and email <> 's2'")).collect()} == {("s2", "first")}


def test_members_and_checks(spark):
    own_only = [[5, 3, X], [4, 6, X], [4, 3, 7]]  # s2 scored only the own self
    r = table(spark, own_only, F2, [[X, 1], [X, 1]])
    flags = lambda df: {(x.team, x.giver) for x in df.collect()}
    assert flags(members.missing_in_file(r)) == {("t1", "s3"), ("t2", "s0")}
    assert flags(members.without_peer_scores(r)) == {("t0", "s2"), ("t1", "s3"), ("t2", "s0")}
    assert flags(members.without_scores(r)) == {("t1", "s3"), ("t2", "s0")}
    assert len(flags(members.active_raters(r))) == 7
    assert {x.team for x in members.excluded_teams(r).collect()} == {"t2"}
    assert {x.team for x in members.kept(r).select("team").distinct().collect()} == {"t0", "t1"}
    assert members.shape_errors(r).count() == 0
    off = {x.student_email for x in members.point_total_mismatch(members.kept(r)).where("team = 't0'").collect()}
    assert off == {"s2"}  # they gave 13, 12 and 7 points, the median is 12
    events = {x.event: x.n for x in report.event_counts(members.diagnostics(r)).collect()}
    assert events["team_excluded"] == 1 and events["rater_missing"] == 2


def test_report_and_tables(spark):
    r = table(spark, F1, F2, F5)
    parts = report.report(r)
    t = parts["totals"].first()
    assert (t.files, t.matrices, t.runs, t.failed) == (1, 3, 18, 0)
    assert {x.model for x in parts["convergence"].collect()} == {"peerrank-impute", "peerrank-exclude", "peerhits-impute", "peerhits-exclude"}
    assert parts["sizes"].first().max_size == 4
    s = models.score(r)
    wide = compare.side_by_side(s).where("team = 't0' and email = 's1'").first()
    assert wide.baseline == 13 and wide.max_delta >= 3
    assert compare.cross_model_delta(s).count() == 3
    assert compare.results(s, r).columns == ["csv_path", "session", "team", "question", "email", "model", "iwf", "converged", "iterations", "final_l1"]


def test_own_model_can_be_registered(spark):
    models.register_model("tenth", lambda r, k=KEYS: models.baseline(r, k).withColumn("iwf", models.F.lit(10.0)))
    assert set(iwf(models.score(table(spark, F1), ("tenth", "baseline")), "tenth")) == {10.0}
    del models.MODELS["tenth"]
