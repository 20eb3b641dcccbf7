import numpy as np
import pytest

from ratingscope.functions import stats
from ratingscope.operators import archetypes, atypical, compare, fingerprint, models, perturb
from ratingscope.schema import KEYS
from tests.test_models import F13, X, iwf, table

F14 = [[10, 10, 7, 9, 8, 10], [10, 10, 10, 10, 10, 11], [10, 11, 13, 11, 13, 12], [10, 5, 6, 9, 7, 4], [10, 10, 11, 9, 9, 11], [10, 14, 13, 12, 13, 12]]


def matrix(df, team="t0"):
    rows = df.where(f"team = '{team}'").collect()
    n = len({r.recipient for r in rows})
    out = np.full((n, n), np.nan)
    for r in rows:
        if r.score is not None:
            out[int(r.recipient[1:]), int(r.giver[1:])] = r.score
    return out


def test_perturbations(spark):
    r = table(spark, F14)
    m = np.array(F14, float)
    even = matrix(perturb.uniform_inflation(r))
    assert np.nansum(even, axis=0) == pytest.approx(m.sum(axis=0)) and np.isnan(np.diag(even)).all()
    full = matrix(perturb.zero_self(r))
    assert full == pytest.approx(m * 6 / 5)
    part = matrix(perturb.zero_self(r, colluders=2))
    assert part[:, :2] == pytest.approx(m[:, :2] * 6 / 5) and part[:, 2:] == pytest.approx(m[:, 2:])
    assert matrix(perturb.zero_self(r, self_share=0.5)) == pytest.approx(m * 2)
    down = matrix(perturb.targeted_downvote(r))
    assert down.sum(axis=0) == pytest.approx(m.sum(axis=0)) and down[:, 0] == pytest.approx(m[:, 0]) and (down[0, 1:] == 0).all()
    assert iwf(models.score(perturb.targeted_downvote(r), ("baseline",)), "baseline")[0] == 0
    out = matrix(perturb.single_outlier(r, seed=3))
    j = int(np.flatnonzero(np.isnan(np.diag(out)))[0])
    assert sorted(np.delete(out[:, j], j)) == sorted(np.delete(m[:, j], j)) and np.delete(out, j, 1) == pytest.approx(np.delete(m, j, 1))
    assert (matrix(perturb.single_outlier(r, seed=3)) == out).sum() == 35
    best = matrix(perturb.sabotage_of_the_best(r))
    top = int(np.argmax([np.delete(m[i], i).mean() for i in range(6)]))
    assert np.delete(best[top], top) == pytest.approx(np.zeros(5))
    assert np.isnan(matrix(perturb.strategic_silence(r))[:, 0]).all()
    assert matrix(perturb.fixed_budget(r, 30.0)).sum(axis=0) == pytest.approx([30] * 6)


def test_deltas(spark):
    r = table(spark, F14, F13)
    keys = [*KEYS, "variant", "perm"]
    s = models.score(perturb.variants(r, n_perms=4), ("baseline", "peerrank-exclude"), keys).persist()
    d = perturb.deltas(s)
    rows = {(x.team, x.variant, x.model): x.delta for x in d.where("perm = 0").collect()}
    assert rows["t0", "zero_self_full", "peerrank-exclude"] == pytest.approx(0, abs=1e-6)
    assert rows["t0", "zero_self_full", "baseline"] == pytest.approx(np.mean([np.delete(np.array(F14[i], float), i).mean() for i in range(6)]) / 5)
    mc = {(x.team, x.model): x for x in perturb.permutation_robustness(d).collect()}
    assert mc["t0", "baseline"].n_perms == 4 and mc["t0", "baseline"].mean_iterations is None and mc["t0", "peerrank-exclude"].converged_all
    wide = perturb.robustness_matrix(perturb.attack_summary(d), ("baseline", "peerrank-exclude")).collect()
    assert [x.variant for x in wide] == ["single_outlier", "targeted_downvote", "uniform_inflation", "zero_self_full", "zero_self_partial"]


def as_received(a):
    """Matrices in the feature tests have givers on rows."""
    return [list(x) for x in zip(*a)]


def test_features(spark):
    J = [
        [[X, 10, 15], [10, X, 8], [15, 8, X]],  # symmetric
        [[X, 12, 12], [12, X, 12], [12, 12, X]],
        [[X, 0, 20], [X, X, X], [X, X, X]],
        [[12, 6, 6], [6, 18, 6], [6, 6, 6]],
        [[X] * 4, [10, X, 10, 10], [10, 10, X, 10], [10, 10, 10, X]],
        [[X, 5], [5, X]],
    ]
    f = {x.team: x for x in fingerprint.features(table(spark, *map(as_received, J))).collect()}
    assert f["t0"].reciprocity == pytest.approx(1) and f["t0"].asymmetry == 0
    assert f["t1"].reciprocity == 0 and f["t1"].clustering == pytest.approx(1) and f["t1"].triad_003 == 1
    assert f["t2"].mean_rater_std == pytest.approx(10) and f["t2"].std_rater_std == 0
    assert f["t3"].mean_self_share == pytest.approx(0.2)
    assert f["t4"].non_submitter_frac == 0.25 and f["t4"].non_submitter_count == 1 and f["t4"].mean_rater_std == 0
    assert f["t5"].triad_003 == 0 and f["t5"].clustering == 0
    causes = {x.team: x.cause for x in atypical.degenerate(fingerprint.features(table(spark, *map(as_received, J)))).collect()}
    assert causes["t1"] == "flat" and causes["t4"] == "both" and causes["t0"] == "none" and causes["t2"] == "non_submitter"


def test_gini(spark):
    rows = [("f", "t", "q", f"g{k}", f"r{k}", float(v)) for k, v in enumerate([2, 4, 6, 8])]
    df = spark.createDataFrame(rows, "csv_path string, team string, question string, giver string, recipient string, score double")
    assert fingerprint.gini(df).first().gini_in_degree == pytest.approx(0.25)


def triad_of(arcs):
    """The class of a triple by brute force over all ways to name its members."""
    kinds = {
        "003": [], "012": [(0, 1)], "102": [(0, 1), (1, 0)], "021D": [(1, 0), (1, 2)], "021U": [(0, 1), (2, 1)], "021C": [(0, 1), (1, 2)],
        "111D": [(0, 1), (1, 0), (2, 1)], "111U": [(0, 1), (1, 0), (1, 2)], "030T": [(0, 1), (2, 1), (0, 2)], "030C": [(1, 0), (2, 1), (0, 2)],
        "201": [(0, 1), (1, 0), (1, 2), (2, 1)], "120D": [(1, 0), (1, 2), (0, 2), (2, 0)], "120U": [(0, 1), (2, 1), (0, 2), (2, 0)], "120C": [(0, 1), (1, 2), (0, 2), (2, 0)],
        "210": [(0, 1), (1, 2), (2, 1), (0, 2), (2, 0)], "300": [(0, 1), (1, 0), (1, 2), (2, 1), (0, 2), (2, 0)],
    }
    from itertools import permutations

    for name, want in kinds.items():
        for p in permutations(range(3)):
            if {(p[a], p[b]) for a, b in want} == set(arcs):
                return name


def test_all_64_triples(spark):
    pairs = [("a", "b"), ("a", "c"), ("b", "c")]
    rows = []
    for code in range(64):
        rows.append((code, *(bool(code >> k & 1) for k in range(6))))
    df = spark.createDataFrame(rows, "code int, up_ab boolean, down_ab boolean, up_ac boolean, down_ac boolean, up_bc boolean, down_bc boolean")
    n = {"a": 0, "b": 1, "c": 2}
    for r in df.withColumn("class", fingerprint.triad_class()).collect():
        arcs = []
        for k, (x, y) in enumerate(pairs):
            arcs += [(n[x], n[y])] * (r.code >> 2 * k & 1) + [(n[y], n[x])] * (r.code >> 2 * k + 1 & 1)
        assert r["class"] == triad_of(arcs), (r.code, r["class"], triad_of(arcs))


def test_prototypes_and_atypicality(spark):
    p = atypical.prototype_features(spark)
    assert set(p) == set(atypical.LABELS)
    r = np.random.default_rng(1)
    teams = [r.integers(0, 20, (5, 5)).tolist() for _ in range(30)]
    both = table(spark, *teams).unionByName(atypical.prototype_ratings(spark))
    f = atypical.degenerate(atypical.imputed(fingerprint.features(both))).persist()
    scale = atypical.fit_scale(f)
    z = atypical.standardised(f, scale).persist()
    x = np.array([[row[n] for n in scale.names] for row in z.collect()])
    assert x.mean(axis=0) == pytest.approx(np.zeros(x.shape[1]), abs=1e-9) and x.std(axis=0) == pytest.approx(np.ones(x.shape[1]))
    rows = {(row.team, row.feature): row.z for row in atypical.standardised_long(z, scale).collect()}
    assert rows == {(row.team, n): row[n] for row in z.collect() for n in scale.names}
    # the shrunk covariance by its definition
    s, n = np.cov(x.T, bias=True), len(x)
    mu = np.trace(s) / len(s)
    delta = ((s - mu * np.eye(len(s))) ** 2).sum() / len(s)
    beta = min(sum(((np.outer(v, v) - s) ** 2).sum() for v in x) / n**2 / len(s), delta)
    assert atypical.fit_precision(z, scale) == pytest.approx(np.linalg.inv((1 - beta / delta) * s + beta / delta * mu * np.eye(len(s))), rel=1e-6, abs=1e-9)
    got = {row.team: row for row in atypical.nearest_prototype(z, scale, p).collect()}
    assert all(got[k].label == k for k in atypical.LABELS)
    assert sum(got["t0"][c] for c in got["t0"].asDict() if c.startswith("weight_")) == pytest.approx(1)
    scored = atypical.atypicality(z, scale)
    assert {row.flag for row in scored.collect()} <= {"Typical", "Anomalous"}
    deltas = compare.cross_model_delta(models.score(both, ("baseline", "webpa")))
    assert [row["count"] is not None for row in atypical.delta_by_label(atypical.nearest_prototype(z, scale, p), deltas).collect()] == [True] * 5
    corr = {row.subset: row for row in atypical.delta_correlation(scored, deltas).collect()}
    dist = {row.team: row.distance for row in scored.collect()}
    d = {row.team: row.delta for row in deltas.collect()}
    assert corr["full"].r == pytest.approx(np.corrcoef([dist[t] for t in dist], [d[t] for t in dist])[0, 1]) and 0 <= corr["full"].p <= 1


def test_tails_against_tables():
    assert stats.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert stats.t_two_sided(0, 5) == pytest.approx(1)
    assert stats.chi2_quantile(0.95, 10) == pytest.approx(18.307038, abs=1e-6)
    assert stats.chi2_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-6)


def test_archetypes(spark):
    r = np.random.default_rng(0)
    corners = np.array([[0, 0], [10, 0], [0, 10]], float)
    w = r.dirichlet([0.5] * 3, 120)
    x = np.vstack([corners, w @ corners])
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], "id long, f double, g double").repartition(4)
    z, rows, rss = archetypes.fit(df, ["f", "g"], 3, max_iter=25)
    got = rows.collect()
    assert all(sum(row.w) == pytest.approx(1) and min(row.w) >= 0 for row in got)
    assert rss == pytest.approx(sum(((np.array(row.x) - np.array(row.w) @ z) ** 2).sum() for row in got), rel=1e-6)
    _, _, one = archetypes.fit(df, ["f", "g"], 1, max_iter=10)
    assert rss < 0.2 * one
    s = archetypes.stability(df, ["f", "g"], z, n_bootstrap=4, max_iter=40)
    assert 0 <= s <= 1
    fits = spark.createDataFrame([(2, 100.0), (3, 20.0), (4, 15.0), (5, 12.0)], "k int, rss double")
    assert archetypes.elbow(fits).first().elbow == 3


def test_archetypes_in_one_task_as_in_steps(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 2))
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], "id long, f double, g double")
    z, rows, rss = archetypes.fit_best(df, ["f", "g"], 3, max_iter=6, restarts=2)
    far, many, same = archetypes.fit_best(df, ["f", "g"], 3, max_iter=6, restarts=2, most_cells=0)
    assert rss == pytest.approx(same) and z == pytest.approx(far)
    w = {a.id: a.w for a in many.collect()}
    assert all(a.w == pytest.approx(w[a.id]) for a in rows.collect()) and len(w) == 60
    assert archetypes.fit_best(df, ["f", "g"], 3)[2] < archetypes.fit(df, ["f", "g"], 3, max_iter=8)[2]
    stable = [archetypes.stability(df, ["f", "g"], z, n_bootstrap=2, max_iter=4, most_cells=n) for n in (0, 10**6)]
    assert stable[0] == pytest.approx(stable[1])


def test_queries_take_the_whole_job(monkeypatch):
    from ratingscope.plans import registry

    seen = {}

    def stop(*args, **more):
        seen.update(more)
        raise StopIteration

    scale = type("S", (), {"names": []})
    monkeypatch.setattr(registry.perturb, "runs", lambda r, n, names: stop(n_perms=n))
    monkeypatch.setattr(registry.archetypes, "fit_best", stop)
    monkeypatch.setattr(registry, "written", lambda df, name: df)
    monkeypatch.setattr(registry, "_scaled", lambda r: (None, type("Z", (), {"select": lambda self, *c: None})(), scale))
    for query in (registry.robustness_matrix, registry.archetype_weights):
        with pytest.raises(StopIteration):
            query(type("R", (), {"select": lambda self, *c: self})())
    assert seen["n_perms"] == 100 and seen["max_iter"] == 400 and seen["restarts"] == 5
    assert "archetype_sweep" in registry.QUERIES


def test_failing_teams_and_differing_members(spark):
    few = [[5, X, X], [6, X, X], [4, X, X]]  # one active rater
    none = [[X, X], [X, X]]
    r = table(spark, F14, few, none)
    got = {(x.team, x.variant): x.error for x in perturb.failures(r).collect()}
    one, two = "no active rater", "fewer than two active raters"
    assert got == {("t1", "zero_self_full"): two, ("t1", "zero_self_partial"): two, ("t2", "zero_self_full"): two, ("t2", "zero_self_partial"): two, ("t2", "targeted_downvote"): one, ("t2", "single_outlier"): one}
    variants = perturb.variants(r.where("team = 't0'"))
    fewer = variants.where("not (variant = 'uniform_inflation' and (giver = 's5' or recipient = 's5'))")
    d = {x.variant: x for x in perturb.deltas(models.score(fewer, ("baseline",), [*KEYS, "variant", "perm"])).collect()}
    assert d["uniform_inflation"].error == "members differ" and d["uniform_inflation"].delta is None
    assert d["zero_self_full"].error is None and d["zero_self_full"].delta > 0


def test_no_shared_folder_is_an_error(monkeypatch):
    from ratingscope import shared

    class Session:
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session)


def random_teams(seed=3, sizes=(2, 3, 4, 5, 6, 7, 9), holes=0.2):
    r = np.random.default_rng(seed)
    out = []
    for n in sizes:
        m = r.integers(0, 20, (n, n)).astype(object)
        m[r.random((n, n)) < holes] = X
        if n > 3:
            m[:, n - 1] = X
        out.append(m.tolist())
    return [*out, [[X, X], [X, X]], [[5]], [[10] * 4] * 4, [[0, 0, 0]] * 3]


def same_numbers(a, b, names, by=("team",)):
    a, b = ({tuple(x[k] for k in by): x for x in df.collect()} for df in (a, b))
    assert a.keys() == b.keys()
    for k in a:
        for n in names:
            assert (a[k][n] is None) == (b[k][n] is None) and (a[k][n] is None or a[k][n] == pytest.approx(b[k][n], abs=1e-9)), (k, n, a[k][n], b[k][n])


def test_packed_features_equal_joins(spark):
    r = table(spark, *random_teams())
    same_numbers(fingerprint.features(r), fingerprint.features(r, most=0), ["n_students", "non_submitter_count", *fingerprint.FEATURES])
    same_numbers(fingerprint.triple_features(r), fingerprint.triple_features(r, most=0), ["clustering", *(f"triad_{t}" for t in fingerprint.TRIADS)])


def test_census_by_brute_force():
    from ratingscope.operators import team_kernel

    r = np.random.default_rng(2)
    for density in (0.15, 0.5, 0.8):
        arcs = r.random((3, 8, 8)) < density
        arcs[:, np.arange(8), np.arange(8)] = False
        got = team_kernel.census(arcs)
        for k in range(3):
            seen = dict.fromkeys(fingerprint.TRIADS, 0)
            for a in range(8):
                for b in range(a):
                    for c in range(b):
                        seen[triad_of([(p, q) for p, x in enumerate((a, b, c)) for q, y in enumerate((a, b, c)) if p != q and arcs[k, x, y]])] += 1
            assert {t: got[t][k] * 56 for t in seen} == pytest.approx(seen)


def test_a_sparse_team_of_5000(spark):
    """A ring: everyone rates the next one above the mean, and the one after below it. Its triples, some 20 billion, are counted."""
    n = 5000
    rows = [("t0", f"m{g:04}", f"m{(g + d) % n:04}", s) for g in range(n) for d, s in ((0, None), (1, 20.0), (2, 1.0))]
    some = spark.createDataFrame(rows, "team string, giver string, recipient string, score double").selectExpr("'f' csv_path", "team", "'q' question", "giver", "recipient", "score")
    x = fingerprint.features(some).first()
    total = n * (n - 1) * (n - 2) / 6
    assert x.triad_021C * total == pytest.approx(n) and x.triad_012 * total == pytest.approx(n * (n - 4)) and x.triad_003 == pytest.approx(1 - (n + n * (n - 4)) / total)
    # a member is in three triangles of ties 1, 1 and a twentieth, and has four arcs
    assert x.clustering == pytest.approx(3 * np.cbrt(0.05) / 12)


def test_packed_runs_equal_tables(spark):
    """Perturbed, scored and compared in packed teams as by transforms of tables, all models, errors and all."""
    few = [[5, X, X], [6, X, X], [4, X, X]]
    r = table(spark, *random_teams(), few, F14, F13)
    columns = ["delta", "error", "iterations", "converged"]
    by = ("team", "variant", "perm", "model")
    packed = perturb.runs(r, 3)
    plain = perturb.deltas(models.score(perturb.variants(r, 3), keys=[*KEYS, "variant", "perm"]).persist())
    a, b = ({tuple(x[k] for k in by): x for x in df.collect()} for df in (packed, plain))
    assert a.keys() == b.keys() and len(a) > 300
    for k in a:
        for c in columns:
            if isinstance(b[k][c], float):
                assert a[k][c] == pytest.approx(b[k][c], abs=1e-8), (k, c)
            else:
                assert a[k][c] == b[k][c], (k, c, a[k][c], b[k][c])


def test_own_perturbations_and_large_teams_take_tables(spark):
    r = table(spark, F14, F13)
    perturb.register_perturbation("halved", lambda df, k=KEYS: df.withColumn("score", df.score / 2))
    try:
        got = {(x.team, x.variant, x.model): x.delta for x in perturb.runs(r, 0, ("baseline",)).collect()}
    finally:
        del perturb.PERTURBATIONS["halved"]
    assert got["t0", "halved", "baseline"] == pytest.approx(np.mean([np.delete(np.array(F14[i], float), i).mean() for i in range(6)]) / 2)
    assert {v for _, v, _ in got} == {"halved", *perturb.BUILT_IN}
    large = {(x.team, x.variant, x.model): x.delta for x in perturb.runs(r, 1, ("baseline",), most=5).collect()}
    assert large["t0", "zero_self_full", "baseline"] == pytest.approx(got["t0", "zero_self_full", "baseline"]) and ("t0", "single_outlier", "baseline") in large


def test_assignment_is_the_cheapest():
    from itertools import permutations

    r = np.random.default_rng(8)
    for n in range(1, 8):
        for m in (n, n + 1):
            for cost in (r.random((n, m)), r.integers(0, 3, (n, m)).astype(float), -r.random((n, m))):
                got = archetypes.assignment(cost)
                assert len(set(got.tolist())) == n
                best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in permutations(range(m), n)) if n < 7 or m == n else None
                assert best is None or cost[np.arange(n), got].sum() == pytest.approx(best)
    order = r.permutation(30)
    a = r.normal(size=(30, 4))
    assert archetypes.matched_distance(a, a[order]) == pytest.approx(0, abs=1e-9)


def test_percent_ranks_without_one_task(spark):
    r = np.random.default_rng(5)
    rows = [("f", f"t{k}", "q", float(r.integers(0, 40)), None if k % 50 == 3 else float(r.integers(0, 3))) for k in range(500)]
    df = spark.createDataFrame(rows, "csv_path string, team string, question string, a double, b double")
    from pyspark.sql import Window, functions as F

    want = {x.team: x for x in df.select("team", *(F.percent_rank().over(Window.orderBy(c)).alias(c) for c in "ab")).collect()}
    got = {x.team: x for x in fingerprint.percent_ranks(df, ("a", "b"), parts=7).collect()}
    assert len(got) == 500 and all(got[t].a == pytest.approx(want[t].a) and got[t].b == pytest.approx(want[t].b) for t in want)
    assert fingerprint.percent_ranks(df.limit(1), ("a",)).first().a == 0 and fingerprint.percent_ranks(df.limit(0), ("a",)).count() == 0


def test_named_colluders_and_teams(spark):
    from ratingscope.operators import members

    r = table(spark, F14, F13)
    m = np.array(F14, float)
    some = matrix(perturb.zero_self(r, colluders=["s1", "s4", "nobody"]))
    assert some[:, [1, 4]] == pytest.approx(m[:, [1, 4]] * 6 / 5) and np.delete(some, [1, 4], 1) == pytest.approx(np.delete(m, [1, 4], 1))
    assert perturb.zero_self(r, colluders=["s1"]).count() == 0
    assert {x.team for x in members.of_teams(r, ["t1"]).collect()} == {"t1"}
    with pytest.raises(ValueError, match="unknown teams: t9"):
        members.of_teams(r, ["t1", "t9"])


def test_archetypes_of_large_tables_step_together(spark):
    """Few jobs, whatever the number of steps, starts and replicates; results as those of single tasks."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, *map(float, rng.normal(size=3))) for k in range(90)], "id int, f double, g double, h double")
    names = ["f", "g", "h"]
    small = {r.k: r for r in archetypes.sweep(df.drop("id"), names, range(2, 4), 4, 2, 2).collect()}
    seen = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("together"))
    spark.sparkContext.setJobGroup("together", "together")
    large = {r.k: r for r in archetypes.sweep(df.drop("id"), names, range(2, 4), 4, 2, 2, most_cells=0).collect()}
    assert seen() < 60
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for k, r in small.items():
        assert large[k].rss == pytest.approx(r.rss, abs=1e-6) and np.allclose(large[k].archetypes, r.archetypes, atol=1e-6) and 0 <= large[k].stability <= 1
    one, many = (archetypes.fit_best(df, names, 3, 4, 2, most_cells=n)[1] for n in (10**6, 0))
    weights = lambda rows: np.array([r.w for r in rows.orderBy("id").collect()])
    assert np.allclose(weights(one), weights(many), atol=1e-6)
