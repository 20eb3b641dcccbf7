import numpy as np
import pytest

from ratingscope.operators import models, sparse
from tests.test_models import F1, F2, F5, F9, F12, F13, X, table
from tests.test_perturb_and_features import F14, random_teams, same_numbers

NUMBERS = ["iwf", "hub", "converged", "iterations", "final_l1"]
BY = ("team", "email", "model")
TEAMS = [F1, F2, F5, F9, F12, F13, F14, [[5, 0], [0, 5]], [[0, X], [5, X]], [[X] * 3] * 3, *random_teams(7)]


def errors(df):
    return {(r.team, r.email, r.model): r.error for r in df.collect()}


def test_sums_over_arcs_equal_matrices(spark):
    r = table(spark, *TEAMS)
    packed, plain = (models.iterative(r, models.STACKED, most=n).persist() for n in (64, 0))
    same_numbers(packed, plain, NUMBERS, BY)
    assert errors(packed) == errors(plain)
    both = models.score(r, (*models.NAMES, "peerrank", "peerhits"), most=3).persist()  # some teams packed, some not
    same_numbers(both, models.score(r, (*models.NAMES, "peerrank", "peerhits")), NUMBERS, BY)


@pytest.mark.parametrize("model", ["peerrank-impute", "peerrank-exclude", "peerhits-impute", "peerhits-exclude"])
def test_joins_equal_sums_over_arcs(spark, model):
    """Fewer steps, the same ones: every value to 1e-9 after three of them."""
    r = table(spark, F1, F2, F9, F13, [[5, 0], [0, 5]], [[0, X], [5, X]], [[X] * 3] * 3)
    got = {(x.team, x.email): x for x in sparse.joined(r, model, epsilon=1e-12, most=3, every=2).collect()}
    people, peer = sparse.arcs(r)
    arcs, names = {}, {}
    for x in peer.collect():
        arcs.setdefault(x.team, []).append((x.r, x.g, x.s))
    for x in people.orderBy("idx").collect():
        names.setdefault(x.team, []).append(x.email)
    assert len(got) == sum(map(len, names.values()))
    for team, members in names.items():
        a = np.array(arcs.get(team, [])).reshape(-1, 3)
        iwf, hub, _, rounds, l1, fail = sparse.solve(len(members), a[:, 0].astype(int), a[:, 1].astype(int), a[:, 2], model, epsilon=1e-12, most=3)
        for k, email in enumerate(members):
            x = got[team, email]
            assert (x.error is not None) == (fail >= 0) and (x.iterations or 0) == rounds, (team, email, x, rounds)
            for value, want in ((x.iwf, iwf[k]), (x.hub, hub[k]), (x.final_l1, l1 if rounds else np.nan)):
                assert value is None if np.isnan(want) else value == pytest.approx(want, abs=1e-9), (team, email)


def test_a_team_of_20000(spark):
    """Everyone rates the next five; every tenth rates nobody. As rows of cells this team would have 400 million."""
    n = 20_000
    df = spark.range(n).selectExpr("id AS g", "explode(sequence(0, 5)) AS d").selectExpr(
        "'f' AS csv_path", "'big' AS team", "'q' AS question", "format_string('m%05d', g) AS giver", f"format_string('m%05d', (g + d) % {n}) AS recipient", "CASE WHEN g % 10 = 9 OR d = 0 THEN NULL ELSE CAST(1 + (g * 7 + d) % 5 AS double) END AS score"
    )
    got = models.score(df, models.NAMES).groupBy("model").agg({"iwf": "avg", "email": "count", "converged": "min", "error": "max"}).collect()
    assert {r.model for r in got} == set(models.NAMES) and all(r["count(email)"] == n and r["max(error)"] is None for r in got)
    mean = {r.model: r["avg(iwf)"] for r in got}
    assert all(mean[m] == pytest.approx(10) for m in models.NAMES if m != "baseline")


def test_models_of_a_matrix(spark):
    def mine(matrix, emails):
        if len(emails) == 2:
            raise RuntimeError("two are too few")
        if len(emails) == 4:
            return np.ones(3)
        return {"iwf": np.nansum(matrix, axis=1), "converged": True, "iterations": 3, "final_l1": 0.5}

    models.register_matrix_model("mine", mine)
    try:
        r = table(spark, F1, [[1, 2], [3, 4]], F2).unionByName(table(spark, F5).selectExpr("csv_path", "year", "semester", "session_number", "'ragged' AS team", "question", "giver", "recipient", "score").where("not (giver = 's0' and recipient = 's1')"))
        got = models.score(r, ("mine", "baseline")).persist()
        rows = {(x.team, x.email): x for x in got.where("model = 'mine'").collect()}
        assert [rows["t0", f"s{k}"].iwf for k in range(3)] == [24, 36, 34] and rows["t0", "s0"].iterations == 3 and rows["t0", "s0"].error is None
        assert {rows["t1", e].error for e in ("s0", "s1")} == {"RuntimeError: two are too few"} and rows["t1", "s0"].iwf is None
        assert rows["t2", "s0"].error == "ValueError: iwf of 3 scores for 4 members"
        assert rows["ragged", "s1"].iwf == 6
        assert got.where("model = 'baseline'").count() == 12 and models.run_status(got).where("error is not null").count() == 2
    finally:
        del models.MATRIX_MODELS["mine"]
