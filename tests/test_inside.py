import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingscope.operators import compare, fingerprint, inside, members, models, perturb
from ratingscope.plans import registry
from ratingscope.schema import KEYS
from ratingscope.shared import written
from ratingscope.sources.ratings_view import ratings, teams

SF = "/root/testdata/sf0.001"


def _rows(df, digits=7):
    cell = lambda x: round(x, digits) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(cell(x) for x in r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def odd(spark):
    """Some teams of the view, one with a missing row, one with only zeros, one of a single member, and one too large for a matrix."""
    r = ratings(spark, SF).select(*KEYS, "giver", "recipient", "score").where("team < '2'")
    first = r.agg(F.min(F.struct("team", "giver", "recipient"))).first()[0]
    r = r.where((F.col("team") != first.team) | (F.col("giver") != first.giver) | (F.col("recipient") != first.recipient))
    more = [("x", "zeros", "q", a, b, 0.0) for a in "abc" for b in "abc"] + [("x", "one", "q", "a", "a", 3.0)]
    rng = np.random.default_rng(1)
    more += [("x", "large", "q", f"m{i:03}", f"m{j:03}", float(rng.integers(20)) if i % 9 else None) for i in range(70) for j in range(70)]
    return written(r.unionByName(spark.createDataFrame(more, r.schema)), "odd")


def test_view_as_packed_teams(spark):
    for share in (None, 0.5):
        long = ratings(spark, SF, share)
        assert _rows(models.unpacked(teams(spark, SF, share))) == _rows(long.select(*KEYS, "giver", "recipient", "score"))
    assert _rows(ratings(spark, SF, 0.5)) == _rows(members.kept(ratings(spark, SF)))


def test_teams_travel_to_their_keys_as_one_row(spark):
    """The ratings themselves aren't shuffled by what follows by team."""
    plan = models.pack(ratings(spark, SF, 0.5))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(csv_path" in plan and plan.count("Exchange hashpartitioning(csv_path") == 1


def test_inside_as_over_the_table(odd):
    iwf = written(models.score(odd), "iwf")
    pairs = [
        (inside.cross_model_delta(odd), compare.cross_model_delta(iwf)),
        (inside.pair_delta(odd), compare.pair_delta(iwf)),
        (inside.run_status(odd), models.run_status(iwf)),
        (inside.convergence(odd), models.convergence(iwf)),
        (inside.reversal_summary(odd), compare.reversal_summary(iwf)),
        (inside.side_by_side(odd), compare.side_by_side(iwf)),
    ]
    for got, want in pairs:
        assert got.columns == want.columns and _rows(got) == _rows(want)
    plan = inside.pair_delta(models.pack(odd))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_features_and_failures_of_packed_teams(odd):
    packed = written(models.pack(odd), "packed")
    assert _rows(fingerprint.features(packed)) == _rows(fingerprint.features(odd))
    assert _rows(perturb.failures(packed)) == _rows(perturb.failures(odd))


def test_summaries_made_in_tasks(odd):
    small = written(models.pack(odd.where("team <> 'large'")), "packed")
    runs = perturb.runs(small, 3)
    assert _rows(perturb.team_summaries(small, 3).select("team", *(c.split()[0] for c in perturb.SUMMARY))) == _rows(perturb.summaries(runs).select("team", *(c.split()[0] for c in perturb.SUMMARY)))


def test_rounding_is_that_of_the_twins(spark):
    x = [1.0111175, 2.0239795, 0.3402345, -1.0111175, 1e-7, 5e-7, 0.0, None]
    want = [r[0] for v in x for r in [duckdb.execute("SELECT round(round(?::DOUBLE, 9), 6) + 0.0", [v]).fetchone()]]
    got = registry._distances(spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, x double"), "x").orderBy("k")
    assert [r.x for r in got.collect()] == want


def test_session_results_in_order(spark):
    """Rows come sorted, each team solved once: the plan sorts teams, not scores."""
    packed = written(teams(spark, SF, 0.5), "teams")
    got, want = inside.results(packed), compare.results(models.score(ratings(spark, SF, 0.5)), ratings(spark, SF, 0.5))
    assert got.columns == want.columns
    line = lambda r: (*r[:-1], r[-1] and round(r[-1], 12))
    assert [line(r) for r in got.collect()] == [line(r) for r in want.collect()]


def test_lines_without_quotes_are_split(spark):
    from ratingscope.sources import sessions

    lines = ["Course,COURSE-S1-2020", "Session Name,Peer Feedback Session 1 - S1, 2020", 'Question 1,"Distribute a total of 60 points: q"', "Team,Giver's Name,Email,Role,Recipient,Recipient Email,Points"]
    body = ["t,A,a,,B,b,3", 't,"A, x",a,,A,a,4', "t,B,b,,A,a,No Response", "t,B,b,,B,b,", "t,C,c,,A,a", "t,C,c,,A", ",D,d,,A,a,1", " t , A , a ,, C , c , 5 ,z"]
    df = spark.createDataFrame([("f", k, x) for k, x in enumerate(lines + body)], "csv_path string, pos long, line string")
    quoted = spark.createDataFrame([("f", k, x if k < 4 or '"' in x else '"' + x.split(",")[0] + '"' + x[x.index(","):]) for k, x in enumerate(lines + body)], df.schema)
    plain, other = (_rows(sessions.parse(d)["rows"].drop("pos")) for d in (df, quoted))
    assert plain == other and len(plain) >= 5
