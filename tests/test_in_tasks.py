"""Teams that are made in the tasks that ask of them, features and deltas in one pass, ranks, medians and distances that no task holds whole."""

from __future__ import annotations

import statistics

import numpy as np
import pyarrow as pa
import pytest

from ratingscope.operators import atypical, compare, fingerprint, inside, models
from ratingscope.plans import registry
from ratingscope.schema import KEYS
from ratingscope.sources import view_kernel

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.fixture(scope="module")
def odd(spark):
    """Teams of one to five members, one of 70 and one with a pair missing."""
    rows = []
    for t, n in (("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5), ("large", 70), ("holes", 4)):
        for g in range(n):
            for r in range(n):
                if (t, g, r) != ("holes", 1, 2):
                    rows.append(("f", t, "q", f"m{g:02}", f"m{r:02}", None if g == 1 and n > 3 else float((3 * g * g + 5 * r * g + r) % 11)))
    return spark.createDataFrame(rows, "csv_path string, team string, question string, giver string, recipient string, score double").cache()


def _to_be(ratings) -> models.Teams:
    packed = models.pack(ratings)
    return models.Teams(packed, lambda batches: batches, packed.schema.simpleString()[len("struct<") : -1].replace("<", "\0").replace(":", " ").replace("\0", "<"))


def test_orders_that_go_over_batches(monkeypatch):
    monkeypatch.setattr(view_kernel, "ROWS", 5)
    rows = [(1, 7, True), (1, 8, True), (1, None, False), (2, None, False), (3, 5, True), (4, 1, True), (4, None, False), (4, None, False)]
    rows += [(5, s, True) for s in range(40)] + [(5, None, False), (6, 2, True), (6, None, False)]
    table = pa.table({"k": [r[0] for r in rows], "o_orderpriority": [f"p{k}" if not r[2] else None for k, r in enumerate(rows)], "y": pa.array([None] * len(rows), pa.int32()), "s": pa.array([r[1] for r in rows], pa.int64()), "q": pa.array([1.0 if r[2] else None for r in rows]), "f": pa.array([0] * len(rows), pa.int8()), "line": [r[2] for r in rows]})
    got = [(k, p, [x["s"] for x in lines]) for b in view_kernel.orders(iter(table.to_batches(max_chunksize=3))) for k, p, lines in zip(*(b.column(c).to_pylist() for c in ("l_orderkey", "o_orderpriority", "lines")))]
    assert got == [(1, "p2", [7, 8]), (4, "p6", [1]), (4, "p7", [1]), (5, "p48", list(range(40))), (6, "p50", [2])]


@pytest.mark.parametrize("name", ["iwf_side_by_side", "rank_reversal_aggregate", "cross_model_delta"])
def test_teams_are_made_and_solved_in_one_step(spark, name):
    plan = _plan(registry.QUERIES[name](spark, SF))
    assert plan.count("MapInArrow") == 1 and "collect_list" not in plan


def test_features_and_delta_in_one_pass(odd):
    want = fingerprint.features(odd).join(compare.cross_model_delta(models.score(odd)), KEYS)
    got = fingerprint.feature_table(_to_be(odd), delta=True)
    assert got.columns == want.columns and got.count() == 7
    assert _rows(got) == _rows(want)
    some = fingerprint.feature_table(_to_be(odd), ("reciprocity", "clustering"))
    assert _rows(some) == _rows(want.select(some.columns))


def test_medians_without_a_task_for_a_label(spark):
    rng = np.random.default_rng(2)
    rows = [(label, None if k == 3 else float(v)) for label, n in (("x", 101), ("y", 100), ("z", 1), ("w", 50)) for k, v in enumerate(rng.integers(0, 30 if label == "w" else 10**6, n + (n > 3)))]
    rows += [(None, 4.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "label string, v double")
    want = {label: statistics.median([v for x, v in rows if x == label and v is not None]) for label in ("x", "y", "z", "w", None)}
    for parts in (1, 7):
        assert {r.label: r["median"] for r in fingerprint.medians(df, "label", "v", parts).collect()} == want


def test_labels_are_joined_with_no_deltas_and_no_percentile(spark):
    plan = _plan(registry.QUERIES["delta_by_label"](spark, SF)).lower()
    assert "percentile(" not in plan and "zip_with" not in plan and "l_orderkey" not in plan


def test_percent_ranks_are_made_together(spark, monkeypatch):
    df = spark.createDataFrame([(k, float(k % 4) if k % 5 else None, float(-k * k % 7)) for k in range(60)], "k long, a double, b double")
    calls, real = [], fingerprint.ranked
    monkeypatch.setattr(fingerprint, "ranked", lambda *a: calls.append(1) or real(*a))
    want = _rows(df.selectExpr("k", "percent_rank() over (order by a) as a", "percent_rank() over (order by b) as b"))
    for most in (0, 1_000_000):  # joined by a shuffle, and sent to all
        monkeypatch.setattr(fingerprint, "BROADCAST_VALUES", most)
        assert _rows(fingerprint.percent_ranks(df, ("a", "b"), parts=3)) == want
    assert len(calls) == 2


def test_scale_and_distances_are_made_of_batches(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 25)) * np.arange(1, 26) + 1000
    x[:, 4] = 3.0  # doesn't vary
    rows = [(str(k), "flat" if k % 3 == 0 else "none", *map(float, v)) for k, v in enumerate(x)]
    f = spark.createDataFrame(rows, "team string, cause string, " + ", ".join(f"{n} double" for n in fingerprint.FEATURES))
    scale = atypical.fit_scale(f.repartition(7))
    names = [n for k, n in enumerate(fingerprint.FEATURES) if k != 4]
    x = np.delete(x, 4, axis=1)
    assert scale.names == names and list(scale.mean.values()) == pytest.approx(x.mean(axis=0)) and list(scale.std.values()) == pytest.approx(x.std(axis=0))
    z = atypical.standardised(f, scale)
    out = atypical.atypicality(z, scale)
    assert "zip_with" not in _plan(out)
    own = (x - x.mean(axis=0)) / x.std(axis=0)
    off = own - own[np.arange(300) % 3 != 0].mean(axis=0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", off, scale.precision, off))
    got = {r.team: r.distance for r in out.select("team", "distance").collect()}
    assert [got[str(k)] for k in range(300)] == pytest.approx(want.tolist())
    # a number that is missing counts in no sum, and leaves no distance
    gone = z.withColumn(names[0], registry.F.when(registry.F.col("team") != "7", registry.F.col(names[0])))
    row = atypical.atypicality(gone, scale).where("team = '7'").first()
    assert row.distance is None and row.flag == "Typical"


def test_atypicality_evaluates_no_lists_row_by_row(spark):
    plan = _plan(registry.QUERIES["atypicality"](spark, SF)).lower()
    assert "zip_with" not in plan and "collect_list" not in plan


def test_features_are_read_once_for_their_scale(spark, monkeypatch):
    monkeypatch.setattr(atypical, "imputed", lambda f: pytest.fail("a pass for means that nothing needs"))
    columns = registry.QUERIES["standardised_features"](spark, SF).columns
    assert columns[:3] == KEYS and len(columns) > 3
