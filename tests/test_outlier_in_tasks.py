"""The outlier's scores are dealt where a team is made."""

from __future__ import annotations

import datetime

from ratingscope.operators import perturb
from ratingscope.plans import registry
from ratingscope.schema import KEYS
from ratingscope.sources import ratings_view


def _tables(spark, folder: str) -> None:
    """Teams of one to seven, one of seventy (no matrix), silent members, suppliers without a number, an order without a date."""
    lines = [(k, (k * 31 + j * 7) % 50, float((k * j) % 11), "NRA"[(k + j) % 3]) for k in range(1, 30) for j in range(k % 7 + 1)]
    lines += [(3, None, 3.0, "A"), (4, None, None, "N")] + [(30, k * 37 % 70, float(k), "NRA"[k % 3]) for k in range(150)] + [(31, 9, 1.0, "R"), (32, 5, None, "N")]
    orders = [(k, f"p{k % 3}" if k != 6 else None, datetime.datetime(1992 + k % 4, 1, 1) if k != 5 else None) for k in range(1, 33)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string, o_orderdate timestamp").write.parquet(f"{folder}/orders.parquet")


def test_outliers_of_packed_teams_are_those_of_tables(spark, tmp_path):
    _tables(spark, str(tmp_path))
    columns = [*KEYS, "giver", "recipient", "score"]
    long = ratings_view.ratings(spark, str(tmp_path)).where("question is not null").select(columns)
    want = perturb.single_outlier(long)
    packed = ratings_view.teams_to_be(spark, str(tmp_path))
    for teams in (packed, packed.table(), long):
        got = perturb.outliers_in_tasks(teams).where("question is not null").select(columns)
        assert want.count() > 4900 and want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0


def test_the_query_shuffles_lines_and_no_ratings(spark, tmp_path):
    _tables(spark, str(tmp_path))
    plan = registry.QUERIES["single_outlier"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan
