"""The ratings view made in tasks, and models whose slow teams iterate among others."""

from __future__ import annotations

import datetime

import numpy as np
import pyarrow as pa

from ratingscope.operators import inside, models
from ratingscope.schema import KEYS
from ratingscope.sources import ratings_view, view_kernel


def test_packed_view_is_the_long_one(spark, tmp_path):
    """Suppliers, flags and quantities that are missing, repeated, negative or too long for an e-mail, and a team that is no matrix."""
    lines = [(1, 5, 1.0, "N"), (1, 5, 2.5, "R"), (1, None, 3.0, "A"), (1, 200000000, None, "Z"), (1, -3, 4.0, "R"), (2, 7, None, None), (2, 8, 1.0, "R"), (3, 9, 1.0, "N")]
    lines += [(4, 1, 1.0, "B"), (4, 2, 1.9, "Z"), (4, 2, 1.9, "R"), (5, 123456789, -7.5, "N"), (5, 3, 7.5, "A")] + [(6, k * 37 % 70, float(k), "NRA"[k % 3] if k % 9 else None) for k in range(150)]
    orders = [(k, f"p{k}", datetime.datetime(1995, 1, k) if k != 3 else None) for k in range(1, 7)] + [(1, "again", datetime.datetime(1996, 1, 1))]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    for share in (None, 0.5):
        long = ratings_view.ratings(spark, str(tmp_path), share).select(*KEYS, "giver", "recipient", "score")
        packed = models.unpacked(ratings_view.teams(spark, str(tmp_path), share)).select(long.columns)
        assert long.count() > 70 * 70
        assert long.exceptAll(packed).count() == 0 and packed.exceptAll(long).count() == 0


def test_quantity_that_is_no_long_is_an_error():
    line = pa.array([[{"s": 1, "q": float("nan"), "f": 0}]], pa.list_(pa.struct([("s", pa.int64()), ("q", pa.float64()), ("f", pa.int8())])))
    try:
        view_kernel.members(line)
    except OverflowError:
        return
    raise AssertionError("no error")


def _stack(n: int, b: int) -> np.ndarray:
    rng = np.random.default_rng(1)
    s = rng.integers(0, 4, (b, n, n)).astype(float)
    s[np.repeat(rng.random((b, 1, n)) < 0.2, n, axis=1)] = np.nan
    return s


def test_failures_are_found_without_iterating(monkeypatch):
    stack = _stack(3, 400)
    want = {m: models.solve(stack, m)[5] for m in models.STACKED}
    assert any((f >= 0).any() for f in want.values())

    def never(*_):
        raise AssertionError("iterated")

    monkeypatch.setattr(models, "_iterate", never)
    for m, fail in want.items():
        assert models.failed(stack, m).tolist() == fail.tolist()


def test_a_slow_team_does_not_hold_up_its_block(monkeypatch):
    """Ten blocks, each with one team that needs 300 steps: other teams take the places of those that are done."""
    monkeypatch.setattr(models, "BLOCK_CELLS", 400)
    calls, n, b = [], 2, 1000
    rate = np.full(b, 0.01)
    rate[::100] = 0.955

    def step(m, now):
        calls.append(now.shape[1])
        return [now * m[0, 0]]

    state = [np.ones((n, b))]
    done, rounds, _ = models._iterate(step, state, np.broadcast_to(rate, (n, n, b)).copy(), np.zeros(b, bool), 1e-6, 1000)
    slow = rounds[::100]
    assert done.all() and len(set(slow.tolist())) == 1 and slow[0] > 200
    assert np.allclose(state[0][0], rate**rounds)
    assert len(calls) < 3 * slow[0]


def test_batches_are_put_together():
    schema = pa.schema([("cells", pa.list_(pa.float64()))])
    batches = [pa.record_batch([pa.array([[1.0, 2.0]] * 30, schema.field(0).type)], schema=schema) for _ in range(7)]
    assert [b.num_rows for b in models.gathered(iter(batches))] == [210]
    assert inside.models.gathered is models.gathered


def test_only_failed_runs_leave_a_task(spark):
    rows = [("f", t, "q", g, r, 0.0 if t == "zero" else 5.0) for t in ("zero", "fine") for g in "ab" for r in "ab"]
    r = spark.createDataFrame(rows, "csv_path string, team string, question string, giver string, recipient string, score double")
    every = inside.run_status(r)
    assert every.count() == 12
    assert sorted(inside.run_status(r, only_failed=True).collect()) == sorted(every.where("error is not null").collect()) != []


def test_only_the_variants_asked_for_are_run(spark):
    from ratingscope.operators import perturb

    rows = [("f", "t", "q", g, r, float((3 * i + 5 * j) % 7)) for i, g in enumerate("abcd") for j, r in enumerate("abcd")]
    r = spark.createDataFrame(rows, "csv_path string, team string, question string, giver string, recipient string, score double")
    every, one = perturb.team_summaries(r, 2), perturb.team_summaries(r, 2, only=("single_outlier",))
    assert {x.variant for x in one.collect()} == {"single_outlier"}
    assert sorted(map(str, one.collect())) == sorted(map(str, every.where("variant = 'single_outlier'").collect()))
