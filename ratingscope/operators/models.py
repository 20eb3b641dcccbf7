"""Scoring models: individual weighting factors of all members of all teams.

The averages are aggregates. The iterative models need a team's matrix over and over, so a complete team of up to ``PACKED_MEMBERS``
is packed into one row (one shuffle for all models) and solved in Arrow batches: teams of one size are one stack of matrices, iterated
together until each has converged. Larger and incomplete teams are iterated over the scores that there are (``operators.sparse``).
Models of one's own are functions of a team's matrix, or of tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingscope.schema import IWF, KEYS

ITERATIVE = ("peerrank", "peerrank-impute", "peerrank-exclude", "peerhits", "peerhits-impute", "peerhits-exclude")
#: Cells of the stacks that a task iterates at once.
STACK_CELLS = 2_000_000


def baseline(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean of the scores received from others; NULL if there are none."""
    peer = F.when(F.col("giver") != F.col("recipient"), F.col("score"))
    return _plain(ratings.groupBy(*keys, F.col("recipient").alias("email")).agg(F.avg(peer).alias("iwf")), "baseline", keys)


def webpa(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """10 x points received over the team's mean, self included and missing as 0; all-zero teams fail."""
    got = ratings.groupBy(*keys, F.col("recipient").alias("email")).agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("points"))
    mean = F.avg("points").over(Window.partitionBy(*keys))
    error = F.when(mean == 0, F.lit("all scores are zero"))
    return _plain(got.withColumns({"iwf": F.when(mean != 0, F.col("points") / mean * 10), "error": error}), "webpa", keys)


def _plain(df: DataFrame, model: str, keys: list[str]) -> DataFrame:
    error = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    null = lambda kind: F.lit(None).cast(kind)
    return df.select(*keys, "email", F.lit(model).alias("model"), "iwf", null("double").alias("hub"), null("boolean").alias("converged"), null("int").alias("iterations"), null("double").alias("final_l1"), error.alias("error"))


def pack(ratings: DataFrame, keys: list[str] = KEYS, most: int | None = None) -> DataFrame:
    """(keys, n, emails, cells, arcs): one row a team, members by e-mail. cells of a complete team of at most ``most`` members, row by row
    (recipient), missing is NULL; of others arcs (recipient, giver, score) instead."""
    team = ratings.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("recipient", "giver", "score"))).alias("c"))
    own = F.transform(F.filter("c", lambda x: x["recipient"] == x["giver"]), lambda x: x["recipient"])
    team = team.withColumn("own", own).withColumn("whole", (F.size("own") * F.size("own") == F.size("c")) & (F.size("own") <= (PACKED_MEMBERS if most is None else most)))
    everyone = F.array_sort(F.array_distinct(F.concat(F.transform("c", lambda x: x["giver"]), F.transform("c", lambda x: x["recipient"]))))
    emails = F.when(F.col("whole"), F.col("own")).otherwise(everyone)
    cells = F.when(F.col("whole"), F.transform("c", lambda x: x["score"])).otherwise(F.array().cast("array<double>"))
    return team.withColumn("emails", emails).select(*keys, F.size("emails").alias("n"), "emails", cells.alias("cells"), F.when(~F.col("whole"), F.col("c")).alias("arcs"))


@dataclass(frozen=True)
class Teams:
    """Packed teams that aren't made yet: rows, and what makes batches of packed teams of theirs in a task. What follows by team runs in the same
    task, so no matrices leave it."""

    rows: DataFrame
    make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
    schema: str

    def table(self) -> DataFrame:
        return self.rows.mapInArrow(self.make, self.schema)

    def in_tasks(self, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        make = self.make
        return self.rows.mapInArrow(lambda batches: run(make(batches)), schema)


def as_packed(ratings: DataFrame | Teams, keys: list[str] = KEYS, most: int | None = None) -> DataFrame:
    """Ratings as packed teams; a table of packed teams stays what it is."""
    if isinstance(ratings, Teams):
        return ratings.table()
    return ratings if "cells" in ratings.columns else pack(ratings, keys, most)


def unpacked(teams: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The ratings (keys, giver, recipient, score) of packed teams."""
    cells = F.flatten(F.transform("emails", lambda r, i: F.transform("emails", lambda g, j: F.struct(r.alias("recipient"), g.alias("giver"), F.get("cells", i * F.col("n") + j).alias("score")))))
    return teams.select(*keys, F.inline(F.coalesce("arcs", cells))).select(*keys, "giver", "recipient", "score")


def _peers(s: np.ndarray) -> np.ndarray:
    """The stack without self scores (NaN on the diagonal)."""
    out = s.copy()
    n = s.shape[1]
    out[:, np.arange(n), np.arange(n)] = np.nan
    return out


#: Cells of the teams that iterate together, last axis first, so that their numbers stay in a cache.
BLOCK_CELLS = 60_000


def _iterate(step: Callable, state: list[np.ndarray], matrices: np.ndarray, ready: np.ndarray, epsilon: float, most: int):
    """Repeats ``step`` for each team until its first state moves by less than ``epsilon``; ``state`` (members, teams) is changed in place.
    ``ready``: teams that aren't iterated. Teams are the last axis, so a step is vectors over teams; once a quarter of a block is done, others
    take their places, so that slow teams don't hold up a block but iterate among the next ones."""
    b = matrices.shape[2]
    done, rounds, l1 = ready.copy(), np.zeros(b, int), np.zeros(b)
    todo, at = np.flatnonzero(~done), 0
    size = max(64, BLOCK_CELLS // max(1, matrices.shape[0] ** 2))
    live, m, now, left, count = todo[:0], matrices[:, :, :0], [v[:, :0] for v in state], np.zeros(0, bool), np.zeros(0, int)
    many = 0
    while many or at < len(todo):
        if 4 * many <= 3 * (size if at < len(todo) else len(live)):
            more = todo[at : at + size - many]
            at += len(more)
            m = np.concatenate([m[:, :, left], matrices[:, :, more]], axis=2)
            now = [np.concatenate([v[:, left], x[:, more]], axis=1) for v, x in zip(now, state)]
            live, count = np.concatenate([live[left], more]), np.concatenate([count[left], np.zeros(len(more), int)])
            many, left = len(live), np.ones(len(live), bool)
        new = step(m, *now)
        moved = new[0] - now[0]
        moved = np.abs(moved, out=moved).sum(axis=0)
        now = new
        count += 1
        stops = left & ((moved < epsilon) | (count >= most))
        if stops.any():
            who = live[stops]
            for v, x in zip(state, now):
                v[:, who] = x[:, stops]
            done[who], rounds[who], l1[who] = moved[stops] < epsilon, count[stops], moved[stops]
            left &= ~stops
            many -= len(who)
    return done, rounds, l1


def _shares(s: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each rater's scores as shares of their sum, 0 for missing, and each team's member whose scores have none (-1)."""
    peer = _peers(s)
    pair = inside[:, :, None] & inside[:, None, :]
    gives = (~np.isnan(peer) & pair).any(axis=1)  # a score for one of the others
    a = np.where(np.isnan(peer) | ~pair, 0.0, peer)
    sums = a.sum(axis=1)
    # whoever submitted, but nothing above zero, can't be normalised; a reduced matrix may hold no peers at all
    bad = gives & (sums == 0)
    fail = np.where(bad.any(axis=1), bad.argmax(axis=1), -1)
    return np.divide(a, sums[:, None, :], out=np.zeros_like(a), where=sums[:, None, :] != 0), fail


def _peerrank(s: np.ndarray, inside: np.ndarray, alpha=0.1, epsilon=1e-6, most=1000):
    """Grades X: a rater's shares count by the rater's own grade. inside: which members take part (others have no row or
    column). Returns iwf, hub, converged, iterations, l1, failing member (-1 for none)."""
    a, fail = _shares(s, inside)
    x = a.sum(axis=2)
    total = x.sum(axis=1)
    x = np.divide(x, total[:, None], out=np.full_like(x, np.nan), where=total[:, None] != 0)

    def step(m: np.ndarray, now: np.ndarray) -> list[np.ndarray]:
        around, update = now.sum(axis=0) - now, np.einsum("ijb,jb->ib", m, now)
        if around.min() > 0:
            update /= around
        else:
            update = np.divide(update, around, out=np.zeros_like(now), where=around > 0)
        update *= alpha
        update += (1 - alpha) * now
        return [update]  # members outside have zeros only, and keep them

    state = [np.ascontiguousarray(x.T)]
    done, rounds, l1 = _iterate(step, state, a.transpose(1, 2, 0), ~np.isfinite(x).all(axis=1) | (fail >= 0), epsilon, most)
    x = state[0].T
    mean = x.sum(axis=1) / np.maximum(inside.sum(axis=1), 1)
    iwf = np.divide(x, mean[:, None], out=np.full_like(x, np.nan), where=mean[:, None] != 0) * 10
    return iwf, np.full_like(iwf, np.nan), done & (rounds > 0), rounds, l1, fail


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(axis=0))
    return v / norm if norm.all() else np.divide(v, norm, out=v.copy(), where=norm != 0)


def _mean_ten(v: np.ndarray, inside: np.ndarray) -> np.ndarray:
    mean = v.sum(axis=1, keepdims=True) / np.maximum(inside.sum(axis=1, keepdims=True), 1)
    return np.divide(v, mean, out=v / 10, where=mean != 0) * 10


def _peerhits(s: np.ndarray, inside: np.ndarray, epsilon=1e-6, most=1000):
    """Authorities and hubs, both from the other's previous values."""
    b, n, _ = s.shape
    pair = inside[:, :, None] & inside[:, None, :]
    m = np.where(np.isnan(_peers(s)) | ~pair, 0.0, _peers(s))
    start = np.ascontiguousarray((inside / np.sqrt(np.maximum(inside.sum(axis=1, keepdims=True), 1))).T)
    state = [start, start.copy()]
    step = lambda k, a, h: [_unit(np.einsum("ijb,jb->ib", k, h)), _unit(np.einsum("ijb,ib->jb", k, a))]
    done, rounds, l1 = _iterate(step, state, m.transpose(1, 2, 0), np.zeros(b, bool), epsilon, most)
    return _mean_ten(state[0].T, inside), _mean_ten(state[1].T, inside), done, rounds, l1, np.full(b, -1)


def _averages(s: np.ndarray, model: str):
    """``baseline`` and ``webpa`` on a stack, as the iterative models give theirs; a team of zeros fails WebPA with member n."""
    b, n, _ = s.shape
    if model == "baseline":
        peer = _peers(s)
        there = ~np.isnan(peer)
        iwf, fail = np.divide(np.where(there, peer, 0.0).sum(axis=2), there.sum(axis=2), out=np.full((b, n), np.nan), where=there.any(axis=2)), np.full(b, -1)
    else:
        points = np.nansum(s, axis=2)
        mean = points.mean(axis=1, keepdims=True)
        iwf, fail = np.divide(points, mean, out=np.full((b, n), np.nan), where=mean != 0) * 10, np.where(mean[:, 0] == 0, n, -1)
    return iwf, np.full((b, n), np.nan), np.full(b, None), np.zeros(b, int), np.full(b, np.nan), fail


#: What ``solve`` knows.
STACKED = ("baseline", "webpa", *ITERATIVE)


def solve(s: np.ndarray, model: str):
    """One model on a stack (teams, recipients, givers), NaN for missing."""
    if model in ("baseline", "webpa"):
        return _averages(s, model)
    core = _peerrank if model.startswith("peerrank") else _peerhits
    b, n, _ = s.shape
    everyone = np.ones((b, n), bool)
    silent = np.isnan(_peers(s)).all(axis=1)  # scored none of the others
    if model.endswith("-impute"):
        return core(np.where(silent[:, None, :], 10.0, s), everyone)
    if not model.endswith("-exclude"):
        return core(s, everyone)
    inside = ~silent
    iwf, hub, converged, rounds, l1, fail = core(s, inside)
    few = inside.sum(axis=1) < 2
    iwf, hub = np.where(inside & ~few[:, None], iwf, np.nan), np.where(inside & ~few[:, None], hub, np.nan)
    return iwf, hub, np.where(few, None, converged), np.where(few, 0, rounds), np.where(few, np.nan, l1), np.where(few, -1, fail)


def distinct(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the different matrices of a stack, and for each matrix which of these it is."""
    bits = np.ascontiguousarray(s).reshape(len(s), -1).view(np.uint64)
    odd = np.random.default_rng(7).integers(0, 2**63, bits.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = ((bits ^ bits >> np.uint64(33)) * odd).sum(axis=1)
    _, first, which = np.unique(mixed, return_index=True, return_inverse=True)
    alone = np.flatnonzero((bits[first][which] != bits).any(axis=1))  # other matrices of equal hash
    which[alone] = len(first) + np.arange(len(alone))
    return np.concatenate([first, alone]), which


def solve_distinct(s: np.ndarray, names: tuple[str, ...]) -> dict[str, tuple]:
    """``solve_all``, equal matrices once."""
    first, which = distinct(s)
    return {m: tuple(x[which] for x in found) for m, found in solve_all(s[first], names).items()}


def _excluding(s: np.ndarray, model: str) -> tuple:
    """``solve`` of a model that leaves silent members out: what is said of these makes no other matrix."""
    inside = ~np.isnan(_peers(s)).all(axis=1)
    seen = np.where(inside[:, :, None] & inside[:, None, :], s, np.nan)
    seen[:, np.arange(s.shape[1]), np.arange(s.shape[1])] = inside
    first, which = distinct(seen)
    return tuple(x[which] for x in solve(s[first], model))


def solve_all(s: np.ndarray, names: tuple[str, ...]) -> dict[str, tuple]:
    """Models on a stack. Imputing and excluding are the same model where nobody is silent, so such teams are iterated once for both."""
    one = lambda m: _excluding(s, m) if m.endswith("-exclude") else solve(s, m)
    out = {m: one(m) for m in names if not m.endswith("-impute") or m.replace("impute", "exclude") not in names}
    silent = np.isnan(_peers(s)).all(axis=1).any(axis=1)
    for m in names:
        if m not in out:
            out[m] = tuple(np.array(x) for x in out[m.replace("impute", "exclude")])
            if silent.any():
                for x, y in zip(out[m], solve(s[silent], m)):
                    x[silent] = y
    return out


def failed(s: np.ndarray, model: str) -> np.ndarray:
    """Of ``solve`` only which member a team fails for (-1 for none), which nothing is iterated for."""
    if model in ("baseline", "webpa"):
        return _averages(s, model)[5]
    b, n, _ = s.shape
    if not model.startswith("peerrank"):
        return np.full(b, -1)
    silent, everyone = np.isnan(_peers(s)).all(axis=1), np.ones((b, n), bool)
    if model.endswith("-impute"):
        return _shares(np.where(silent[:, None, :], 10.0, s), everyone)[1]
    inside = ~silent if model.endswith("-exclude") else everyone
    few = model.endswith("-exclude") & (inside.sum(axis=1) < 2)
    return np.where(few, -1, _shares(s, inside)[1])


#: Rows of batches that are put together for a task, while their cells are fewer than ``STACK_CELLS``.
GATHERED_ROWS = 50_000


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed teams in fewer, larger batches: each batch's slowest teams cost steps of their own."""
    held, rows, cells = [], 0, 0
    whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()
    for batch in batches:
        held.append(batch)
        rows, cells = rows + batch.num_rows, cells + len(batch.column("cells").flatten())
        if rows >= GATHERED_ROWS or cells >= STACK_CELLS:
            yield from whole()
            held, rows, cells = [], 0, 0
    if held:
        yield from whole()


def stacks(batch: pa.RecordBatch, times: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a batch of packed teams: row numbers of complete teams of one size, and their matrices (teams, recipients, givers). ``times``:
    how many matrices the caller makes of each."""
    whole = batch.column("arcs").is_null().to_numpy(zero_copy_only=False)
    sizes = np.where(whole, batch.column("n").to_numpy(zero_copy_only=False), 0)
    flat = batch.column("cells").flatten().to_numpy(zero_copy_only=False).astype(float)
    starts = np.concatenate([[0], np.cumsum(sizes.astype(np.int64) ** 2)])
    for n in np.unique(sizes[whole]).tolist():
        same = np.flatnonzero(whole & (sizes == n))
        for part in np.array_split(same, max(1, -(-len(same) * n * n * times // STACK_CELLS))):
            yield part, flat[(starts[part][:, None] + np.arange(n * n))].reshape(len(part), n, n)


#: Complete teams of so many members are packed into rows as matrices.
PACKED_MEMBERS = 64


def split_by_size(ratings: DataFrame, most: int, keys: list[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """The ratings of complete teams of at most ``most`` members, and all others. Both come from one shuffle by team."""
    if "cells" in ratings.columns:
        return ratings.where("arcs is null"), unpacked(ratings.where("arcs is not null"), keys)
    w = Window.partitionBy(*keys)
    sized = ratings.withColumns({"_cells": F.count("*").over(w), "_own": F.count_if(F.col("giver") == F.col("recipient")).over(w)})
    packed = (F.col("_cells") == F.col("_own") * F.col("_own")) & (F.col("_own") <= most)
    return sized.where(packed).drop("_cells", "_own"), sized.where(~packed).drop("_cells", "_own")


def iterative(ratings: DataFrame, models: tuple[str, ...] = ITERATIVE, keys: list[str] = KEYS, most: int | None = None) -> DataFrame:
    """All named models in one pass over packed teams: complete teams of at most ``most`` members as stacks of matrices, others over the
    scores that there are. A team for which a model fails has rows with its error and NULL scores."""
    packed = as_packed(ratings, keys, most)
    types = {f.name: f.dataType.simpleString() for f in packed.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + IWF
    own = {m: MATRIX_MODELS[m] for m in models if m in MATRIX_MODELS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, stack in stacks(batch):
                n = stack.shape[1]
                rows = batch.select(keys).take(pa.array(np.repeat(part, n)))
                emails = batch.column("emails").take(pa.array(part)).flatten()
                for model in models:
                    if model in own:
                        yield _by_matrix(own[model], rows, keys, emails, model, stack)
                    else:
                        yield _as_batch(rows, keys, emails, model, solve(stack, model), n)
            for k in np.flatnonzero(batch.column("arcs").is_valid().to_numpy(zero_copy_only=False)).tolist():
                emails, cells = batch.column("emails").slice(k, 1).flatten(), batch.column("arcs").slice(k, 1).flatten()
                n = len(emails)
                rows = batch.select(keys).take(pa.array(np.full(n, k)))
                r, g = (pc.index_in(cells.field(c), emails).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("recipient", "giver"))
                s = cells.field("score").to_numpy(zero_copy_only=False).astype(float)
                for model in models:
                    if model in own:
                        matrix = np.full((1, n, n), np.nan)
                        matrix[0, r, g] = s
                        yield _by_matrix(own[model], rows, keys, emails, model, matrix)
                    else:
                        yield _as_batch(rows, keys, emails, model, _sparse(n, r, g, s, model), n)

    return packed.mapInArrow(run, schema)


def solved(batch: pa.RecordBatch, names: tuple[str, ...], failures: bool = False) -> Iterator[tuple[np.ndarray, pa.Array, dict[str, tuple]]]:
    """Of a batch of packed teams: row numbers of teams of one size, their members' e-mails, and each model as ``solve`` gives it, of
    ``failures`` only the last, ``failed``."""
    for part, stack in stacks(batch):
        found = {m: (None,) * 5 + (failed(stack, m),) for m in names} if failures else solve_all(stack, names)
        yield part, batch.column("emails").take(pa.array(part)).flatten(), found
    for k in np.flatnonzero(batch.column("arcs").is_valid().to_numpy(zero_copy_only=False)).tolist():
        emails, cells = batch.column("emails").slice(k, 1).flatten(), batch.column("arcs").slice(k, 1).flatten()
        r, g = (pc.index_in(cells.field(c), emails).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("recipient", "giver"))
        s = cells.field("score").to_numpy(zero_copy_only=False).astype(float)
        yield np.array([k]), emails, {m: _sparse(len(emails), r, g, s, m) for m in names}


def _sparse(n: int, r: np.ndarray, g: np.ndarray, s: np.ndarray, model: str):
    """What ``solve`` gives for a stack of one, from a team's scores."""
    from ratingscope.operators import sparse

    there = ~np.isnan(s)
    peer = there & (r != g)
    if model == "baseline":
        count = np.bincount(r[peer], minlength=n)
        iwf, fail = np.divide(np.bincount(r[peer], s[peer], n), count, out=np.full(n, np.nan), where=count > 0), -1
    elif model == "webpa":
        points = np.bincount(r[there], s[there], n).astype(float)
        mean = points.mean()
        iwf, fail = (points / mean * 10, -1) if mean else (np.full(n, np.nan), n)
    else:
        iwf, hub, converged, rounds, l1, fail = sparse.solve(n, r[peer], g[peer], s[peer], model)
        return iwf[None], hub[None], np.array([converged]), np.array([rounds]), np.array([l1]), np.array([fail])
    return iwf[None], np.full((1, n), np.nan), np.array([None]), np.zeros(1, int), np.full(1, np.nan), np.array([fail])


def _by_matrix(fn: MatrixModel, rows: pa.RecordBatch, keys: list[str], emails: pa.Array, model: str, stack: np.ndarray) -> pa.RecordBatch:
    """A model of one's own, team by team. What it raises, or a wrong number of scores, is that team's error, and others go on."""
    b, n, _ = stack.shape
    names, columns = emails.to_pylist(), {c: [] for c in ("iwf", "hub", "converged", "iterations", "final_l1", "error")}
    for k in range(b):
        team, found, error = names[k * n : (k + 1) * n], {}, None
        try:
            found = fn(stack[k].copy(), team)
            found = dict(found) if isinstance(found, dict) else {"iwf": found}
            for c in ("iwf", "hub"):
                values = np.asarray([np.nan] * n if found.get(c) is None else found[c], float)
                if values.shape != (n,):
                    raise ValueError(f"{c} of {values.size} scores for {n} members")
                found[c] = [None if np.isnan(v) else v for v in values.tolist()]
        except Exception as e:  # whatever a model of one's own raises
            found, error = {"iwf": [None] * n, "hub": [None] * n}, f"{type(e).__name__}: {e}"
        for c in ("iwf", "hub"):
            columns[c] += found[c]
        for c, kind in (("converged", bool), ("iterations", int), ("final_l1", float)):
            columns[c] += [None if found.get(c) is None else kind(found[c])] * n
        columns["error"] += [error] * n
    kinds = {"iwf": pa.float64(), "hub": pa.float64(), "converged": pa.bool_(), "iterations": pa.int32(), "final_l1": pa.float64(), "error": pa.string()}
    arrays = [rows.column(c) for c in keys] + [emails, pa.array([model] * len(names))] + [pa.array(columns[c], kinds[c]) for c in kinds]
    return pa.RecordBatch.from_arrays(arrays, names=[*keys, "email", "model", *kinds])


def failure(model: str, members: list[str], failing: int) -> str:
    """What is said of a run that fails because of a member."""
    return "all scores are zero" if model == "webpa" else f"ValueError: {members[failing]} gave only zeros"


def _as_batch(rows: pa.RecordBatch, keys: list[str], emails: pa.Array, model: str, solved, n: int) -> pa.RecordBatch:
    iwf, hub, converged, rounds, l1, fail = solved
    failed = np.repeat(fail >= 0, n)
    iwf, hub = iwf.ravel(), hub.ravel()
    idle = np.repeat(rounds == 0, n)
    names = emails.to_pylist()
    message = [failure(model, names[k * n : (k + 1) * n], f) if f >= 0 else None for k, f in enumerate(fail.tolist())]
    columns = [rows.column(k) for k in keys] + [
        emails,
        pa.array([model] * len(iwf)),
        pa.array(iwf, mask=np.isnan(iwf) | failed),
        pa.array(hub, mask=np.isnan(hub) | failed),
        pa.array([None if i else bool(c) for c, i in zip(np.repeat(converged, n), idle)], pa.bool_()),
        pa.array(np.repeat(rounds, n).astype(np.int32), mask=idle),
        pa.array(np.repeat(l1, n).astype(float), mask=idle),
        pa.array([m for m in message for _ in range(n)], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[*keys, "email", "model", "iwf", "hub", "converged", "iterations", "final_l1", "error"])


# ---------------------------------------------------------------- registry

MODELS: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {"baseline": baseline, "webpa": webpa}
#: Names of registered models that packed teams can't run.
REPLACED: set[str] = set()
MatrixModel = Callable[[np.ndarray, list[str]], "np.ndarray | dict"]
MATRIX_MODELS: dict[str, MatrixModel] = {}


def register_model(name: str, fn: Callable[[DataFrame, list[str]], DataFrame]) -> None:
    """Add a model of tables: ratings and keys to rows of the iwf table (without the column model)."""
    MODELS[name] = fn
    REPLACED.add(name)


def register_matrix_model(name: str, fn: MatrixModel) -> None:
    """Add a model of one team: the matrix (recipients, givers; NaN for missing) and the members' e-mails to their scores, or to a
    dictionary with iwf and, if it has them, hub, converged, iterations and final_l1. It runs in tasks, so it must be picklable.
    A team for which it raises has the exception as its error."""
    MATRIX_MODELS[name] = fn


NAMES = ("baseline", "peerrank-impute", "peerrank-exclude", "webpa", "peerhits-impute", "peerhits-exclude")


def score(ratings: DataFrame, models: tuple[str, ...] = NAMES, keys: list[str] = KEYS, most: int | None = None, joins: bool = False) -> DataFrame:
    """The iwf table of the named models; unknown names are an error. A team is a row of one task, as a matrix or as its scores. ``joins``: teams
    with more than ``sparse.TASK_ARCS`` scores are iterated step by step instead, which runs when this is called."""
    from ratingscope.operators import sparse

    unknown = [m for m in models if m not in MODELS and m not in ITERATIVE and m not in MATRIX_MODELS]
    if unknown:
        raise ValueError(f"unknown models: {', '.join(unknown)}")
    own = [m for m in models if m in REPLACED or m in MODELS and m not in STACKED]
    inside = tuple(m for m in models if m not in own)
    tables = lambda df, names: [MODELS[m](df, keys).withColumn("model", F.lit(m)) for m in names]
    parts = tables(ratings, own)
    packed = "cells" in ratings.columns
    if packed and (own or joins):
        raise ValueError("models of tables need ratings that aren't packed")
    if set(inside) <= {"baseline", "webpa"} and not packed:
        parts += tables(ratings, inside)
    elif joins:
        fits, huge = sparse.by_task(ratings, keys)
        parts.append(iterative(fits, inside, keys, most))
        parts += [*tables(huge, [m for m in inside if m in MODELS]), *(sparse.joined(huge, m, keys=keys) for m in inside if m in ITERATIVE)]
    else:
        parts.append(iterative(ratings, inside, keys, most))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_status(iwf: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, model, error): one row a team and model, NULL where it succeeded."""
    return iwf.groupBy(*keys, "model").agg(F.max("error").alias("error"))


def convergence(iwf: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, model, converged, iterations, final_l1) of each run that didn't fail."""
    return iwf.where("error is null").groupBy(*keys, "model").agg(F.max("converged").alias("converged"), F.max("iterations").alias("iterations"), F.max("final_l1").alias("final_l1"))
