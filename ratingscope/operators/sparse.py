"""Iterative models for large and incomplete teams: what is computed grows with the scores that there are, not with n x n.

A team's scores are arcs (recipient, giver, score) with members numbered by e-mail, iterated in one task as sums over arcs. The
column of tens that stands in for a silent giver is never written out: it gives every other member the same, so it is one sum and a
correction for the own self. Teams of more than ``TASK_ARCS`` scores can be iterated as joins of arcs with the members' values, step by
step, all of them together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingscope.operators import members
from ratingscope.schema import KEYS
from ratingscope.shared import checkpointed

#: The most scores of a team that one task takes (some 24 bytes each, and as much again while it iterates).
TASK_ARCS = 5_000_000


# ---------------------------------------------------------------- one team, in a task


def _flow(n: int, r: np.ndarray, g: np.ndarray, a: np.ndarray, silent: np.ndarray | None, share: float):
    """x -> sum of a * x[g] by recipient, silent givers giving ``share`` of their value to every other member."""
    of = np.flatnonzero(silent) if silent is not None else None

    def step(x: np.ndarray) -> np.ndarray:
        out = np.bincount(r, a * x[g], n).astype(float)
        if of is not None and len(of):
            out += share * x[of].sum()
            out[of] -= share * x[of]
        return out

    return step


def solve(n: int, r: np.ndarray, g: np.ndarray, s: np.ndarray, model: str, alpha: float = 0.1, epsilon: float = 1e-6, most: int = 1000):
    """One model for n members and the scores that they gave each other. Returns iwf, hub, converged, iterations, l1 and the
    failing member (-1 for none), as the packed models do for a stack of one."""
    silent = np.bincount(g, minlength=n) == 0
    inside, none = np.ones(n, bool), (np.full(n, np.nan), np.full(n, np.nan))
    tens = None
    if model.endswith("-exclude"):
        inside = ~silent
        if inside.sum() < 2:
            return *none, None, 0, np.nan, -1
        keep = inside[r] & inside[g]
        r, g, s = r[keep], g[keep], s[keep]
    elif model.endswith("-impute"):
        tens = silent
    size = max(int(inside.sum()), 1)
    if model.startswith("peerrank"):
        sums = np.bincount(g, s, n).astype(float)
        bad = (np.bincount(g, minlength=n) > 0) & (sums == 0)
        if tens is not None and n == 1:
            tens = None
        fail = int(bad.argmax()) if bad.any() else -1
        flow = _flow(n, r, g, np.divide(s, sums[g], out=np.zeros(len(s)), where=sums[g] != 0), tens, 1 / max(n - 1, 1))
        x = flow(np.ones(n))
        total = x.sum()
        if fail >= 0 or total == 0 or not np.isfinite(total):
            return *none, False, 0, 0.0, fail
        x, l1, rounds = x / total, 0.0, 0
        for rounds in range(1, most + 1):
            around = x.sum() - x
            update = np.divide(flow(x), around, out=np.zeros(n), where=around > 0)
            new = np.where(inside, (1 - alpha) * x + alpha * update, 0.0)
            l1, x = float(np.abs(new - x).sum()), new
            if l1 < epsilon:
                break
        mean = x.sum() / size
        iwf = x / mean * 10 if mean else none[0]
        return np.where(inside, iwf, np.nan), none[1], l1 < epsilon, rounds, l1, -1
    to_a, to_h = _flow(n, r, g, s, tens, 10.0), _flow(n, g, r, s, None, 0.0)
    unit = lambda v: v / norm if (norm := np.sqrt((v * v).sum())) else v
    a = h = inside / np.sqrt(size)
    l1, rounds = 0.0, 0
    for rounds in range(1, most + 1):
        given = to_h(a)
        if tens is not None:
            given[tens] += 10.0 * (a.sum() - a[tens])
        new = unit(to_a(h))
        h, l1, a = unit(given), float(np.abs(new - a).sum()), new
        if l1 < epsilon:
            break
    ten = lambda v: np.where(inside, v / (v.sum() / size) * 10 if v.sum() else v, np.nan)
    return ten(a), ten(h), l1 < epsilon, rounds, l1, -1


# ---------------------------------------------------------------- teams beyond a task


def arcs(ratings: DataFrame, keys: list[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Members (keys, email, idx), and the scores that they gave each other (keys, r, g, s) by their numbers."""
    people = members.members(ratings, keys)
    peer = ratings.where("score is not null and giver <> recipient").select(*keys, "giver", "recipient", F.col("score").alias("s"))
    for side, number in (("giver", "g"), ("recipient", "r")):
        peer = peer.join(people.withColumnsRenamed({"email": side, "idx": number}), [*keys, side])
    return people, peer.select(*keys, "r", "g", "s")


def by_task(ratings: DataFrame, keys: list[str] = KEYS, most_arcs: int = TASK_ARCS) -> tuple[DataFrame, DataFrame]:
    """The ratings of teams that a task takes, and of those with more scores."""
    count = F.count_if(F.col("score").isNotNull() & (F.col("giver") != F.col("recipient"))).over(Window.partitionBy(*keys))
    sized = ratings.withColumn("_arcs", count)
    return sized.where(F.col("_arcs") <= most_arcs).drop("_arcs"), sized.where(F.col("_arcs") > most_arcs).drop("_arcs")


def joined(ratings: DataFrame, model: str, alpha: float = 0.1, epsilon: float = 1e-6, most: int = 1000, every: int = 10, keys: list[str] = KEYS) -> DataFrame:
    """One iterative model for teams of any size, as joins: every step joins arcs with the givers' values and sums by recipient. Teams
    that have converged are set aside, so a step costs what the open teams cost. Lineage is cut by a reliable checkpoint every few
    steps, so an executor may be lost at any time. Ten values of a silent giver are a sum by team."""
    rank, by_team = model.startswith("peerrank"), Window.partitionBy(*keys)
    people, peer = arcs(ratings, keys)
    gave = peer.groupBy(*keys, F.col("g").alias("idx")).agg(F.sum("s").alias("given"))
    people = people.join(gave, [*keys, "idx"], "left").withColumn("silent", F.col("given").isNull())
    people = people.withColumns({"n": F.count("*").over(by_team), "inside": ~F.col("silent") if model.endswith("-exclude") else F.lit(True)})
    if model.endswith("-exclude"):
        kept = people.where("inside").select(*keys, "idx")
        for side in "rg":
            peer = peer.join(kept.withColumnRenamed("idx", side), [*keys, side], "left_semi")
        # what was given within the reduced team
        people = people.drop("given").join(peer.groupBy(*keys, F.col("g").alias("idx")).agg(F.sum("s").alias("given")), [*keys, "idx"], "left")
    tens = F.col("silent") & (F.col("n") > 1) if model.endswith("-impute") else F.lit(False)
    people = people.withColumns({"tens": tens, "size": F.sum(F.col("inside").cast("int")).over(by_team)})
    people = people.withColumns({"bad": F.min(F.when((F.col("given") == 0) & F.col("inside"), F.col("email"))).over(by_team)}) if rank else people.withColumn("bad", F.lit(None).cast("string"))
    people = checkpointed(people)
    if rank:
        peer = peer.join(people.select(*keys, F.col("idx").alias("g"), "given"), [*keys, "g"]).withColumn("s", F.coalesce(F.try_divide("s", "given"), F.lit(0.0)))
    peer = checkpointed(peer.select(*keys, "r", "g", "s"))
    few = F.col("size") < 2 if model.endswith("-exclude") else F.lit(False)

    def flow(x: DataFrame, value: str, source: str, target: str, name: str) -> DataFrame:
        sent = peer.join(x.select(*keys, F.col("idx").alias(source), F.col(value).alias("_v")), [*keys, source])
        return sent.groupBy(*keys, F.col(target).alias("idx")).agg(F.sum(F.col("s") * F.col("_v")).alias(name))

    silent_sum = lambda v: F.sum(F.when(F.col("tens"), F.col(v)).otherwise(0.0)).over(by_team) - F.when(F.col("tens"), F.col(v)).otherwise(0.0)
    x = people.where(F.col("bad").isNull() & ~few)
    if rank:
        x = x.withColumn("one", F.lit(1.0))
        x = x.join(flow(x, "one", "g", "r", "f"), [*keys, "idx"], "left").withColumn("x", F.coalesce("f", F.lit(0.0)) + silent_sum("one") / F.greatest(F.col("n") - 1, F.lit(1)))
        total = F.sum("x").over(by_team)
        x = x.withColumn("_t", total).where("_t > 0").withColumn("x", F.col("x") / F.col("_t")).withColumn("h", F.lit(None).cast("double"))
    else:
        x = x.withColumn("x", F.col("inside").cast("int") / F.sqrt("size")).withColumn("h", F.col("x"))
    state = [*keys, "email", "idx", "n", "size", "inside", "tens", "x", "h"]
    x = checkpointed(x.select(*state).withColumns({"iterations": F.lit(0), "l1": F.lit(None).cast("double")}))
    done: list[DataFrame] = []
    kept_tables: list[DataFrame] = []
    for step in range(1, most + 1):
        new = x.join(flow(x, "x" if rank else "h", "g", "r", "f"), [*keys, "idx"], "left").withColumn("f", F.coalesce("f", F.lit(0.0)))
        if rank:
            new = new.withColumn("f", F.col("f") + silent_sum("x") / F.greatest(F.col("n") - 1, F.lit(1)))
            around = F.sum("x").over(by_team) - F.col("x")
            update = F.when(around > 0, F.col("f") / around).otherwise(0.0)
            new = new.withColumn("new", F.when(F.col("inside"), (1 - alpha) * F.col("x") + alpha * update).otherwise(0.0)).withColumn("h2", F.lit(None).cast("double"))
        else:
            back = flow(x, "x", "r", "g", "b")
            new = new.join(back, [*keys, "idx"], "left").withColumn("b", F.coalesce("b", F.lit(0.0)) + F.when(F.col("tens"), 10.0 * (F.sum("x").over(by_team) - F.col("x"))).otherwise(0.0))
            new = new.withColumn("f", F.col("f") + 10.0 * silent_sum("h"))
            unit = lambda c: F.col(c) / F.coalesce(F.nullif(F.sqrt(F.sum(F.col(c) * F.col(c)).over(by_team)), F.lit(0.0)), F.lit(1.0))
            new = new.withColumns({"new": unit("f"), "h2": unit("b")})
        new = new.withColumn("l1", F.sum(F.abs(F.col("new") - F.col("x"))).over(by_team)).withColumn("iterations", F.lit(step))
        cut = step % every == 0 or step == most
        new = new.select(*state[:-2], F.col("new").alias("x"), F.col("h2").alias("h"), "iterations", "l1")
        x = checkpointed(new) if cut else new.persist()
        if cut:
            for table in kept_tables:
                table.unpersist()
            kept_tables = []
        else:
            kept_tables.append(x)
        open_ = x.where(F.col("l1") >= epsilon)
        if x.where(F.col("l1") < epsilon).isEmpty():
            continue
        done.append(checkpointed(x.where(F.col("l1") < epsilon)))
        x = open_
        if x.isEmpty():
            break
    out = x
    for part in done:
        out = out.unionByName(part)
    out = checkpointed(out)
    for table in kept_tables:
        table.unpersist()
    mean = lambda c: F.sum(c).over(by_team) / F.col("size")
    ten = lambda c: F.when(F.col("inside"), F.when(mean(c) != 0, F.col(c) / mean(c) * 10).otherwise(F.col(c) if not rank else F.lit(None).cast("double")))
    scored = out.select(*keys, "email", ten("x").alias("iwf"), ten("h").alias("hub"), (F.col("l1") < epsilon).alias("converged"), "iterations", F.col("l1").alias("final_l1"))
    message = F.concat(F.lit("ValueError: "), F.col("bad"), F.lit(" gave only zeros"))
    return people.select(*keys, "email", message.alias("error")).join(scored, [*keys, "email"], "left").select(*keys, "email", F.lit(model).alias("model"), "iwf", "hub", "converged", "iterations", "final_l1", "error")
