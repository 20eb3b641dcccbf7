"""Counterfactual ratings: how far would the scores move if raters had rated otherwise.

Each transform maps ratings to ratings and changes active raters' columns only. ``variants`` stacks the results under a key
more, so that every model runs once over all of them. ``runs`` does the same inside of packed teams wherever it can.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingscope.operators import models
from ratingscope.operators import perturb_kernel as kernel
from ratingscope.operators.models import PACKED_MEMBERS, split_by_size
from ratingscope.schema import KEYS
from ratingscope.shared import written


def _own() -> Column:
    return F.col("giver") == F.col("recipient")


def _with_raters(ratings: DataFrame, keys: list[str]) -> DataFrame:
    """Adds _active (the giver has a score), _raters (active givers of the team), _rank (of the giver among them, from 1) and
    _n (members)."""
    by_giver, by_team = Window.partitionBy(*keys, "giver"), Window.partitionBy(*keys)
    out = ratings.withColumn("_active", F.count("score").over(by_giver) > 0)
    own = _own() & F.col("_active")
    out = out.withColumns({"_raters": F.count_if(own).over(by_team), "_n": F.count_if(_own()).over(by_team)})
    # row by row in the givers' order the number of active givers so far is the rank
    running = F.count_if(own).over(by_team.orderBy("giver").rangeBetween(Window.unboundedPreceding, 0))
    return out.withColumn("_rank", F.when(F.col("_active"), running))


def _done(df: DataFrame, score: Column, columns: list[str]) -> DataFrame:
    return df.withColumn("score", score).select(columns)


def uniform_inflation(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Each rater spreads the points, those for the own self too, evenly over the others."""
    df = _with_raters(ratings, keys)
    share = F.sum("score").over(Window.partitionBy(*keys, "giver")) / F.nullif(F.col("_n") - 1, F.lit(0))
    return _done(df, F.when(~F.col("_active"), F.col("score")).when(~_own(), share), ratings.columns)


def zero_self(ratings: DataFrame, colluders: int | list[str] | None = None, self_share: float | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Raters give themselves nothing and scale what they give by n/(n-1), or 1/(1 - self_share); ``colluders``: only the first
    so many raters by e-mail, or the raters of these e-mails. Teams with fewer than two such raters are left out (``failures`` names
    those with fewer than two raters)."""
    df = _with_raters(ratings, keys).where("_raters >= 2")
    factor = F.lit(1 / (1 - self_share)) if self_share is not None else F.col("_n") / (F.col("_n") - 1)
    if isinstance(colluders, list):
        df = df.withColumn("_in", F.col("giver").isin(*colluders) & F.col("_active") if colluders else F.lit(False))
        df = df.withColumn("_many", F.count_if(_own() & F.col("_in")).over(Window.partitionBy(*keys))).where("_many >= 2")
        chosen = F.col("_in")
    else:
        chosen = F.col("_active") & (F.lit(True) if colluders is None else F.col("_rank") <= colluders)
    return _done(df, F.when(chosen, F.col("score") * factor).otherwise(F.col("score")), ratings.columns)


def targeted_downvote(ratings: DataFrame, victim: Column | None = None, keys: list[str] = KEYS) -> DataFrame:
    """The victim (an e-mail; the first rater by default) gets 0 from every other rater, who shares out the freed points to
    the rest in proportion to what they have, or evenly if that is nothing. Teams without raters are left out (``failures`` names them)."""
    df = _with_raters(ratings, keys).where("_raters >= 1")
    first = F.min(F.when(F.col("_rank") == 1, F.col("giver"))).over(Window.partitionBy(*keys))
    df = df.withColumn("_victim", first if victim is None else victim)
    by_giver = Window.partitionBy(*keys, "giver")
    gains = ~_own() & (F.col("recipient") != F.col("_victim"))
    freed = F.coalesce(F.sum(F.when(F.col("recipient") == F.col("_victim"), F.col("score"))).over(by_giver), F.lit(0.0))
    total, many = F.sum(F.when(gains, F.col("score"))).over(by_giver), F.count_if(gains).over(by_giver)
    df = df.withColumns({"_freed": freed, "_total": F.coalesce(total, F.lit(0.0)), "_many": many})
    more = F.when(F.col("_freed") <= 0, 0.0).when(F.col("_total") > 0, F.col("_freed") * F.col("score") / F.col("_total")).otherwise(F.col("_freed") / F.nullif(F.col("_many"), F.lit(0)))
    attacker = F.col("_active") & (F.col("giver") != F.col("_victim"))
    new = F.when(F.col("recipient") == F.col("_victim"), 0.0).when(_own(), F.col("score")).otherwise(F.col("score") + more)
    return _done(df, F.when(attacker, new).otherwise(F.col("score")), ratings.columns)


def _order(seed: int, keys: list[str], *cols: str) -> Column:
    """A hash that orders rows at random, the same for a seed on every engine that has MD5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in (*keys, *cols))))


def single_outlier(ratings: DataFrame, seed: int = 0, keys: list[str] = KEYS) -> DataFrame:
    """One rater, chosen by the seed, has the scores for the others shuffled and none for the own self. With a key
    ``perm`` among ``keys`` each permutation chooses anew. Teams without raters are left out (``failures`` names them)."""
    df = _with_raters(ratings, keys).where("_raters >= 1").withColumn("_by", _order(seed, keys, "giver"))
    chosen = F.min(F.when(F.col("_active"), F.struct("_by", "giver"))).over(Window.partitionBy(*keys))["giver"]
    df = df.withColumn("_out", F.col("giver") == chosen)
    peer = df.where(F.col("_out") & ~_own())
    by_giver = Window.partitionBy(*keys, "giver")
    at = peer.select(*keys, "giver", "recipient", F.row_number().over(by_giver.orderBy("recipient")).alias("_k"))
    dealt = peer.select(*keys, "giver", F.col("score").alias("_new"), F.row_number().over(by_giver.orderBy(_order(seed, keys, "giver", "recipient"), "recipient")).alias("_k"))
    new = at.join(dealt, [*keys, "giver", "_k"]).drop("_k")
    df = df.join(new, [*keys, "giver", "recipient"], "left")
    return _done(df, F.when(F.col("_out"), F.col("_new")).otherwise(F.col("score")), ratings.columns)


def outliers_in_tasks(teams: DataFrame | models.Teams, seed: int = 0, keys: list[str] = KEYS) -> DataFrame:
    """(keys, giver, recipient, score): ``single_outlier`` of packed teams, or of teams that are made here. A team's scores are dealt and unpacked in its
    task, so no ratings are shuffled, joined or written."""
    columns = "giver string, recipient string, score double"
    schema = ", ".join(f"`{k}` string" for k in keys) + ", " + columns
    labels = [*keys, *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in models.gathered(batches):
            named = [[str(seed), *(v for v in row if v is not None)] for row in zip(*(batch.column(k).to_pylist() for k in keys))]
            ids, known = ["|".join(row) for row in named], np.ones(batch.num_rows, bool)
            ends, nameless = batch.column("emails").value_lengths().to_numpy(zero_copy_only=False), batch.column("emails").flatten().is_null().to_numpy(zero_copy_only=False)
            known[np.repeat(np.arange(batch.num_rows), ends)[nameless]] = False
            for part, stack in models.stacks(batch):
                fits = known[part] & kernel.active(stack).any(axis=1)
                part, stack, n = part[fits], stack[fits], stack.shape[1]
                if not len(part):
                    continue
                emails = batch.column("emails").take(pa.array(part))
                out = kernel.single_outlier(stack, [ids[k] for k in part.tolist()], emails.to_pylist(), None).ravel()
                team, r, g = (v.ravel() for v in np.indices((len(part), n, n)))
                own, names = batch.select(keys).take(pa.array(part[team])), emails.flatten()
                yield pa.RecordBatch.from_arrays([*own.columns, names.take(pa.array(team * n + g)), names.take(pa.array(team * n + r)), pa.array(out, mask=np.isnan(out))], names=labels)
            whole = batch.column("arcs").is_null().to_numpy(zero_copy_only=False)
            for k in np.flatnonzero(~(whole & known)).tolist():  # no matrices, or members without a name, who are dealt nothing
                emails, cells = batch.column("emails")[k].as_py(), batch.column("arcs")[k].as_py()
                if cells is None:
                    scores = batch.column("cells")[k].as_py()
                    cells = [{"recipient": r, "giver": g, "score": scores[i * len(emails) + j]} for i, r in enumerate(emails) for j, g in enumerate(emails)]
                new = kernel.outlier_of_cells([(c["giver"], c["recipient"], c["score"]) for c in cells], ids[k])
                own = batch.select(keys).take(pa.array(np.full(len(new), k)))
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array([c[i] for c in new], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.float64())))], names=labels)

    return teams.in_tasks(run, schema) if isinstance(teams, models.Teams) else models.as_packed(teams, keys).mapInArrow(run, schema)


def strategic_silence(ratings: DataFrame, rater_rank: int = 1, keys: list[str] = KEYS) -> DataFrame:
    """One rater submits nothing."""
    df = _with_raters(ratings, keys)
    return _done(df, F.when(F.col("_rank") == rater_rank, F.lit(None).cast("double")).otherwise(F.col("score")), ratings.columns)


def sabotage_of_the_best(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The down-vote aimed at whoever has the highest baseline; of equal ones the first by e-mail."""
    best = models.baseline(ratings, keys).where("iwf is not null").groupBy(*keys).agg(F.min(F.struct((-F.col("iwf")).alias("x"), "email"))["email"].alias("_best"))
    out = targeted_downvote(ratings.join(best, keys), F.col("_best"), keys)
    return out.select(ratings.columns)


def fixed_budget(ratings: DataFrame, pool: float, keys: list[str] = KEYS) -> DataFrame:
    """Scale what each rater gives to a fixed pool; raters without a positive sum are an error, and raise."""
    total = F.sum("score").over(Window.partitionBy(*keys, "giver"))
    fine = F.when(total > 0, F.col("score") * pool / total).when(total.isNotNull(), F.raise_error(F.concat(F.lit("no positive points from "), F.col("giver"))).cast("double"))
    return ratings.withColumn("score", fine).select(ratings.columns)


#: How many active raters a perturbation needs, and what is said of teams with fewer.
NEEDS: dict[str, tuple[int, str]] = {
    "zero_self_full": (2, "fewer than two active raters"),
    "zero_self_partial": (2, "fewer than two active raters"),
    "targeted_downvote": (1, "no active rater"),
    "single_outlier": (1, "no active rater"),
}


def failures(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, variant, error): the teams that a perturbation can't be applied to. Its transform leaves them out."""
    if "cells" in ratings.columns:
        givers = F.filter(F.transform("cells", lambda s, i: F.when(s.isNotNull(), i % F.col("n"))), lambda j: j.isNotNull())
        arcs = F.transform(F.filter("arcs", lambda x: x["score"].isNotNull()), lambda x: x["giver"])
        teams = ratings.select(*keys, F.coalesce(F.size(F.array_distinct(F.when(F.col("arcs").isNotNull(), arcs))), F.size(F.array_distinct(givers))).alias("raters"))
    else:
        given = ratings.groupBy(*keys, "giver").agg((F.count("score") > 0).alias("active"))
        teams = given.groupBy(*keys).agg(F.count_if("active").alias("raters"))
    needs = F.array(*(F.struct(F.lit(v).alias("variant"), F.lit(n).alias("least"), F.lit(e).alias("error")) for v, (n, e) in NEEDS.items()))
    return teams.withColumn("need", F.explode(needs)).where("raters < need.least").select(*keys, "need.variant", "need.error")


PERTURBATIONS: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {}


def register_perturbation(name: str, fn: Callable[[DataFrame, list[str]], DataFrame]) -> None:
    PERTURBATIONS[name] = fn


register_perturbation("uniform_inflation", lambda r, k: uniform_inflation(r, k))
register_perturbation("zero_self_full", lambda r, k: zero_self(r, keys=k))
register_perturbation("zero_self_partial", lambda r, k: zero_self(r, colluders=2, keys=k))
register_perturbation("targeted_downvote", lambda r, k: targeted_downvote(r, keys=k))


#: Whose transforms ``packed_runs`` knows, too.
BUILT_IN = dict(PERTURBATIONS)


def variants(ratings: DataFrame, n_perms: int = 0, seed: int = 0, keys: list[str] = KEYS, names: tuple[str, ...] | None = None) -> DataFrame:
    """The clean ratings, each registered perturbation (those named), and ``n_perms`` permutations, under the keys variant and perm."""
    cols = [*keys, "giver", "recipient", "score"]
    slim = ratings.select(cols)
    tag = lambda df, name: df.select(*cols, F.lit(name).alias("variant"), F.lit(0).alias("perm"))
    out = tag(slim, "clean")
    for name, fn in PERTURBATIONS.items():
        if names is None or name in names:
            out = out.unionByName(tag(fn(slim, keys), name))
    if n_perms:
        many = slim.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_perms))))
        shuffled = single_outlier(many, seed, [*keys, "perm"])
        out = out.unionByName(shuffled.select(*cols, F.lit("single_outlier").alias("variant"), "perm"))
    return out


RUN = ("variant string", "perm int", "model string", "error string", "iterations int", "converged boolean", "delta double")


SUMMARY = ("variant string", "model string", "n_perms long", "mean_delta double", "std_delta double", "min_delta double", "max_delta double", "non_converged long", "mean_iterations double", "max_iterations int", "converged_all boolean")


def packed_runs(ratings: DataFrame, n_perms: int = 0, names: tuple[str, ...] = models.NAMES, seed: int = 0, keys: list[str] = KEYS, summed: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """What ``deltas`` gives for the scores of ``variants``, for complete teams. A team is packed once; its variants and permutations
    are made in the task, as stacks of matrices, and every model runs over all of them together: one shuffle for all.
    ``summed``: instead what ``summaries`` makes of it, one row a team, variant and model, so that no permutation leaves the task.
    ``only``: the variants that are asked for; others aren't run."""
    packed = models.as_packed(ratings, keys).select(*keys, "n", "emails", "cells", "arcs")
    if n_perms:  # much work for few bytes: more tasks than there are partitions, whatever the bytes say, as some take longer
        # equal teams meet, and have most of their matrices in common
        alike = F.xxhash64("n", "cells")
        packed = packed.repartition(4 * int(ratings.sparkSession.conf.get("spark.sql.shuffle.partitions")), alike).sortWithinPartitions(alike)
    packed = packed.withColumn("_id", F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))
    types = {f.name: f.dataType.simpleString() for f in packed.schema}
    columns_ = SUMMARY if summed else RUN
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + ", ".join(columns_)
    labels = [*keys, *(c.split()[0] for c in columns_)]

    def rows(batch: pa.RecordBatch, part: np.ndarray, emails: list[list[str]], variant: str, perms: list[int], model: str, solved: tuple, clean: tuple, fits: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        """One row a team and permutation, of the teams that fit the variant; ``at`` (teams, permutations): which of the solved it is."""
        iwf, _, converged, rounds, _, fail = solved
        (b, p), base = at.shape, clean[0][fits]
        owner = np.zeros(len(iwf), np.int64)
        owner[at.ravel()] = np.repeat(np.arange(b), p)
        far = kernel.distance(iwf, base[owner], fail >= 0, (clean[5][fits] >= 0)[owner])[at]
        fail, rounds, converged = fail[at], rounds[at], converged[at]
        if summed:
            fine = (fail < 0).any(axis=1)
            numbers = kernel.summary(far[fine], fail[fine] < 0, rounds[fine], converged[fine])
            taken = batch.select(keys).take(pa.array(part[fits[fine]]))
            many = len(taken)
            return pa.RecordBatch.from_arrays([*taken.columns, pa.array([variant] * many, pa.string()), pa.array([model] * many, pa.string()), *numbers], names=labels)
        texts = [None if f < 0 else models.failure(model, emails[k], f) for k, many in zip(fits.tolist(), fail.tolist()) for f in many]
        idle = (rounds == 0).ravel()
        taken = batch.select(keys).take(pa.array(np.repeat(part[fits], p)))
        columns = [taken.column(k) for k in keys] + [
            pa.array([variant] * (b * p)),
            pa.array(np.tile(np.array(perms, np.int32), b)),
            pa.array([model] * (b * p)),
            pa.array(texts, pa.string()),
            pa.array(rounds.ravel().astype(np.int32), mask=idle),
            pa.array([None if i else bool(c) for c, i in zip(converged.ravel().tolist(), idle.tolist())], pa.bool_()),
            pa.array(far.ravel(), mask=np.isnan(far.ravel())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in models.gathered(batches):
            for part, stack in models.stacks(batch, 1 + n_perms):
                emails, ids = batch.column("emails").take(pa.array(part)).to_pylist(), batch.column("_id").take(pa.array(part)).to_pylist()
                raters = kernel.active(stack).sum(axis=1)
                clean = models.solve_distinct(stack, names)
                for variant, (fn, least) in kernel.VARIANTS.items():
                    if only is not None and variant not in only:
                        continue
                    fits = np.flatnonzero(raters >= least)
                    found = models.solve_distinct(fn(stack[fits]), names) if len(fits) else {}
                    for m in found:
                        yield rows(batch, part, emails, variant, [0], m, found[m], clean[m], fits, np.arange(len(fits))[:, None])
                fits = np.flatnonzero(raters >= 1)
                if n_perms and len(fits) and (only is None or "single_outlier" in only):
                    perms = list(range(1, n_perms + 1))
                    moved, at = kernel.dealt(stack[fits], [ids[k] for k in fits], [emails[k] for k in fits], perms)
                    found = models.solve_all(moved, names)
                    for m in names:
                        yield rows(batch, part, emails, "single_outlier", perms, m, found[m], clean[m], fits, at)

    return packed.mapInArrow(run, schema)


def summaries(deltas_: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row a team, variant and model that has runs without an error: over its permutations (one, if it has none) mean, deviation and range
    of the delta, and how the iterations went."""
    return deltas_.where("error is null").groupBy(*keys, "variant", "model").agg(
        F.count("delta").alias("n_perms"),
        F.avg("delta").alias("mean_delta"),
        F.stddev_pop("delta").alias("std_delta"),
        F.min("delta").alias("min_delta"),
        F.max("delta").alias("max_delta"),
        F.count_if(~F.col("converged")).alias("non_converged"),
        F.avg("iterations").alias("mean_iterations"),
        F.max("iterations").alias("max_iterations"),
        F.min("converged").alias("converged_all"),
    )


class Summed(tuple):
    """Names of models of whose runs only ``summaries`` are asked: ``runs`` makes these inside of packed teams wherever it can."""


def team_summaries(ratings: DataFrame, n_perms: int = 0, names: tuple[str, ...] = models.NAMES, **more) -> DataFrame:
    """``summaries`` of ``runs``."""
    return runs(ratings, n_perms, Summed(names), **more)


def runs(ratings: DataFrame, n_perms: int = 0, names: tuple[str, ...] = models.NAMES, seed: int = 0, keys: list[str] = KEYS, most: int = PACKED_MEMBERS, only: tuple[str, ...] | None = None) -> DataFrame:
    """(keys, variant, perm, model, delta, error, iterations, converged) of every registered perturbation and ``n_perms`` permutations.

    The built-in ones run in packed teams; larger and incomplete teams, registered perturbations and registered models take the
    way over tables. ``ratings`` should be a table, as it is read for both. ``only``: the caller asks for no other variants; tables may have them."""
    if isinstance(names, Summed):
        names = tuple(names)
        if any(BUILT_IN.get(v) is not fn for v, fn in PERTURBATIONS.items()) or any(m not in models.STACKED or m in models.REPLACED for m in names):
            return summaries(runs(ratings, n_perms, names, seed, keys, most), keys)
        small, large = split_by_size(ratings, most, keys)
        out = packed_runs(small, n_perms, names, seed, keys, summed=True, only=only)
        return out if large.isEmpty() else out.unionByName(summaries(runs(large, n_perms, names, seed, keys, most), keys))
    columns = [*keys, "variant", "perm", "model", "delta", "error", "iterations", "converged"]
    tables = lambda df, perms, which: deltas(written(models.score(variants(df, perms, seed, keys, which), names, [*keys, "variant", "perm"]), "scores"), keys).select(columns)
    if any(m not in models.STACKED or m in models.REPLACED for m in names):  # models of one's own
        return tables(ratings, n_perms, None)
    small, large = split_by_size(ratings, most, keys)
    out = packed_runs(small, n_perms, names, seed, keys, only=only).select(columns)
    own = tuple(v for v, fn in PERTURBATIONS.items() if BUILT_IN.get(v) is not fn)
    if own:
        out = out.where(~F.col("variant").isin(*own)).unionByName(tables(small, 0, own))
    return out if large.isEmpty() else out.unionByName(tables(large, n_perms, None))


def deltas(iwf: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, variant, perm, model, delta, error): mean distance of the scores from those of the clean ratings, over members
    with both; ``iwf`` is the score of ``variants``. Variants whose members aren't those of the clean ratings are an error."""
    run = [*keys, "variant", "perm", "model"]
    status = iwf.groupBy(*run).agg(F.max("error").alias("error"), F.max("iterations").alias("iterations"), F.max("converged").alias("converged"), F.count("email").alias("_n"))
    clean = iwf.where("variant = 'clean'").select(*keys, "email", "model", F.col("iwf").alias("clean"), F.count("email").over(Window.partitionBy(*keys, "model")).alias("_clean"))
    far = iwf.where("variant <> 'clean'").join(clean, [*keys, "email", "model"]).groupBy(*run).agg(F.avg(F.abs(F.col("iwf") - F.col("clean"))).alias("delta"), F.count("*").alias("_both"), F.max("_clean").alias("_clean"))
    out = status.where("variant <> 'clean'").join(far, run, "left")
    # where nothing failed, all members of both meet
    differ = F.col("error").isNull() & ((F.coalesce("_both", F.lit(0)) != F.col("_n")) | (F.coalesce("_clean", F.lit(0)) != F.col("_n")))
    return out.withColumns({"error": F.when(differ, "members differ").otherwise(F.col("error")), "delta": F.when(~differ, F.col("delta"))}).drop("_n", "_both", "_clean")


def _summed(deltas_: DataFrame, keys: list[str]) -> DataFrame:
    return deltas_ if "mean_delta" in deltas_.columns else summaries(deltas_, keys)


def permutation_robustness(deltas_: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Over the permutations of each team (its runs, or their ``summaries``): mean, deviation and range of the delta, and how the iterations went."""
    return _summed(deltas_, keys).where("variant = 'single_outlier'").drop("variant")


def attack_summary(deltas_: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(variant, model, mean_delta, n, mc_std): means over teams; permutations of a team count as one, by their mean."""
    team = _summed(deltas_, keys).select("variant", "model", F.col("mean_delta").alias("delta"), F.when(F.col("n_perms") > 1, F.col("std_delta")).alias("std"))
    return team.where("delta is not null").groupBy("variant", "model").agg(F.avg("delta").alias("mean_delta"), F.count("*").alias("n"), F.avg("std").alias("mc_std"))


def robustness_matrix(summary: DataFrame, names: tuple[str, ...] = models.NAMES) -> DataFrame:
    """One row a perturbation, a column a model."""
    return summary.groupBy("variant").pivot("model", list(names)).agg(F.first("mean_delta")).orderBy("variant")


def recovery_error(iwf: DataFrame, truth: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean distance of the scores from a known truth (keys, email, truth), scaled to a mean of 10 by team."""
    scaled = truth.withColumn("truth", F.col("truth") * 10 / F.avg("truth").over(Window.partitionBy(*keys)))
    return iwf.join(scaled, [*keys, "email"]).groupBy(*keys, "model").agg(F.avg(F.abs(F.col("iwf") - F.col("truth"))).alias("error"))
