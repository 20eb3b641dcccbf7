"""Comparison of models: rank reversals, cross-model delta, side-by-side tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingscope.operators.models import NAMES
from ratingscope.schema import KEYS


def mismatched_members(a: DataFrame, b: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Members that only one of two results has: to be compared, results must have the same."""
    x, y = a.select(*keys, "email").distinct(), b.select(*keys, "email").distinct()
    only = lambda p, q, side: p.join(q, [*keys, "email"], "left_anti").withColumn("only_in", F.lit(side))
    return only(x, y, "first").unionByName(only(y, x, "second"))


def with_same_members(iwf: DataFrame, base: str = "baseline", keys: list[str] = KEYS) -> DataFrame:
    """``iwf``, raising an error where a run that didn't fail has not exactly the members of the base model's run."""
    names = F.array_sort(F.collect_set(F.when(F.col("error").isNull(), F.col("email"))))
    runs = iwf.groupBy(*keys, "model").agg(names.alias("_names"))
    first = runs.where(F.col("model") == base).select(*keys, F.col("_names").alias("_base"))
    both = runs.join(first, keys).select(*keys, "model", ((F.size("_names") > 0) & (F.size("_base") > 0) & (F.col("_names") != F.col("_base"))).alias("_differ"))
    text = F.concat(F.lit("members differ between "), F.lit(base), F.lit(" and "), F.col("model"))
    checked = F.when(F.col("_differ"), F.raise_error(text).cast("double")).otherwise(F.col("iwf"))
    return iwf.join(both, [*keys, "model"], "left").withColumn("iwf", checked).select(iwf.columns)


def member_pairs(iwf: DataFrame, base: str = "baseline", keys: list[str] = KEYS) -> DataFrame:
    """Pairs of members of a team (email_a < email_b) with their scores under ``base`` and under each other model. Failed
    runs have no pairs."""
    fine = iwf.where("error is null").select(*keys, "email", "model", "iwf")
    first = fine.where(F.col("model") == base).select(*keys, "email", F.col("iwf").alias("base"))
    both = fine.where(F.col("model") != base).join(first, [*keys, "email"])
    a = both.select(*keys, "model", F.col("email").alias("email_a"), F.col("base").alias("base_a"), F.col("iwf").alias("adv_a"))
    b = both.select(*keys, "model", F.col("email").alias("email_b"), F.col("base").alias("base_b"), F.col("iwf").alias("adv_b"))
    return a.join(b, [*keys, "model"]).where("email_a < email_b")


def _judged(pairs: DataFrame, delta: float) -> DataFrame:
    """Adds eligible, reversed and the pair oriented by the base model, ties as they are. Differences count to nine digits, so
    that the order of additions decides nothing."""
    known = F.col("base_a").isNotNull() & F.col("base_b").isNotNull() & F.col("adv_a").isNotNull() & F.col("adv_b").isNotNull()
    up = F.col("base_a") >= F.col("base_b")
    base = F.abs(F.col("base_a") - F.col("base_b"))
    adv = F.when(up, F.col("adv_a") - F.col("adv_b")).otherwise(F.col("adv_b") - F.col("adv_a"))
    out = pairs.withColumns({"base_diff": base, "adv_diff": adv, "higher": F.when(up, F.col("email_a")).otherwise(F.col("email_b")), "lower": F.when(up, F.col("email_b")).otherwise(F.col("email_a"))})
    eligible = F.coalesce(known & (F.round("base_diff", 9) >= delta), F.lit(False))
    return out.withColumn("eligible", eligible).withColumn("reversed", F.col("eligible") & (F.round("adv_diff", 9) < 0))


def reversal_pairs(iwf: DataFrame, delta: float = 1.5, base: str = "baseline", keys: list[str] = KEYS) -> DataFrame:
    """Pairs that the base model sets ``delta`` or more apart and another model puts the other way round."""
    rows = _judged(member_pairs(iwf, base, keys), delta).where("reversed")
    return rows.select(*keys, "model", "higher", "lower", "base_diff", "adv_diff", (F.col("base_diff") + F.abs("adv_diff")).alias("magnitude"))


def reversal_detail(iwf: DataFrame, delta: float = 1.5, base: str = "baseline", keys: list[str] = KEYS) -> DataFrame:
    """The same, largest magnitude first."""
    return reversal_pairs(iwf, delta, base, keys).orderBy(F.desc("magnitude"), *keys, "model", "higher", "lower")


#: Teams of so many members are compared pair by pair, as stacks; larger ones by counting.
PAIRWISE_MEMBERS = 64
#: Half of the ninth digit, up to which differences count.
_HALF = 5e-10


def _pairwise(base: np.ndarray, adv: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray]:
    """Of stacks (teams, members): reversed and eligible pairs."""
    eligible = (base[:, :, None] - base[:, None, :] >= delta - _HALF) & ~np.isnan(adv[:, :, None] - adv[:, None, :])
    return (eligible & (adv[:, :, None] - adv[:, None, :] <= -_HALF)).sum(axis=(1, 2)), eligible.sum(axis=(1, 2))


def counted_reversals(base: np.ndarray, adv: np.ndarray, delta: float) -> tuple[int, int]:
    """The same for one team of n members in n log n steps. By ascending base, a member's eligible partners are a growing beginning of
    the order; a binary indexed tree over the ranks of ``adv`` says how many of them the other model puts above."""
    known = ~np.isnan(base) & ~np.isnan(adv)
    base, adv = base[known], adv[known]
    order = np.argsort(base, kind="stable")
    base, adv = base[order], adv[order]
    partners, ranks = np.searchsorted(base, base - (delta - _HALF), side="right"), np.sort(adv)
    place, least = (np.searchsorted(ranks, adv) + 1).tolist(), np.searchsorted(ranks, adv + _HALF).tolist()
    n, tree, added, out = len(base), [0] * (len(base) + 1), 0, 0
    for stop, below in zip(partners.tolist(), least):
        while added < stop:
            k, added = place[added], added + 1
            while k <= n:
                tree[k] += 1
                k += k & -k
        out += added
        k = below  # members whose rank is less aren't above
        while k:
            out -= tree[k]
            k -= k & -k
    return out, int(partners.sum())


def reversal_summary(iwf: DataFrame, delta: float = 1.5, base: str = "baseline", keys: list[str] = KEYS, pairwise: int = PAIRWISE_MEMBERS) -> DataFrame:
    """(keys, model, reversed, eligible, pairs, rate) by team; the rate is 0 without eligible pairs. Pairs are counted, not listed: a
    team's scores come to a task as one row. ``delta`` must be positive."""
    if delta <= 0:
        raise ValueError("delta must be positive")
    fine = iwf.where("error is null").groupBy(*keys).agg(F.collect_list(F.struct("email", "model", "iwf")).alias("s"))
    types = {f.name: f.dataType.simpleString() for f in fine.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", model string, reversed long, eligible long, pairs long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lists = batch.column("s").flatten(), batch.column("s")
            team = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            codes = [pc.dictionary_encode(rows.field(c)) for c in ("email", "model")]
            (email, _), (model, models) = ((c.indices.to_numpy(), c.dictionary.to_pylist()) for c in codes)
            value = rows.field("iwf").to_numpy(zero_copy_only=False).astype(float)
            of_base = model == (models.index(base) if base in models else -1)
            member = team * (int(email.max(initial=0)) + 1) + email
            order = np.argsort(member[of_base])
            there, known = member[of_base][order], value[of_base][order]
            at = np.minimum(np.searchsorted(there, member), max(len(there) - 1, 0))
            both = ~of_base & (there[at] == member) if len(there) else np.zeros(len(member), bool)
            run_ = team[both] * len(models) + model[both]
            order = np.argsort(run_, kind="stable")
            first, adv = known[at[both]][order], value[both][order]
            runs, starts, sizes = np.unique(run_[order], return_index=True, return_counts=True)
            backward, eligible = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
            for n in np.unique(sizes).tolist():
                same = np.flatnonzero(sizes == n)
                for part in np.array_split(same, max(1, len(same) * n * n // 2_000_000)) if n <= pairwise else ():
                    cells = starts[part][:, None] + np.arange(n)
                    backward[part], eligible[part] = _pairwise(first[cells], adv[cells], delta)
                for k in same.tolist() if n > pairwise else ():
                    backward[k], eligible[k] = counted_reversals(first[starts[k] : starts[k] + n], adv[starts[k] : starts[k] + n], delta)
            some = sizes >= 2
            teams = batch.select(keys).take(pa.array(runs[some] // max(len(models), 1)))
            names = pa.array([models[k] for k in (runs[some] % max(len(models), 1)).tolist()], pa.string())
            numbers = (backward[some], eligible[some], (sizes * (sizes - 1) // 2)[some])
            yield pa.RecordBatch.from_arrays([*teams.columns, names, *(pa.array(x) for x in numbers)], names=[*keys, "model", "reversed", "eligible", "pairs"])

    return fine.mapInArrow(run, schema).withColumn("rate", F.coalesce(F.try_divide("reversed", "eligible"), F.lit(0.0)))


def reversal_aggregate(summary: DataFrame) -> DataFrame:
    """By model: the mean rate over teams that have eligible pairs, and the rate of all pairs together."""
    out = summary.groupBy("model").agg(
        F.coalesce(F.avg(F.when(F.col("eligible") > 0, F.col("rate"))), F.lit(0.0)).alias("mean_rate"),
        F.sum("reversed").alias("reversed"),
        F.sum("eligible").alias("eligible"),
        F.sum("pairs").alias("pairs"),
        F.count_if(F.col("eligible") > 0).alias("teams_with_eligible"),
        F.count("*").alias("teams"),
    )
    return out.withColumn("pooled_rate", F.coalesce(F.try_divide("reversed", "eligible"), F.lit(0.0)))


def cross_model_delta(iwf: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, delta): mean over members of the population deviation of their scores across models; members with fewer than
    two scores are skipped, teams without others have 0."""
    member = iwf.groupBy(*keys, "email").agg(F.stddev_pop("iwf").alias("spread"), F.count("iwf").alias("n"))
    return member.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("n") >= 2, F.col("spread"))), F.lit(0.0)).alias("delta"))


def pair_delta(iwf: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, model_a, model_b, delta): mean absolute difference of two models, by team."""
    s = iwf.where("iwf is not null").select(*keys, "email", "model", "iwf")
    a = s.withColumnsRenamed({"model": "model_a", "iwf": "iwf_a"})
    b = s.withColumnsRenamed({"model": "model_b", "iwf": "iwf_b"})
    pairs = a.join(b, [*keys, "email"]).where("model_a < model_b")
    return pairs.groupBy(*keys, "model_a", "model_b").agg(F.avg(F.abs(F.col("iwf_a") - F.col("iwf_b"))).alias("delta"))


def side_by_side(iwf: DataFrame, models: tuple[str, ...] = NAMES, keys: list[str] = KEYS) -> DataFrame:
    """One row a member, a column a model, and the largest distance from 10."""
    wide = iwf.groupBy(*keys, "email").pivot("model", list(models)).agg(F.first("iwf"))
    far = [F.abs(F.col(f"`{m}`") - 10) for m in models]
    return wide.withColumn("max_delta", F.greatest(*far) if len(far) > 1 else far[0])


def results(iwf: DataFrame, ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The result rows of a run: members and their scores with what is known of the session, sorted by team and question."""
    session = ratings.groupBy(*keys).agg(*(F.first(c).alias(c) for c in ("year", "semester", "session_number")))
    rows = iwf.where("error is null").join(session, keys)
    cols = ["csv_path", F.concat_ws("-", "semester", "year").alias("session"), "team", "question", "email", "model", F.bround("iwf", 4).alias("iwf"), "converged", "iterations", "final_l1"]
    return rows.select(*cols).orderBy("team", "question", "csv_path", "model", "email")


def banded(iwf: DataFrame) -> DataFrame:
    """Adds the band that a score falls into."""
    x = F.col("iwf")
    return iwf.withColumn("band", F.when(x.isNull(), "none").when(x <= 7, "low").when(x <= 8.5, "below").when(x <= 11.5, "normal").when(x <= 13, "above").otherwise("high"))


def grades(iwf: DataFrame, group_grade: float) -> DataFrame:
    """Individual grades: the group's grade times the weighting factor."""
    return iwf.withColumn("grade", F.col("iwf") / 10 * group_grade)


def aligned_with(iwf: DataFrame, other: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Correlation by model of the scores with an external number of each member (keys, email, value)."""
    from ratingscope.schema import pearson

    s = iwf.join(other, [*keys, "email"]).where("iwf is not null and value is not null")
    x, y = F.col("iwf"), F.col("value")
    sums = s.groupBy("model").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    return sums.select("model", "n", pearson(*(F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))).alias("r"))
