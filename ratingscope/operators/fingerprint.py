"""Structural fingerprint of a team: 25 numbers from who rated whom.

Complete teams of up to ``PACKED_MEMBERS`` are packed into rows, one shuffle for all 25, and computed as stacks of matrices.
Larger and incomplete teams are joins and groupings over the scores that there are: the pairs that rated each other, and the
triangles among linked pairs, from which the triad census and clustering follow; triples that aren't closed are counted,
never listed. So their work grows with the scores times the root of their number, not with the cube of the team.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingscope.operators import inside, members, team_kernel
from ratingscope.operators.models import NAMES, PACKED_MEMBERS, Teams, as_packed, gathered, solved, split_by_size, stacks, unpacked
from ratingscope.schema import KEYS, pearson
from ratingscope.shared import written

TRIADS = ("003", "012", "102", "021D", "021U", "021C", "111D", "111U", "030T", "030C", "201", "120D", "120U", "120C", "210", "300")
BEHAVIOUR = ("reciprocity", "gini_in_degree", "mean_rater_std", "std_rater_std", "asymmetry", "clustering", "assortativity", "non_submitter_frac", "mean_self_share")
FEATURES = BEHAVIOUR + tuple(f"triad_{t}" for t in TRIADS)


def edges(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, giver, recipient, weight): the scores that members have given each other."""
    return ratings.where("score is not null and giver <> recipient").select(*keys, "giver", "recipient", F.col("score").alias("weight"))


def degrees(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, email, in_weight, out_weight): points received from and given to others; 0 for none."""
    m, e = members.members(ratings, keys).drop("idx"), edges(ratings, keys)
    got = e.groupBy(*keys, F.col("recipient").alias("email")).agg(F.sum("weight").alias("in_weight"))
    gave = e.groupBy(*keys, F.col("giver").alias("email")).agg(F.sum("weight").alias("out_weight"))
    return m.join(got, [*keys, "email"], "left").join(gave, [*keys, "email"], "left").fillna(0.0, ["in_weight", "out_weight"])


def scaled_edges(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Edges with their weight scaled to [0, 1] within the team; equal weights are 0.5."""
    w = Window.partitionBy(*keys)
    low, high = F.min("weight").over(w), F.max("weight").over(w)
    return edges(ratings, keys).withColumn("scaled", F.coalesce(F.try_divide(F.col("weight") - low, high - low), F.lit(0.5)))


# ---------------------------------------------------------------- pairs


def _pairs(ratings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, ab, ba): members a < b with what each gave the other."""
    e = edges(ratings, keys)
    a, b = F.least("giver", "recipient"), F.greatest("giver", "recipient")
    up = F.col("giver") < F.col("recipient")
    return e.groupBy(*keys, a.alias("a"), b.alias("b")).agg(F.max(F.when(up, F.col("weight"))).alias("ab"), F.max(F.when(~up, F.col("weight"))).alias("ba"))


def pair_features(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, reciprocity, asymmetry), over the pairs that rated each other. Reciprocity depends on the order of the members,
    which is by e-mail."""
    p = _pairs(ratings, keys).where("ab is not null and ba is not null")
    x, y = F.col("ab"), F.col("ba")
    sums = (F.count("*"), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y))
    # a pair stands for two ordered ones, which doubles both sums under the roots
    asymmetry = F.sqrt(2 * F.sum((x - y) ** 2)) / (F.sqrt(2 * F.sum((x + y) ** 2)) + 1e-9)
    return p.groupBy(*keys).agg(pearson(*sums).alias("reciprocity"), asymmetry.alias("asymmetry"))


def gini(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, gini_in_degree) of the mean scores received from others."""
    mean = edges(ratings, keys).groupBy(*keys, "recipient").agg(F.avg("weight").alias("v"))
    ranked = mean.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("v")))
    n, total = F.count("*"), F.sum("v")
    value = (2 * F.sum(F.col("r") * F.col("v")) - (n + 1) * total) / F.nullif(n * total, F.lit(0))
    return ranked.groupBy(*keys).agg(F.coalesce(value, F.lit(0.0)).alias("gini_in_degree"))


def rater_spread(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, mean_rater_std, std_rater_std): of the raters' deviations, for raters of two others or more."""
    each = edges(ratings, keys).groupBy(*keys, "giver").agg(F.stddev_pop("weight").alias("s"), F.count("*").alias("n")).where("n >= 2")
    return each.groupBy(*keys).agg(F.avg("s").alias("mean_rater_std"), F.stddev_pop("s").alias("std_rater_std"))


def submission(ratings: DataFrame, pool: float = 60.0, keys: list[str] = KEYS) -> DataFrame:
    """(keys, n_students, non_submitter_count, non_submitter_frac, mean_self_share); the share is of a fixed pool."""
    given = F.count("score").over(Window.partitionBy(*keys, "giver"))
    own = ratings.withColumn("_given", given).where("giver = recipient")
    silent = F.count_if(F.col("_given") == 0)
    return own.groupBy(*keys).agg(F.count("*").cast("int").alias("n_students"), silent.cast("int").alias("non_submitter_count"), (silent / F.count("*")).alias("non_submitter_frac"), F.coalesce(F.avg(F.col("score") / pool), F.lit(0.0)).alias("mean_self_share"))


def assortativity(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, assortativity): over the edges, the correlation of how many others the giver rated with how many rated the
    recipient."""
    e = edges(ratings, keys)
    e = e.withColumns({"x": F.count("*").over(Window.partitionBy(*keys, "giver")).cast("double"), "y": F.count("*").over(Window.partitionBy(*keys, "recipient")).cast("double")})
    x, y = F.col("x"), F.col("y")
    return e.groupBy(*keys).agg(pearson(F.count("*"), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y)).alias("assortativity"))


# ---------------------------------------------------------------- triples


def above_mean(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, giver, recipient): who got more than the giver's mean for others."""
    e = edges(ratings, keys).withColumn("_mean", F.avg("weight").over(Window.partitionBy(*keys, "giver")))
    return e.where("weight > _mean").select(*keys, "giver", "recipient")


def _int(c: Column) -> Column:
    return c.cast("int")


def triad_class() -> Column:
    """The class of a triple from its six arcs up_xy (x to y) and down_xy (y to x). With mutual, one-way and empty pairs
    counted, most classes follow; the rest depends on where the one-way arcs point."""
    one, mutual = {}, {}
    for p in ("ab", "ac", "bc"):
        x, y = p
        up, down = F.col(f"up_{p}"), F.col(f"down_{p}")
        one[x, y], one[y, x] = _int(up & ~down), _int(down & ~up)
        mutual[p] = _int(up & down)
    out = {x: sum(v for (s, _), v in one.items() if s == x) for x in "abc"}
    into = {x: sum(v for (_, t), v in one.items() if t == x) for x in "abc"}
    apart = {"a": mutual["bc"], "b": mutual["ac"], "c": mutual["ab"]}  # 1: the other two are mutual
    m, a = sum(mutual.values()), sum(one.values())
    any_ = lambda f: reduce(lambda p, q: p | q, (f(x) for x in "abc"))
    third_gives = any_(lambda x: (apart[x] == 1) & (out[x] == a))
    third_gets = any_(lambda x: (apart[x] == 1) & (into[x] == a))
    two = F.when(any_(lambda x: out[x] == 2), "021D").when(any_(lambda x: into[x] == 2), "021U").otherwise("021C")
    return (
        F.when((m == 0) & (a == 0), "003")
        .when((m == 0) & (a == 1), "012")
        .when((m == 1) & (a == 0), "102")
        .when((m == 0) & (a == 2), two)
        .when((m == 1) & (a == 1), F.when(third_gives, "111D").otherwise("111U"))
        .when((m == 0) & (a == 3), F.when((out["a"] == 1) & (out["b"] == 1), "030C").otherwise("030T"))
        .when((m == 2) & (a == 0), "201")
        .when((m == 1) & (a == 2), F.when(third_gives, "120D").when(third_gets, "120U").otherwise("120C"))
        .when((m == 2) & (a == 1), "210")
        .otherwise("300")
    )


#: What a member sees at the centre of two pairs: kinds of the two (o: it gives, i: it gets, m: both) and the class if the third pair is empty.
WEDGES = {"021D": "oo", "021U": "ii", "021C": "oi", "111D": "mi", "111U": "mo", "201": "mm"}
#: Classes of three pairs, and how many of these go one way and both ways.
CLOSED = {"030T": (3, 0), "030C": (3, 0), "120D": (2, 1), "120U": (2, 1), "120C": (2, 1), "210": (1, 2), "300": (0, 3)}


def linked_pairs(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, a, b, ab, ba, up, down): members a < b of whom at least one scored the other, the scores, and whether these are
    above the giver's mean (up: a's for b). Pairs that aren't linked have no row."""
    e = edges(ratings, keys).withColumn("_above", F.col("weight") > F.avg("weight").over(Window.partitionBy(*keys, "giver")))
    first = F.col("giver") < F.col("recipient")
    mine = lambda c, side: F.max(F.when(side, F.col(c)))
    out = e.groupBy(*keys, F.least("giver", "recipient").alias("a"), F.greatest("giver", "recipient").alias("b"))
    return out.agg(mine("weight", first).alias("ab"), mine("weight", ~first).alias("ba"), F.coalesce(mine("_above", first), F.lit(False)).alias("up"), F.coalesce(mine("_above", ~first), F.lit(False)).alias("down"))


def triangles(pairs: DataFrame, values: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Triples of members all of whose pairs are among ``pairs`` (keys, a, b, values), each once: (keys, a, b, c, values_ab, values_ac,
    values_bc). Pairs point from the member with fewer pairs to the one with more, and only pairs that begin at one member are
    joined, of which a member has no more than the square root of twice the team's pairs, however popular it is.
    ``up`` and ``down``, if among the values, change places with the direction."""
    ends = pairs.select(*keys, F.explode(F.array("a", "b")).alias("email")).groupBy(*keys, "email").agg(F.count("*").alias("_deg"))
    for side in "ab":
        pairs = pairs.join(ends.withColumnsRenamed({"email": side, "_deg": f"_deg_{side}"}), [*keys, side])
    order = lambda x: F.struct(F.col(f"_deg_{x}").alias("d"), F.col(x).alias("e"))
    forth = order("a") < order("b")
    other = {"up": "down", "down": "up"}
    turned = pairs.select(*keys, F.when(forth, order("a")).otherwise(order("b")).alias("x"), F.when(forth, order("b")).otherwise(order("a")).alias("y"), *(F.when(forth, F.col(v)).otherwise(F.col(other.get(v, v))).alias(v) for v in values))
    side = lambda x, y: turned.select(*keys, F.col("x").alias(x), F.col("y").alias(y), *(F.col(v).alias(f"{v}_{x}{y}") for v in values))
    found = side("a", "b").join(side("a", "c"), [*keys, "a"]).where("b < c").join(side("b", "c"), [*keys, "b", "c"])
    return found.withColumns({x: F.col(x)["e"] for x in "abc"})


def census(pairs: DataFrame, sizes: DataFrame, closed: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, triad_003 .. triad_300) as shares of all triples, for teams of three or more, without a row for a triple that isn't
    closed. ``pairs``: linked_pairs; ``sizes`` (keys, n); ``closed``: triangles with up and down.

    Classes of three linked pairs are counted over the triangles. Those of two linked pairs are wedges: a member that gives o, gets
    i and has m both ways is the centre of so many of each kind, less those that a triangle closes. A linked pair meets n - 2
    thirds; what of these isn't in a triple counted so far is 012 or 102, and the rest of all triples is 003."""
    up, down = F.col("up"), F.col("down")
    sides = F.array(F.struct(F.col("a").alias("email"), up.alias("out"), down.alias("into")), F.struct(F.col("b").alias("email"), down.alias("out"), up.alias("into")))
    linked = pairs.where("up or down").select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
    kinds = {"o": F.count_if(F.expr("out and not into")), "i": F.count_if(F.expr("into and not out")), "m": F.count_if(F.expr("out and into"))}
    member = linked.groupBy(*keys, "email").agg(*(c.alias(k) for k, c in kinds.items()))
    several = {w: F.col(k[0]) * (F.col(k[0]) - 1) / 2 if k[0] == k[1] else F.col(k[0]) * F.col(k[1]) for w, k in WEDGES.items()}
    wedges = member.groupBy(*keys).agg(*(F.sum(c).alias(f"w_{w}") for w, c in several.items()), (F.sum(F.col("o") + F.col("i")) / 2).alias("one_way"), (F.sum("m") / 2).alias("both_ways"))
    three = closed.where("(up_ab or down_ab) and (up_ac or down_ac) and (up_bc or down_bc)").withColumn("class", triad_class())
    # the kinds of pairs at each corner, sorted
    kind = lambda out, into: F.when(F.col(out) & F.col(into), "m").when(F.col(out), "o").otherwise("i")
    corners = {"a": (kind("up_ab", "down_ab"), kind("up_ac", "down_ac")), "b": (kind("down_ab", "up_ab"), kind("up_bc", "down_bc")), "c": (kind("down_ac", "up_ac"), kind("down_bc", "up_bc"))}
    three = three.withColumns({f"corner_{x}": F.array_join(F.array_sort(F.array(*k)), "") for x, k in corners.items()})
    at = {w: sum(_int(F.col(f"corner_{x}") == "".join(sorted(k))) for x in "abc") for w, k in WEDGES.items()}
    counted = three.groupBy(*keys).agg(*(F.count_if(F.col("class") == c).alias(f"c_{c}") for c in CLOSED), *(F.sum(c).alias(f"x_{w}") for w, c in at.items()))
    t = sizes.where("n >= 3").join(wedges, keys, "left").join(counted, keys, "left").fillna(0)
    number = {c: F.col(f"c_{c}") for c in CLOSED} | {w: F.col(f"w_{w}") - F.col(f"x_{w}") for w in WEDGES}
    ways = CLOSED | {w: (sum(x != "m" for x in k), k.count("m")) for w, k in WEDGES.items()}
    for c, pairs_of, k in (("012", "one_way", 0), ("102", "both_ways", 1)):
        number[c] = F.col(pairs_of) * (F.col("n") - 2) - sum(number[x] * w[k] for x, w in ways.items())
    total = F.col("n").cast("double") * (F.col("n") - 1) * (F.col("n") - 2) / 6
    number["003"] = total - sum(number.values())
    return t.select(*keys, *((number[c] / total).alias(f"triad_{c}") for c in TRIADS))


def sparse_triples(ratings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, clustering, triad_003 .. triad_300) of teams of any size, as joins over the scores that there are. clustering: mean
    over all members of the directed weighted coefficient of Fagiolo (2007), weights as the cube root of their share of the team's largest."""
    sizes = members.members(ratings, keys).groupBy(*keys).agg(F.count("*").alias("n")).where("n >= 2")
    p = linked_pairs(ratings, keys)
    top = F.max(F.greatest(F.coalesce("ab", F.lit(0.0)), F.coalesce("ba", F.lit(0.0)))).over(Window.partitionBy(*keys))
    cube = lambda c: F.coalesce(F.cbrt(F.try_divide(F.col(c), F.col("_top"))), F.lit(0.0))
    p = p.withColumn("_top", top).withColumn("tie", cube("ab") + cube("ba"))
    arcs = _int(F.col("ab").isNotNull()) + _int(F.col("ba").isNotNull())
    ends = p.select(*keys, F.explode(F.array("a", "b")).alias("email"), arcs.alias("arcs"))
    degree = ends.groupBy(*keys, "email").agg(F.sum("arcs").alias("d"), F.count_if(F.col("arcs") == 2).alias("bi"))
    t = triangles(p.select(*keys, "a", "b", "up", "down", "tie"), ["up", "down", "tie"], keys)
    product = F.col("tie_ab") * F.col("tie_ac") * F.col("tie_bc")
    corner = t.select(*keys, product.alias("product"), F.explode(F.array("a", "b", "c")).alias("email")).groupBy(*keys, "email").agg(F.sum("product").alias("triangles"))
    # both sums over ordered pairs are twice those over triples, and the formula halves them
    node = degree.join(corner, [*keys, "email"]).withColumn("c", F.coalesce(F.try_divide("triangles", F.col("d") * (F.col("d") - 1) - 2 * F.col("bi")), F.lit(0.0)))
    local = sizes.join(node.groupBy(*keys).agg(F.sum("c").alias("c")), keys, "left")  # members without triangles count as 0
    clustering = local.select(*keys, F.coalesce(F.col("c") / F.col("n"), F.lit(0.0)).alias("clustering"))
    return clustering.join(census(p, sizes, t, keys), keys, "left")


# ---------------------------------------------------------------- whole teams at once

_PACKED = ("n_students", "non_submitter_count", *FEATURES)


def packed_features(ratings: DataFrame, pool: float = 60.0, keys: list[str] = KEYS, most: int = PACKED_MEMBERS) -> DataFrame:
    """(keys, n_students, non_submitter_count, the 25 features) of complete teams, NULL where a team has no pairs, raters or
    triples for a feature. One shuffle packs a team into a row; teams of one size are a stack of matrices in Arrow batches."""
    packed = as_packed(ratings, keys, most).select(*keys, "n", "emails", "cells", "arcs")
    types = {f.name: f.dataType.simpleString() for f in packed.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n_students int, non_submitter_count int, " + ", ".join(f"{f} double" for f in FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, stack in stacks(batch):
                found = team_kernel.features(stack, pool)
                rows = batch.select(keys).take(pa.array(part))
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in keys), *(pa.array(found[f], mask=np.isnan(found[f])) if f in FEATURES else pa.array(found[f].astype(np.int32)) for f in _PACKED)], names=[*keys, *_PACKED])

    return packed.mapInArrow(run, schema)


def triple_features(ratings: DataFrame, keys: list[str] = KEYS, most: int = PACKED_MEMBERS) -> DataFrame:
    """(keys, clustering, triad_003 .. triad_300) of teams of two or more, the triads NULL for two. ``ratings`` should be a table, as
    it is asked whether it has teams that aren't packed."""
    small, large = split_by_size(ratings, most, keys)
    out = packed_features(small, keys=keys).where("n_students >= 2").select(*keys, "clustering", *(f"triad_{t}" for t in TRIADS))
    return out if large.isEmpty() else out.unionByName(sparse_triples(large, keys))


def features(ratings: DataFrame, pool: float = 60.0, keys: list[str] = KEYS, most: int = PACKED_MEMBERS) -> DataFrame:
    """(keys, n_students, non_submitter_count, the 25 features). What a team has no pairs, raters or triples for is 0. ``ratings``
    should be a table, as it is asked whether it has teams that aren't packed."""
    small, large = split_by_size(ratings, most, keys)
    out = packed_features(small, pool, keys)
    if not large.isEmpty():
        out = out.unionByName(_joined(large, pool, keys))
    fill = {f: F.coalesce(F.col(f), F.lit(0.0)) for f in FEATURES}
    return out.select(*keys, "n_students", "non_submitter_count", *(c.alias(f) for f, c in fill.items()))


def _joined(large: DataFrame, pool: float, keys: list[str]) -> DataFrame:
    """The features of teams that aren't packed, by joins over their scores."""
    out = submission(large, pool, keys)
    for part in (pair_features(large, keys), gini(large, keys), rater_spread(large, keys), assortativity(large, keys), sparse_triples(large, keys)):
        out = out.join(part, keys, "left")
    return out.select(*keys, *_PACKED)


def feature_table(teams: Teams, names: tuple[str, ...] = FEATURES, delta: bool = False, pool: float = 60.0, keys: list[str] = KEYS) -> DataFrame:
    """``features`` (those named) of teams that are made in the same tasks, as a written table: one pass, and no matrices leave it. ``delta``: also
    the teams' cross-model delta, so that both needn't be joined. Teams that aren't packed leave the pass with their scores, and are joins."""
    triads, extra = any(n.startswith("triad_") for n in names), ["delta"] if delta else []
    schema = ", ".join(f"`{k}` string" for k in keys) + ", n_students int, non_submitter_count int, " + "".join(f"{f} double, " for f in (*names, *extra)) + "whole boolean, n int, emails array<string>, arcs array<struct<recipient:string,giver:string,score:double>>"
    labels = [*keys, "n_students", "non_submitter_count", *names, *extra, "whole", "n", "emails", "arcs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            odd = np.flatnonzero(batch.column("arcs").is_valid().to_numpy(zero_copy_only=False))
            for part, stack in stacks(batch):
                b, found = len(part), team_kernel.features(stack, pool, triads)
                numbers = [np.where(np.isnan(found[f]), 0.0, found[f]) for f in names]
                if delta:
                    numbers.append(inside.solved_delta(stack))
                ints = [pa.array(found[c].astype(np.int32)) for c in ("n_students", "non_submitter_count")]
                none = [pa.nulls(b, batch.column(c).type) for c in ("n", "emails", "arcs")]
                yield pa.RecordBatch.from_arrays([*batch.select(keys).take(pa.array(part)).columns, *ints, *map(pa.array, numbers), pa.repeat(True, b), *none], names=labels)
            if len(odd):
                rest, b = batch.take(pa.array(odd)), len(odd)
                numbers = [pa.nulls(b, pa.float64())] * len(names)
                if delta:
                    numbers.append(pa.array(np.concatenate([inside.deltas(found) for _, _, found in solved(rest, NAMES)])))
                yield pa.RecordBatch.from_arrays([*rest.select(keys).columns, *[pa.nulls(b, pa.int32())] * 2, *numbers, pa.repeat(False, b), *(rest.column(c) for c in ("n", "emails", "arcs"))], names=labels)

    table = written(teams.in_tasks(run, schema), "features")
    columns = [*keys, "n_students", "non_submitter_count", *names, *extra]
    small, odd = table.where("whole").select(columns), table.where("not whole")
    if odd.isEmpty():
        return small
    scores = unpacked(odd.withColumn("cells", F.array().cast("array<double>")), keys)
    large = _joined(scores, pool, keys).fillna(0.0, list(FEATURES))
    if delta:
        large = large.join(odd.select(*keys, "delta"), keys, "left").fillna(0.0, extra)
    return written(small.unionByName(large.select(columns)), "features")


def ranked(rows: DataFrame, group: str, value: str, parts: int = 64) -> DataFrame:
    """(group, value, _n, _before): distinct values of each group with how many rows have them, and how many of the group's rows have smaller ones,
    NULL first. No task holds a group: distinct values are dealt to ranges, what each range begins with comes from the counts of ranges, a few
    numbers, and values are ranked inside of theirs."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("_n"))
    order = [F.col(group).asc_nulls_first(), F.col(value).asc_nulls_first()]
    dealt = written(counts.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy(group, "_part").agg(F.sum("_n").alias("_size"))  # at most ``parts`` rows a group
    so_far = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), F.coalesce(F.sum("_size").over(so_far), F.lit(0)).alias("_start"))
    inside_ = F.sum("_n").over(Window.partitionBy("_part", group).orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    at = dealt.withColumn("_inside", F.coalesce(inside_, F.lit(0))).join(F.broadcast(starts), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    return at.select(group, value, "_n", (F.col("_start") + F.col("_inside")).alias("_before"))


def medians(rows: DataFrame, group: str, value: str, parts: int = 64) -> DataFrame:
    """(group, median): exact, of the values that aren't NULL; no task holds a group."""
    some = written(ranked(rows.where(F.col(value).isNotNull()), group, value, parts), "ranked")
    total = some.groupBy(F.col(group).alias("_group")).agg(F.sum("_n").alias("_total"))
    at = some.join(F.broadcast(total), F.col(group).eqNullSafe(F.col("_group")))
    holds = lambda k: F.max(F.when((F.col("_before") <= k) & (k < F.col("_before") + F.col("_n")), F.col(value)))
    last = F.col("_total") - 1
    return at.groupBy(group).agg((0.5 * holds(F.floor(last / 2)) + 0.5 * holds(F.ceil(last / 2))).alias("median"))


#: Distinct values of a number that are sent to all tasks rather than joined by a shuffle of all rows.
BROADCAST_VALUES = 1_000_000


def percent_ranks(df: DataFrame, names: tuple[str, ...], parts: int = 64) -> DataFrame:
    """``df`` with each named number as its percent rank over all rows: smaller rows over all rows but one, ties alike, as
    ``percent_rank`` has it; NULL first. ``df`` should be a table, as it is read more than once. All numbers are ranked together, by their
    distinct values (``ranked``)."""
    total = df.count()
    each = df.select(F.posexplode(F.array(*(F.col(n).cast("double") for n in names))).alias("_name", "_v"))
    at = written(ranked(each, "_name", "_v", parts), "ranks")
    many = {r["_name"]: r["n"] for r in at.groupBy("_name").agg(F.count("*").alias("n")).collect()}  # a row a name
    share = (F.col("_before") / (total - 1) if total > 1 else F.lit(0.0)).cast("double")
    out = df
    for k, name in enumerate(names):
        ranks = at.where(F.col("_name") == k).select("_v", share.alias("_rank"))
        if many.get(k, 0) <= BROADCAST_VALUES:
            ranks = F.broadcast(ranks)
        out = out.join(ranks, F.col(name).eqNullSafe(F.col("_v"))).drop("_v", name).withColumnRenamed("_rank", name)
    return out.select(df.columns)


def metric_profile(features_: DataFrame, names: tuple[str, ...] = BEHAVIOUR[:6], percentile: bool = False, keys: list[str] = KEYS) -> DataFrame:
    """Chosen features on a scale of 0 to 1 across teams: by minimum and maximum, or by rank."""
    if percentile:
        return percent_ranks(features_.select(*keys, *names), names)
    ends = features_.agg(*(F.min(n).alias(f"{n}_low") for n in names), *(F.max(n).alias(f"{n}_high") for n in names))  # one row
    scaled = (F.coalesce(F.try_divide(F.col(n) - F.col(f"{n}_low"), F.col(f"{n}_high") - F.col(f"{n}_low")), F.lit(0.0)).alias(n) for n in names)
    return features_.crossJoin(F.broadcast(ends)).select(*keys, *scaled)
