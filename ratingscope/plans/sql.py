"""SQL twins of the named queries, for DuckDB over the same tables. Iterative models are recursive CTEs over lists."""

from __future__ import annotations

from ratingscope.functions.stats import chi2_quantile
from ratingscope.operators.atypical import LABELS, PROTOTYPES
from ratingscope.operators.fingerprint import BEHAVIOUR, TRIADS
from ratingscope.sources.ratings_view import VIEW_SQL

K = "csv_path, team, question"

def averages(source: str = "k", p: str = "") -> tuple[str, str]:
    """CTEs baseline and webpa (w0, w1) over a table of ratings; ``p`` begins their names."""
    return f"{p}baseline AS (SELECT {K}, recipient AS email, avg(score) FILTER (WHERE giver <> recipient) AS iwf FROM {source} GROUP BY ALL)", f"""{p}w0 AS (SELECT {K}, recipient AS email, coalesce(sum(score), 0) AS points FROM {source} GROUP BY ALL),
{p}w1 AS (SELECT *, avg(points) OVER (PARTITION BY {K}) AS mean FROM {p}w0),
{p}webpa AS (SELECT {K}, email, points / mean * 10 AS iwf FROM {p}w1 WHERE mean <> 0)"""


BASELINE, WEBPA = averages()


def peer(core: str, variant: str, source: str = "k", p: str = "") -> str:
    """CTEs that end in a table named core_variant (keys, email, iwf, hub) and core_variant_failed (keys, email)."""
    n = f"{p}{core}_{variant}"
    sums = f"""{n}0 AS (SELECT *, count(score) FILTER (WHERE giver <> recipient) OVER (PARTITION BY {K}, giver) = 0 AS silent FROM {source}),
{n}s AS (SELECT DISTINCT {K}, giver AS email, silent FROM {n}0)"""
    if variant == "impute":
        cells = f"{n}c AS (SELECT {K}, giver, recipient, CASE WHEN silent THEN 10.0 ELSE score END AS score FROM {n}0)"
    elif variant == "exclude":
        cells = f"""{n}i AS (SELECT *, count(*) OVER (PARTITION BY {K}) AS inside FROM {n}s WHERE NOT silent),
{n}c AS (SELECT c.csv_path, c.team, c.question, giver, recipient, score FROM {n}0 c JOIN {n}i i ON (c.csv_path, c.team, c.question, c.recipient) = (i.csv_path, i.team, i.question, i.email) WHERE NOT c.silent AND i.inside >= 2)"""
    else:
        cells = f"{n}c AS (SELECT {K}, giver, recipient, score FROM {n}0)"
    body = f"""{n}d AS (SELECT {K}, giver, recipient, CASE WHEN giver <> recipient THEN coalesce(score, 0) ELSE 0 END AS s,
    count(score) FILTER (WHERE giver <> recipient) OVER (PARTITION BY {K}, giver) > 0 AS gives FROM {n}c),
{n}e AS (SELECT *, sum(s) OVER (PARTITION BY {K}, giver) AS total FROM {n}d)"""
    if core == "peerrank":
        step = f"""{n}_failed AS (SELECT {K}, min(giver) AS email FROM {n}e WHERE gives AND total = 0 GROUP BY ALL),
{n}p AS (SELECT {K}, list(CASE WHEN total > 0 THEN s / total ELSE 0 END ORDER BY recipient, giver) AS a, list(DISTINCT giver ORDER BY giver) AS emails FROM {n}e ANTI JOIN {n}_failed USING ({K}) GROUP BY ALL),
{n}q AS (SELECT *, len(emails) AS n, list_transform(range(1, len(emails) + 1), lambda i: list_sum(a[(i - 1) * len(emails) + 1:i * len(emails)])) AS x FROM {n}p),
{n}r AS (SELECT {K}, n, a, emails, list_transform(x, lambda v: v / list_sum(x)) AS x, 0 AS it, 1.0::DOUBLE AS l1 FROM {n}q WHERE list_sum(x) > 0
 UNION ALL SELECT {K}, n, a, emails, y, it + 1, list_sum(list_transform(range(1, n + 1), lambda j: abs(y[j] - x[j]))) FROM (
  SELECT *, list_transform(range(1, n + 1), lambda i: 0.9 * x[i] + CASE WHEN t - x[i] > 0 THEN 0.1 * list_sum(list_transform(range(1, n + 1), lambda j: x[j] * a[(i - 1) * n + j])) / (t - x[i]) ELSE 0 END) AS y
  FROM (SELECT *, list_sum(x) AS t FROM {n}r WHERE l1 >= 1e-6 AND it < 1000))),
{n}f AS (SELECT {K}, emails, list_transform(x, lambda v: 10 * v * n / list_sum(x)) AS iwf, iwf AS hub, it AS iterations FROM {n}r QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY it DESC) = 1)"""
    else:
        dot_a = "list_sum(list_transform(range(1, n + 1), lambda j: a[(i - 1) * n + j] * h[j]))"
        dot_h = "list_sum(list_transform(range(1, n + 1), lambda i: a[(i - 1) * n + j] * x[i]))"
        unit = lambda v: f"CASE WHEN list_dot_product({v}, {v}) > 0 THEN list_transform({v}, lambda z: z / sqrt(list_dot_product({v}, {v}))) ELSE {v} END"
        ten = lambda v: f"CASE WHEN list_sum({v}) <> 0 THEN list_transform({v}, lambda z: 10 * z * n / list_sum({v})) ELSE {v} END"
        step = f"""{n}_failed AS (SELECT {K}, giver AS email FROM {n}e WHERE false),
{n}p AS (SELECT {K}, list(s ORDER BY recipient, giver) AS a, list(DISTINCT giver ORDER BY giver) AS emails FROM {n}e GROUP BY ALL),
{n}q AS (SELECT *, len(emails) AS n, list_transform(emails, lambda e: 1 / sqrt(len(emails))) AS x FROM {n}p),
{n}r AS (SELECT {K}, n, a, emails, x, x AS h, 0 AS it, 1.0::DOUBLE AS l1 FROM {n}q
 UNION ALL SELECT {K}, n, a, emails, y, g, it + 1, list_sum(list_transform(range(1, n + 1), lambda j: abs(y[j] - x[j]))) FROM (
  SELECT *, {unit("y0")} AS y, {unit("g0")} AS g FROM (SELECT *, list_transform(range(1, n + 1), lambda i: {dot_a}) AS y0, list_transform(range(1, n + 1), lambda j: {dot_h}) AS g0
  FROM {n}r WHERE l1 >= 1e-6 AND it < 1000))),
{n}f AS (SELECT {K}, emails, {ten("x")} AS iwf, {ten("h")} AS hub, it AS iterations FROM {n}r QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY it DESC) = 1)"""
    rows = f"""{n}u AS (SELECT {K}, unnest(emails) AS email, unnest(iwf) AS iwf, unnest(hub) AS hub FROM {n}f),
{n} AS (SELECT s.csv_path, s.team, s.question, s.email, u.iwf, u.hub FROM {n}s s LEFT JOIN {n}u u USING ({K}, email) ANTI JOIN {n}_failed USING ({K}))"""
    return ",\n".join([sums, cells, body, step, rows])


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([VIEW_SQL.strip(), *ctes]) + "\n"


def _r(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c.split('.')[-1]}" for c in cols)


SIX_NAMES = ("baseline", "peerrank_impute", "peerrank_exclude", "webpa", "peerhits_impute", "peerhits_exclude")


def six(source: str = "k", p: str = "") -> tuple[str, ...]:
    """CTEs of the six models over a table of ratings, and of all their rows (p_rows: keys, email, model, iwf) and failing runs
    (p_bad: keys, model, error)."""
    rows = " UNION ALL ".join(f"SELECT {K}, email, '{n.replace('_', '-')}' AS model, iwf FROM {p}{n}" for n in SIX_NAMES)
    bad = " UNION ALL ".join(f"SELECT {K}, 'peerrank-{v}', 'ValueError: ' || email || ' gave only zeros' FROM {p}peerrank_{v}_failed" for v in ("impute", "exclude"))
    peers = (peer(core, v, source, p) for core in ("peerrank", "peerhits") for v in ("impute", "exclude"))
    return (*averages(source, p), *peers, f"{p}rows AS ({rows})", f"{p}bad AS (SELECT DISTINCT {K}, 'webpa' AS model, 'all scores are zero' AS error FROM {p}w1 WHERE mean = 0 UNION ALL {bad})")


SIX = six()
PAIRS = f"""x1 AS (SELECT a.csv_path, a.team, a.question, a.email, a.model, b.iwf AS base, a.iwf AS adv FROM rows a JOIN baseline b USING ({K}, email) WHERE a.model <> 'baseline'),
x2 AS (SELECT p.csv_path, p.team, p.question, p.model, p.email AS ea, q.email AS eb, p.base AS ba, q.base AS bb, p.adv AS aa, q.adv AS ab FROM x1 p JOIN x1 q USING ({K}, model) WHERE p.email < q.email),
x3 AS (SELECT *, ba >= bb AS up, abs(ba - bb) AS base_diff, CASE WHEN ba >= bb THEN aa - ab ELSE ab - aa END AS adv_diff FROM x2),
x4 AS (SELECT *, coalesce(round(base_diff, 9) >= 1.5 AND aa IS NOT NULL AND ab IS NOT NULL, false) AS eligible FROM x3),
x5 AS (SELECT *, eligible AND round(adv_diff, 9) < 0 AS reversed FROM x4)"""
SUMMARY = f"x6 AS (SELECT {K}, model, count(*) FILTER (WHERE reversed) AS reversed, count(*) FILTER (WHERE eligible) AS eligible, count(*) AS pairs FROM x5 GROUP BY ALL)"

#: Six models' runs that fail, as (keys, model, error).
FAILED = f"SELECT {K}, model, error FROM bad"

ACTIVE = f"""g0 AS (SELECT *, count(score) OVER (PARTITION BY {K}, giver) > 0 AS active FROM k),
g1 AS (SELECT *, count(*) FILTER (WHERE active AND giver = recipient) OVER (PARTITION BY {K}) AS raters, count(*) FILTER (WHERE giver = recipient) OVER (PARTITION BY {K}) AS n FROM g0),
g2 AS (SELECT {K}, giver, row_number() OVER (PARTITION BY {K} ORDER BY giver) AS rank FROM g1 WHERE active AND giver = recipient),
g AS (SELECT g1.*, g2.rank FROM g1 LEFT JOIN g2 USING ({K}, giver))"""
CELL = f"{K}, giver, recipient"
UNIFORM = f"SELECT {CELL}, CASE WHEN NOT active THEN score WHEN giver = recipient THEN NULL ELSE sum(score) OVER (PARTITION BY {K}, giver) / (n - 1) END AS score FROM g"
ZERO = f"SELECT {CELL}, CASE WHEN active THEN score * n / (n - 1) ELSE score END AS score FROM g WHERE raters >= 2"
ZERO2 = f"SELECT {CELL}, CASE WHEN active AND rank <= 2 THEN score * n / (n - 1) ELSE score END AS score FROM g WHERE raters >= 2"


def downvote(victim: str) -> str:
    """victim: CTE v (keys, victim)."""
    return f"""v AS ({victim}),
h0 AS (SELECT g.*, victim, giver <> recipient AND recipient <> victim AS gains FROM g JOIN v USING ({K}) WHERE raters >= 1),
h1 AS (SELECT *, coalesce(sum(score) FILTER (WHERE recipient = victim) OVER (PARTITION BY {K}, giver), 0) AS freed,
 coalesce(sum(score) FILTER (WHERE gains) OVER (PARTITION BY {K}, giver), 0) AS total, count(*) FILTER (WHERE gains) OVER (PARTITION BY {K}, giver) AS many FROM h0),
h AS (SELECT {CELL}, CASE WHEN NOT active OR giver = victim THEN score WHEN recipient = victim THEN 0 WHEN giver = recipient THEN score
 WHEN freed <= 0 THEN score WHEN total > 0 THEN score + freed * score / total ELSE score + freed / many END AS score FROM h1)"""


FIRST_RATER = f"SELECT {K}, giver AS victim FROM g2 WHERE rank = 1"
BEST = f"SELECT {K}, arg_min(email, struct_pack(x := -iwf, e := email)) AS victim FROM baseline WHERE iwf IS NOT NULL GROUP BY ALL"
def outlier(perm: str = "", perms: str = "") -> str:
    """``perm``: a column name and a comma, ``perms`` a join that has it."""
    return f"""o1 AS (SELECT {K}, {perm} arg_min(giver, md5(concat_ws('|', '0', {K}, {perm} giver))) AS chosen FROM g2 {perms} GROUP BY ALL),
o2 AS (SELECT g.csv_path, g.team, g.question, {perm} giver, recipient, score, giver = chosen AS out FROM g JOIN o1 USING ({K})),
o3 AS (SELECT {perm} {CELL}, row_number() OVER (PARTITION BY {K}, {perm} giver ORDER BY recipient) AS r FROM o2 WHERE out AND giver <> recipient),
o4 AS (SELECT {perm} {K}, giver, score AS dealt, row_number() OVER (PARTITION BY {K}, {perm} giver ORDER BY md5(concat_ws('|', '0', {K}, {perm} giver, recipient)), recipient) AS r FROM o2 WHERE out AND giver <> recipient),
o5 AS (SELECT {perm} {CELL}, dealt FROM o3 JOIN o4 USING ({perm} {K}, giver, r)),
o AS (SELECT {perm} {CELL}, CASE WHEN out THEN dealt ELSE score END AS score FROM o2 LEFT JOIN o5 USING ({perm} {CELL}))"""


OUTLIER = outlier()

EDGES = f"""e AS (SELECT {K}, giver, recipient, score AS weight FROM k WHERE score IS NOT NULL AND giver <> recipient)"""


def corr(n: str, x: str, y: str) -> str:
    vx, vy = f"(sum({x} * {x}) - sum({x}) * sum({x}) / {n})", f"(sum({y} * {y}) - sum({y}) * sum({y}) / {n})"
    return f"CASE WHEN {n} >= 2 AND {vx} > 1e-12 * sum({x} * {x}) AND {vy} > 1e-12 * sum({y} * {y}) THEN (sum({x} * {y}) - sum({x}) * sum({y}) / {n}) / sqrt({vx} * {vy}) ELSE 0 END"


PAIR_FEATURES = f"""p1 AS (SELECT a.csv_path, a.team, a.question, a.weight AS x, b.weight AS y FROM e a JOIN e b ON (a.csv_path, a.team, a.question, a.giver, a.recipient) = (b.csv_path, b.team, b.question, b.recipient, b.giver) WHERE a.giver < a.recipient),
pf AS (SELECT {K}, {corr('count(*)', 'x', 'y')} AS reciprocity, sqrt(2 * sum((x - y) ** 2)) / (sqrt(2 * sum((x + y) ** 2)) + 1e-9) AS asymmetry FROM p1 GROUP BY ALL)"""
GINI = f"""n1 AS (SELECT {K}, recipient, avg(weight) AS v FROM e GROUP BY ALL),
n2 AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY v) AS r FROM n1),
gf AS (SELECT {K}, coalesce((2 * sum(r * v) - (count(*) + 1) * sum(v)) / nullif(count(*) * sum(v), 0), 0) AS gini_in_degree FROM n2 GROUP BY ALL)"""
SPREAD = f"""s1 AS (SELECT {K}, giver, stddev_pop(weight) AS s FROM e GROUP BY ALL HAVING count(*) >= 2),
sf AS (SELECT {K}, avg(s) AS mean_rater_std, stddev_pop(s) AS std_rater_std FROM s1 GROUP BY ALL)"""
SUBMISSION = f"""u1 AS (SELECT *, count(score) OVER (PARTITION BY {K}, giver) AS given FROM k),
uf AS (SELECT {K}, count(*) AS n_students, count(*) FILTER (WHERE given = 0) AS non_submitter_count, count(*) FILTER (WHERE given = 0) / count(*) AS non_submitter_frac, coalesce(avg(score / 60.0), 0) AS mean_self_share FROM u1 WHERE giver = recipient GROUP BY ALL)"""
ASSORT = f"""a1 AS (SELECT *, CAST(count(*) OVER (PARTITION BY {K}, giver) AS DOUBLE) AS x, CAST(count(*) OVER (PARTITION BY {K}, recipient) AS DOUBLE) AS y FROM e),
af AS (SELECT {K}, {corr('count(*)', 'x', 'y')} AS assortativity FROM a1 GROUP BY ALL)"""
_O = {"a": ("u1 AND NOT d1", "u2 AND NOT d2"), "b": ("d1 AND NOT u1", "u3 AND NOT d3"), "c": ("d2 AND NOT u2", "d3 AND NOT u3")}
_I = {"a": ("d1 AND NOT u1", "d2 AND NOT u2"), "b": ("u1 AND NOT d1", "d3 AND NOT u3"), "c": ("u2 AND NOT d2", "u3 AND NOT d3")}
_add = lambda parts: " + ".join(f"CAST({p} AS INT)" for p in parts)
TRIPLES = f"""mem AS (SELECT {K}, recipient AS email FROM k GROUP BY ALL),
ee AS (SELECT *, weight > avg(weight) OVER (PARTITION BY {K}, giver) AS above FROM e),
pr AS (SELECT x.csv_path, x.team, x.question, x.email AS a, y.email AS b, f.weight AS ab, q.weight AS ba, coalesce(f.above, false) AS up, coalesce(q.above, false) AS down
 FROM mem x JOIN mem y ON (x.csv_path, x.team, x.question) = (y.csv_path, y.team, y.question) AND x.email < y.email
 LEFT JOIN ee f ON (f.csv_path, f.team, f.question, f.giver, f.recipient) = (x.csv_path, x.team, x.question, x.email, y.email)
 LEFT JOIN ee q ON (q.csv_path, q.team, q.question, q.giver, q.recipient) = (x.csv_path, x.team, x.question, y.email, x.email)),
pt AS (SELECT *, coalesce(cbrt(ab / top), 0) + coalesce(cbrt(ba / top), 0) AS tie FROM (SELECT *, nullif(max(greatest(coalesce(ab, 0), coalesce(ba, 0))) OVER (PARTITION BY {K}), 0) AS top FROM pr)),
tr AS (SELECT x.csv_path, x.team, x.question, x.a, x.b, y.b AS c, x.up AS u1, x.down AS d1, y.up AS u2, y.down AS d2, z.up AS u3, z.down AS d3, x.tie * y.tie * z.tie AS product
 FROM pt x JOIN pt y ON (x.csv_path, x.team, x.question, x.a) = (y.csv_path, y.team, y.question, y.a) AND x.b < y.b
 JOIN pt z ON (z.csv_path, z.team, z.question, z.a, z.b) = (x.csv_path, x.team, x.question, x.b, y.b)),
t1 AS (SELECT *, CAST(u1 AND d1 AS INT) AS m1, CAST(u2 AND d2 AS INT) AS m2, CAST(u3 AND d3 AS INT) AS m3, {", ".join(f"{_add(_O[x])} AS o{x}, {_add(_I[x])} AS i{x}" for x in "abc")} FROM tr),
t2 AS (SELECT *, m1 + m2 + m3 AS m, oa + ob + oc AS one, CASE WHEN m3 = 1 THEN oa WHEN m2 = 1 THEN ob WHEN m1 = 1 THEN oc END AS o3, CASE WHEN m3 = 1 THEN ia WHEN m2 = 1 THEN ib WHEN m1 = 1 THEN ic END AS i3 FROM t1),
t3 AS (SELECT *, CASE WHEN m = 0 AND one = 0 THEN '003' WHEN m = 0 AND one = 1 THEN '012' WHEN m = 1 AND one = 0 THEN '102'
 WHEN m = 0 AND one = 2 THEN CASE WHEN greatest(oa, ob, oc) = 2 THEN '021D' WHEN greatest(ia, ib, ic) = 2 THEN '021U' ELSE '021C' END
 WHEN m = 1 AND one = 1 THEN CASE WHEN o3 = 1 THEN '111D' ELSE '111U' END
 WHEN m = 0 AND one = 3 THEN CASE WHEN greatest(oa, ob, oc) = 1 THEN '030C' ELSE '030T' END
 WHEN m = 2 AND one = 0 THEN '201' WHEN m = 1 AND one = 2 THEN CASE WHEN o3 = 2 THEN '120D' WHEN i3 = 2 THEN '120U' ELSE '120C' END
 WHEN m = 2 AND one = 1 THEN '210' ELSE '300' END AS class FROM t2),
tc AS (SELECT {K}, {", ".join(f"count(*) FILTER (WHERE class = '{t}') / count(*) AS triad_{t}" for t in TRIADS)} FROM t3 GROUP BY ALL),
dg AS (SELECT {K}, email, sum(arcs) AS d, count(*) FILTER (WHERE arcs = 2) AS bi FROM (SELECT {K}, unnest([a, b]) AS email, CAST(ab IS NOT NULL AS INT) + CAST(ba IS NOT NULL AS INT) AS arcs FROM pr) GROUP BY ALL),
cn AS (SELECT {K}, email, sum(product) AS triangles FROM (SELECT {K}, unnest([a, b, c]) AS email, product FROM t3) GROUP BY ALL),
cf AS (SELECT {K}, avg(coalesce(triangles / nullif(d * (d - 1) - 2 * bi, 0), 0)) AS clustering FROM dg LEFT JOIN cn USING ({K}, email) GROUP BY ALL),
tf AS (SELECT cf.*, tc.* EXCLUDE (csv_path, team, question) FROM cf LEFT JOIN tc USING ({K}))"""
_features = [*BEHAVIOUR, *(f"triad_{t}" for t in TRIADS)]
ALL_FEATURES = (EDGES, PAIR_FEATURES, GINI, SPREAD, SUBMISSION, ASSORT, TRIPLES, f"fm AS (SELECT uf.csv_path, uf.team, uf.question, n_students, non_submitter_count, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _features)} FROM uf LEFT JOIN pf USING ({K}) LEFT JOIN gf USING ({K}) LEFT JOIN sf USING ({K}) LEFT JOIN af USING ({K}) LEFT JOIN tf USING ({K}))")


def attacked(n_perms: int = 0) -> tuple[str, ...]:
    """CTEs of every perturbation under the six models: d (keys, variant, perm, model, delta), and e (keys, variant, perm, model,
    error). While models run, variant and permutation are part of the key csv_path."""
    moves = {"clean": "SELECT * FROM k", "uniform_inflation": UNIFORM, "zero_self_full": ZERO, "zero_self_partial": ZERO2, "targeted_downvote": "SELECT * FROM h"}
    parts = [f"SELECT csv_path || '#{v}#0' AS csv_path, team, question, giver, recipient, score FROM ({q})" for v, q in moves.items()]
    more = ()
    if n_perms:
        more = (outlier("perm,", f"CROSS JOIN range(1, {n_perms + 1}) _p(perm)"),)
        parts.append("SELECT csv_path || '#single_outlier#' || perm, team, question, giver, recipient, score FROM o")
    back = "split_part(csv_path, '#', 1) AS csv_path, team, question, split_part(csv_path, '#', 2) AS variant, CAST(split_part(csv_path, '#', 3) AS INT) AS perm"
    return (
        ACTIVE, downvote(FIRST_RATER), *more, "mv AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")", *six("mv", "m_"),
        f"s AS MATERIALIZED (SELECT {back}, email, model, iwf FROM m_rows)",
        f"""d AS (SELECT a.csv_path, a.team, a.question, a.variant, a.perm, a.model, avg(abs(a.iwf - c.iwf)) AS delta FROM s a LEFT JOIN s c
 ON (a.csv_path, a.team, a.question, a.email, a.model) = (c.csv_path, c.team, c.question, c.email, c.model) AND c.variant = 'clean' WHERE a.variant <> 'clean' GROUP BY ALL)""",
        f"e AS (SELECT {back}, model, error FROM m_bad)",
    )


ATTACK_FAILURES = f"""SELECT {K}, variant, error FROM (SELECT {K}, count(DISTINCT giver) FILTER (WHERE active) AS raters FROM g0 GROUP BY ALL)
JOIN (VALUES ('zero_self_full', 2, 'fewer than two active raters'), ('zero_self_partial', 2, 'fewer than two active raters'), ('targeted_downvote', 1, 'no active rater'), ('single_outlier', 1, 'no active rater')) n(variant, least, error) ON raters < least"""
#: Means over teams; permutations of a team count as one.
SUMMARY_OF_ATTACKS = f"SELECT variant, model, avg(delta) AS mean_delta FROM (SELECT {K}, variant, model, avg(delta) AS delta FROM d GROUP BY ALL) WHERE delta IS NOT NULL GROUP BY ALL"

_cause = "CASE WHEN non_submitter_count > 0 AND mean_rater_std < 1e-9 THEN 'both' WHEN non_submitter_count > 0 THEN 'non_submitter' WHEN mean_rater_std < 1e-9 THEN 'flat' ELSE 'none' END"
#: Features that vary as rows, standardised: the features of all teams, filled with their means first.
LONG = f"""fl AS (UNPIVOT (SELECT {K}, {_cause} AS cause, {', '.join(f'coalesce({f}, avg({f}) OVER ())::DOUBLE AS {f}' for f in _features)} FROM fm WHERE csv_path <> 'prototypes') ON {', '.join(_features)} INTO NAME feature VALUE v),
fs AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS s, row_number() OVER (ORDER BY feature) - 1 AS i FROM fl GROUP BY feature HAVING stddev_pop(v) ** 2 > 1e-10),
z AS (SELECT {K}, cause, feature, i, (v - m) / s AS z FROM fl JOIN fs USING (feature))"""
#: The shrunk covariance, its inverse by sweeping one row and column after the other, and squared distances from the clean teams' centre.
DISTANCE = f"""zn AS (SELECT count(DISTINCT ({K})) AS n, count(DISTINCT feature) AS p FROM z),
zc AS (SELECT a.i, b.i AS j, sum(a.z * b.z) / (SELECT n FROM zn) AS s FROM z a JOIN z b USING ({K}) GROUP BY ALL),
zq AS (SELECT sum(q * q) AS q FROM (SELECT sum(z * z) AS q FROM z GROUP BY {K})),
zt AS (SELECT sum(s) FILTER (i = j) / any_value(p) AS mu, sum(s * s) AS s2, any_value(p) AS p, any_value(n) AS n FROM zc, zn),
zb AS (SELECT mu, (s2 - p * mu * mu) / p AS d, (q / n - s2) / (p * n) AS b FROM zt, zq),
zw AS (SELECT mu, CASE WHEN d > 0 THEN greatest(least(b, d), 0) / d ELSE 0 END AS w FROM zb),
zs AS (SELECT i, j, (1 - w) * s + CASE WHEN i = j THEN w * mu ELSE 0 END AS s FROM zc, zw),
zp AS (SELECT 0 AS k, list(s ORDER BY i, j) AS a FROM zs
 UNION ALL SELECT k + 1, list_transform(range(p * p), lambda x: CASE WHEN x // p = k AND x % p = k THEN -1 / a[k * p + k + 1]
  WHEN x // p = k OR x % p = k THEN a[x + 1] / a[k * p + k + 1] ELSE a[x + 1] - a[x // p * p + k + 1] * a[k * p + x % p + 1] / a[k * p + k + 1] END) FROM zp, zn WHERE k < p),
zi AS (SELECT unnest(range(p * p)) // p AS i, unnest(range(p * p)) % p AS j, -unnest(a) AS w FROM zp, zn WHERE k = p),
zm AS (SELECT i, coalesce(avg(z) FILTER (cause = 'none'), 0) AS c FROM z GROUP BY i),
zx AS (SELECT {K}, cause, i, z - c AS x FROM z JOIN zm USING (i)),
zd AS (SELECT a.csv_path, a.team, a.question, a.cause, sum(a.x * w * b.x) AS d2 FROM zx a JOIN zi ON zi.i = a.i
 JOIN zx b ON (b.csv_path, b.team, b.question, b.i) = (a.csv_path, a.team, a.question, zi.j) GROUP BY ALL)"""
#: The prototypes are five teams more, which no mean or deviation counts; distances of each team from each of them.
_proto = ", ".join(f"('prototypes', '{label}', '', 's{j}', 's{i}', {x}.0)" for label, m in zip(LABELS, PROTOTYPES) for i, row in enumerate(m) for j, x in enumerate(row))
WITH_PROTOTYPES = f"k AS (SELECT {K}, giver, recipient, score FROM kept UNION ALL SELECT * FROM (VALUES {_proto}))"
_names = {label: label.lower().replace("-", "_") for label in LABELS}
NEAREST = f"""pl AS (UNPIVOT (SELECT team AS label, {', '.join(f'{f}::DOUBLE AS {f}' for f in _features)} FROM fm WHERE csv_path = 'prototypes') ON {', '.join(_features)} INTO NAME feature VALUE v),
px AS (SELECT {K}, label, z.i, z - (v - m) / s AS x FROM z JOIN fs USING (feature) JOIN pl USING (feature)),
pd AS (SELECT a.csv_path, a.team, a.question, a.label, sqrt(sum(a.x * w * b.x)) AS d FROM px a JOIN zi ON zi.i = a.i
 JOIN px b ON (b.csv_path, b.team, b.question, b.label, b.i) = (a.csv_path, a.team, a.question, a.label, zi.j) GROUP BY ALL),
pw AS (SELECT {K}, {', '.join(f"any_value(d) FILTER (label = '{k}') AS dist_{n}" for k, n in _names.items())}, min(d) AS low FROM pd GROUP BY {K}),
pn AS (SELECT *, CASE {' '.join(f"WHEN dist_{n} = low THEN '{k}'" for k, n in _names.items())} END AS label, {' + '.join(f'exp(low - dist_{n})' for n in _names.values())} AS whole FROM pw),
near AS (SELECT *, {', '.join(f'exp(low - dist_{n}) / whole AS weight_{n}' for n in _names.values())} FROM pn)"""
DELTAS = f"""dl AS (SELECT {K}, coalesce(avg(spread) FILTER (WHERE n >= 2), 0) AS delta FROM (SELECT {K}, email, stddev_pop(iwf) AS spread, count(iwf) AS n FROM rows GROUP BY ALL) GROUP BY ALL)"""
_quantiles = ", ".join(f"({p}, {chi2_quantile(0.95, p)!r})" for p in range(1, len(_features) + 1))


ORACLE_SQL: dict[str, str] = {
    "baseline_iwf": _with(BASELINE) + f"SELECT {K}, email, {_r('iwf')} FROM baseline",
    "webpa_iwf": _with(WEBPA) + f"SELECT {K}, email, {_r('iwf')} FROM webpa",
    **{f"peerrank{v and '_' + v}_iwf": _with(peer("peerrank", v or "core")) + f"SELECT {K}, email, {_r('iwf')} FROM peerrank_{v or 'core'}" for v in ("", "impute", "exclude")},
    **{f"peerhits{v and '_' + v}_iwf": _with(peer("peerhits", v or "core")) + f"SELECT {K}, email, {_r('iwf', 'hub')} FROM peerhits_{v or 'core'}" for v in ("", "impute", "exclude")},
    "run_failures": _with(*SIX) + FAILED,
    "batch_totals": _with(*SIX, f"nb AS (SELECT count(*) AS failed FROM ({FAILED}))")
    + f"SELECT count(DISTINCT csv_path) AS files, count(DISTINCT ({K})) AS matrices, 6 * count(DISTINCT ({K})) AS runs, 6 * count(DISTINCT ({K})) - any_value(failed) AS succeeded, any_value(failed) AS failed FROM k, nb",
    "convergence_stats": _with(*SIX, "it AS (" + " UNION ALL ".join(f"SELECT '{n.replace('_', '-')}' AS model, t.csv_path, t.team, t.question, nullif(iterations, 0) AS iterations FROM (SELECT DISTINCT {K} FROM k) t LEFT JOIN {n}f USING ({K}) ANTI JOIN {n}_failed USING ({K})" for n in SIX_NAMES if n.startswith("peer")) + ")")
    + """SELECT model, count(*) AS total_runs, count(*) FILTER (WHERE iterations < 1000) AS converged, count(*) FILTER (WHERE iterations >= 1000) AS non_converged, round(avg(iterations), 6) + 0.0 AS mean_iterations,
round(median(iterations), 6) + 0.0 AS median_iterations, min(iterations) AS min_iterations, max(iterations) AS max_iterations FROM it GROUP BY model HAVING max(iterations) IS NOT NULL""",
    "iwf_side_by_side": _with(*SIX) + f"SELECT w0.csv_path, w0.team, w0.question, w0.email, " + ", ".join(f"round({n}.iwf, 6) + 0.0 AS {n}" for n in SIX_NAMES)
    + ", round(greatest(" + ", ".join(f"abs({n}.iwf - 10)" for n in SIX_NAMES) + "), 6) + 0.0 AS max_delta FROM w0 " + " ".join(f"LEFT JOIN {n} USING ({K}, email)" for n in SIX_NAMES),
    "iwf_pivot": _with(BASELINE, WEBPA) + f"SELECT b.csv_path, b.team, b.question, b.email, round(b.iwf, 6) + 0.0 AS baseline, round(w.iwf, 6) + 0.0 AS webpa, round(greatest(abs(b.iwf - 10), abs(w.iwf - 10)), 6) + 0.0 AS max_delta FROM baseline b LEFT JOIN webpa w USING ({K}, email)",
    "iwf_bands": _with(BASELINE, WEBPA)
    + f"""SELECT model, CASE WHEN iwf IS NULL THEN 'none' WHEN iwf <= 7 THEN 'low' WHEN iwf <= 8.5 THEN 'below' WHEN iwf <= 11.5 THEN 'normal' WHEN iwf <= 13 THEN 'above' ELSE 'high' END AS band, count(*) AS n
FROM (SELECT 'baseline' AS model, iwf FROM baseline UNION ALL SELECT 'webpa', CASE WHEN mean <> 0 THEN points / mean * 10 END FROM w1) GROUP BY ALL""",
    "member_grades": _with(WEBPA) + f"SELECT {K}, email, round(iwf / 10 * 80.0, 6) + 0.0 AS grade FROM webpa",
    "team_exclusions": _with() + f"SELECT {K}, n_members, n_missing FROM c WHERE n_missing >= 0.5 * n_members",
    "rater_missing": _with() + f"SELECT {K}, email AS student_email FROM t WHERE silent",
    "point_total_mismatch": _with(f"z AS (SELECT {K}, giver, sum(score) AS total FROM k GROUP BY ALL HAVING total IS NOT NULL), zz AS (SELECT *, median(total) OVER (PARTITION BY {K}) AS team_median FROM z)") + f"SELECT {K}, giver, {_r('total', 'team_median')} FROM zz WHERE abs(total - team_median) > 1.0",
    "diagnostic_events": _with(f"z AS (SELECT {K}, giver, sum(score) AS total FROM k GROUP BY ALL HAVING total IS NOT NULL), zz AS (SELECT *, median(total) OVER (PARTITION BY {K}) AS team_median FROM z)")
    + "SELECT 'rater_missing' AS event, count(*) AS n FROM t WHERE silent UNION ALL SELECT 'team_excluded', count(*) FROM c WHERE n_missing >= 0.5 * n_members UNION ALL SELECT 'point_total_mismatch', count(*) FROM zz WHERE abs(total - team_median) > 1.0",
    "non_submitter_kinds": _with(f"y AS (SELECT {K}, giver, count(score) AS s, count(score) FILTER (WHERE giver <> recipient) AS p FROM r GROUP BY ALL)")
    + "SELECT 'a' AS kind, count(*) AS n FROM y WHERE s = 0 UNION ALL SELECT 'b', count(*) FROM y WHERE p = 0 UNION ALL SELECT 'c', count(*) FROM y WHERE s = 0 UNION ALL SELECT 'd', count(*) FROM y WHERE s > 0",
    "rank_reversal_pairs": _with(*SIX, PAIRS) + f"SELECT {K}, model, CASE WHEN up THEN ea ELSE eb END AS higher, CASE WHEN up THEN eb ELSE ea END AS lower, {_r('base_diff', 'adv_diff')}, round(base_diff + abs(adv_diff), 6) + 0.0 AS magnitude FROM x5 WHERE reversed",
    "rank_reversal_summary": _with(*SIX, PAIRS, SUMMARY) + f"SELECT {K}, model, reversed, eligible, pairs, round(coalesce(reversed / nullif(eligible, 0), 0), 6) + 0.0 AS rate FROM x6",
    "rank_reversal_aggregate": _with(*SIX, PAIRS, SUMMARY)
    + """SELECT model, round(coalesce(avg(reversed / eligible) FILTER (WHERE eligible > 0), 0), 6) + 0.0 AS mean_rate, CAST(sum(reversed) AS BIGINT) AS reversed, CAST(sum(eligible) AS BIGINT) AS eligible, CAST(sum(pairs) AS BIGINT) AS pairs,
count(*) FILTER (WHERE eligible > 0) AS teams_with_eligible, count(*) AS teams, round(coalesce(sum(reversed) / nullif(sum(eligible), 0), 0), 6) + 0.0 AS pooled_rate FROM x6 GROUP BY model""",
    "cross_model_delta": _with(*SIX) + f"SELECT {K}, round(round(coalesce(avg(spread) FILTER (WHERE n >= 2), 0), 9), 6) + 0.0 AS delta FROM (SELECT {K}, email, stddev_pop(iwf) AS spread, count(iwf) AS n FROM rows GROUP BY ALL) GROUP BY ALL",
    "model_pair_delta": _with(*SIX) + f"SELECT a.csv_path, a.team, a.question, a.model AS model_a, b.model AS model_b, round(round(avg(abs(a.iwf - b.iwf)), 9), 6) + 0.0 AS delta FROM rows a JOIN rows b USING ({K}, email) WHERE a.model < b.model AND a.iwf IS NOT NULL AND b.iwf IS NOT NULL GROUP BY ALL",
    "distinct_teams": _with() + "SELECT count(DISTINCT team) AS unique_teams, count(DISTINCT csv_path) AS sessions FROM k",
    "team_size_stats": _with(f"z AS (SELECT {K}, count(DISTINCT recipient) AS n FROM k GROUP BY ALL)") + "SELECT min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) + 0.0 AS mean_size, round(median(n), 6) + 0.0 AS median_size, count(*) AS matrices FROM z",
    "iwf_range": _with(BASELINE) + "SELECT round(min(iwf), 6) + 0.0 AS min_iwf, round(max(iwf), 6) + 0.0 AS max_iwf, round(avg(iwf), 6) + 0.0 AS mean_iwf, round(stddev_pop(iwf), 6) + 0.0 AS std_iwf FROM baseline",
    "uniform_inflation": _with(ACTIVE) + f"SELECT {CELL}, {_r('score')} FROM ({UNIFORM})",
    "zero_self_full": _with(ACTIVE) + f"SELECT {CELL}, {_r('score')} FROM ({ZERO})",
    "zero_self_partial": _with(ACTIVE) + f"SELECT {CELL}, {_r('score')} FROM ({ZERO2})",
    "targeted_downvote": _with(ACTIVE, downvote(FIRST_RATER)) + f"SELECT {CELL}, {_r('score')} FROM h",
    "sabotage_of_the_best": _with(ACTIVE, BASELINE, downvote(BEST)) + f"SELECT {CELL}, {_r('score')} FROM h",
    "single_outlier": _with(ACTIVE, OUTLIER) + f"SELECT {CELL}, {_r('score')} FROM o",
    "attack_failures": _with(ACTIVE) + ATTACK_FAILURES,
    "strategic_silence": _with(ACTIVE) + f"SELECT {CELL}, round(CASE WHEN rank = 1 THEN NULL ELSE score END, 6) + 0.0 AS score FROM g",
    "attack_delta": _with(*attacked()) + f"SELECT {K}, variant, model, round(round(delta, 9), 6) + 0.0 AS delta FROM d",
    "attack_runs": _with(*attacked()) + f"SELECT {K}, variant, model, round(round(delta, 9), 6) + 0.0 AS delta, NULL AS error FROM d UNION ALL SELECT {K}, variant, model, NULL, error FROM e WHERE variant <> 'clean' UNION ALL SELECT {K}, variant, NULL, NULL, error FROM ({ATTACK_FAILURES})",
    "robustness_of_two_permutations": _with(*attacked(2)) + "SELECT variant, " + ", ".join(f"round(round(max(mean_delta) FILTER (WHERE model = '{n.replace('_', '-')}'), 9), 6) + 0.0 AS {n}" for n in SIX_NAMES) + f" FROM ({SUMMARY_OF_ATTACKS}) GROUP BY variant",
    "two_permutations": _with(*attacked(2)) + f"SELECT {K}, model, count(delta) AS n_perms, round(round(avg(delta), 9), 6) + 0.0 AS mean_delta, round(round(stddev_pop(delta), 9), 6) + 0.0 AS std_delta, round(round(min(delta), 9), 6) + 0.0 AS min_delta, round(round(max(delta), 9), 6) + 0.0 AS max_delta FROM d WHERE variant = 'single_outlier' GROUP BY ALL",
    "reciprocity": _with(EDGES, PAIR_FEATURES) + f"SELECT {K}, {_r('reciprocity')} FROM pf",
    "asymmetry": _with(EDGES, PAIR_FEATURES) + f"SELECT {K}, {_r('asymmetry')} FROM pf",
    "gini_in_degree": _with(EDGES, GINI) + f"SELECT {K}, {_r('gini_in_degree')} FROM gf",
    "rater_std": _with(EDGES, SPREAD) + f"SELECT {K}, {_r('mean_rater_std', 'std_rater_std')} FROM sf",
    "self_share": _with(SUBMISSION) + f"SELECT {K}, {_r('non_submitter_frac', 'mean_self_share')} FROM uf",
    "assortativity": _with(EDGES, ASSORT) + f"SELECT {K}, {_r('assortativity')} FROM af",
    "clustering": _with(EDGES, TRIPLES) + f"SELECT {K}, {_r('clustering')} FROM tf",
    "triad_census": _with(EDGES, TRIPLES) + f"SELECT {K}, {_r(*(f'triad_{t}' for t in TRIADS))} FROM tf",
    "member_degrees": _with(EDGES) + f"SELECT csv_path, team, question || '/' || email AS question, round(coalesce((SELECT sum(weight) FROM e WHERE (e.csv_path, e.team, e.question, e.recipient) = (x.csv_path, x.team, x.question, x.email)), 0), 6) + 0.0 AS in_weight, round(coalesce((SELECT sum(weight) FROM e WHERE (e.csv_path, e.team, e.question, e.giver) = (x.csv_path, x.team, x.question, x.email)), 0), 6) + 0.0 AS out_weight FROM (SELECT DISTINCT {K}, recipient AS email FROM k) x",
    "scaled_edges": _with(EDGES) + f"SELECT csv_path, team, question || '/' || giver || '/' || recipient AS question, round(coalesce((weight - min(weight) OVER w) / nullif(max(weight) OVER w - min(weight) OVER w, 0), 0.5), 6) + 0.0 AS scaled FROM e WINDOW w AS (PARTITION BY {K})",
    "feature_matrix": _with(*ALL_FEATURES) + f"SELECT {K}, n_students, non_submitter_count, {_r(*_features)} FROM fm",
    "degenerate_cause": _with(*ALL_FEATURES) + f"SELECT {K}, CASE WHEN non_submitter_count > 0 AND mean_rater_std < 1e-9 THEN 'both' WHEN non_submitter_count > 0 THEN 'non_submitter' WHEN mean_rater_std < 1e-9 THEN 'flat' ELSE 'none' END AS cause FROM fm",
    "standardised_long": _with(*ALL_FEATURES, LONG) + f"SELECT {K}, cause, feature, round(z, 6) + 0.0 AS z FROM z",
    "nearest_prototype": _with(WITH_PROTOTYPES, *ALL_FEATURES, LONG, DISTANCE, NEAREST).replace("\nk AS (SELECT r.*", "\nkept AS (SELECT r.*") + f"SELECT {K}, label, {_r(*(f'{c}_{n}' for c in ('dist', 'weight') for n in _names.values()))} FROM near",
    "delta_by_label": _with(WITH_PROTOTYPES, *ALL_FEATURES, LONG, DISTANCE, NEAREST, *SIX, DELTAS).replace("\nk AS (SELECT r.*", "\nkept AS (SELECT r.*") + f"SELECT a.label, count(near.label) AS count, round(round(avg(delta), 9), 6) + 0.0 AS mean, round(round(stddev_pop(delta), 9), 6) + 0.0 AS std, round(round(quantile_cont(delta, 0.5), 9), 6) + 0.0 AS median, round(round(max(delta), 9), 6) + 0.0 AS max FROM (VALUES {', '.join(f'({k!r})' for k in LABELS)}) a(label) LEFT JOIN (near JOIN dl USING ({K})) near ON near.label = a.label GROUP BY a.label",
    "atypicality": _with(*ALL_FEATURES, LONG, DISTANCE) + f"SELECT {K}, cause, round(sqrt(d2), 6) + 0.0 AS distance, CASE WHEN d2 > q THEN 'Anomalous' ELSE 'Typical' END AS flag FROM zd, zn JOIN (VALUES {_quantiles}) t(k, q) ON k = p",
    "metric_profile": _with(*ALL_FEATURES) + f"SELECT {K}, " + ", ".join(f"round(coalesce(({f} - min({f}) OVER ()) / nullif(max({f}) OVER () - min({f}) OVER (), 0), 0), 6) + 0.0 AS {f}" for f in BEHAVIOUR[:6]) + " FROM fm",
    "metric_percentiles": _with(*ALL_FEATURES, f"pr6 AS (SELECT {K}, " + ", ".join(f"round({f}, 6) + 0.0 AS {f}" for f in BEHAVIOUR[:6]) + " FROM fm)") + f"SELECT {K}, " + ", ".join(f"round(percent_rank() OVER (ORDER BY {f}), 6) + 0.0 AS {f}" for f in BEHAVIOUR[:6]) + " FROM pr6",
    "session_parse_roundtrip": _with() + f"SELECT csv_path, team, 'Distribute a total of 60 points: ' || question AS question, substr(csv_path, 9, 4) AS year, 'S1' AS semester, CAST(1 AS BIGINT) AS session_number, giver, recipient, score FROM r",
}
