"""Features of stacks of equal teams: small numpy functions that tasks run over Arrow batches.

A stack is (teams, recipients, givers), NaN for missing, members by e-mail.
"""

from __future__ import annotations

import numpy as np


def _ratio(a: np.ndarray, b: np.ndarray, otherwise: float = np.nan) -> np.ndarray:
    """a / b where b isn't 0."""
    return np.divide(a, b, out=np.full(np.broadcast(a, b).shape, otherwise), where=b != 0)


def _pearson(n, sx, sy, sxx, syy, sxy) -> np.ndarray:
    """As ``schema.pearson``."""
    n = n.astype(float)
    vx, vy = sxx - _ratio(sx * sx, n, 0.0), syy - _ratio(sy * sy, n, 0.0)
    fine = (n >= 2) & (vx > 1e-12 * sxx) & (vy > 1e-12 * syy)
    return np.where(fine, _ratio(sxy - _ratio(sx * sy, n, 0.0), np.sqrt(np.where(fine, vx * vy, 1.0)), 0.0), 0.0)


def _spread(x: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Population deviation along the last axis of what is there; NaN for nothing."""
    n = there.sum(axis=-1)
    mean = _ratio(np.where(there, x, 0.0).sum(axis=-1), n.astype(float))
    off = np.where(there, x - mean[..., None], 0.0)
    return np.sqrt(_ratio((off * off).sum(axis=-1), n.astype(float)))


def census(above: np.ndarray) -> dict[str, np.ndarray]:
    """Shares of the 16 classes from arcs (teams, from, to), as products of the matrices of one-way, mutual and empty pairs."""
    b, n, _ = above.shape
    back = above.transpose(0, 2, 1)
    one, both = (above & ~back).astype(float), (above & back).astype(float)
    none = (~above & ~back & ~np.eye(n, dtype=bool)).astype(float)
    rev = one.transpose(0, 2, 1)
    meet = lambda x, y, third: ((x @ y) * third).sum(axis=(1, 2))
    count = {
        "021D": meet(rev, one, none) / 2, "021U": meet(one, rev, none) / 2, "021C": meet(one, one, none), "111D": meet(both, rev, none), "111U": meet(both, one, none), "201": meet(both, both, none) / 2,
        "030T": meet(one, one, one), "030C": meet(one, one, rev) / 3, "120D": meet(rev, one, both) / 2, "120U": meet(one, rev, both) / 2, "120C": meet(one, one, both), "210": meet(both, both, one), "300": meet(both, both, both) / 6,
    }
    ways = {"021D": (2, 0), "021U": (2, 0), "021C": (2, 0), "111D": (1, 1), "111U": (1, 1), "201": (0, 2), "030T": (3, 0), "030C": (3, 0), "120D": (2, 1), "120U": (2, 1), "120C": (2, 1), "210": (1, 2), "300": (0, 3)}
    pairs = one.sum(axis=(1, 2)), both.sum(axis=(1, 2)) / 2
    for name, k in (("012", 0), ("102", 1)):
        count[name] = pairs[k] * (n - 2) - sum(count[c] * w[k] for c, w in ways.items())
    total = n * (n - 1) * (n - 2) / 6
    count["003"] = total - sum(count.values())
    return {c: x / total if total else np.full(b, np.nan) for c, x in count.items()}


def clustering(w: np.ndarray) -> np.ndarray:
    """Mean directed weighted coefficient of Fagiolo from weights (teams, from, to)."""
    there = ~np.isnan(w)
    known = np.where(there, w, 0.0)
    top = np.maximum(known.max(axis=(1, 2)), 0.0)
    tie = np.cbrt(_ratio(known, np.broadcast_to(top[:, None, None], w.shape), 0.0))
    tie = tie + tie.transpose(0, 2, 1)
    triangles = ((tie @ tie) * tie).sum(axis=2) / 2
    d, bi = there.sum(axis=1) + there.sum(axis=2), (there & there.transpose(0, 2, 1)).sum(axis=2)
    return _ratio(triangles, (d * (d - 1) - 2 * bi).astype(float), 0.0).mean(axis=1)


def features(s: np.ndarray, pool: float, triads: bool = True) -> dict[str, np.ndarray]:
    """All features by name, NaN where a team has nothing for one; without the census of triads, if that isn't wanted."""
    b, n, _ = s.shape
    own = np.eye(n, dtype=bool)
    w = np.where(own, np.nan, s).transpose(0, 2, 1)  # from, to
    there = ~np.isnan(w)
    known = np.where(there, w, 0.0)
    out = {"n_students": np.full(b, n)}
    silent = np.isnan(s).all(axis=1)  # no score given, self included
    out["non_submitter_count"] = silent.sum(axis=1)
    out["non_submitter_frac"] = out["non_submitter_count"] / n
    self_ = s[:, np.arange(n), np.arange(n)]
    rated = (~np.isnan(self_)).sum(axis=1).astype(float)
    out["mean_self_share"] = _ratio((np.where(np.isnan(self_), 0.0, self_) / pool).sum(axis=1), rated, 0.0)
    # pairs that rated each other, in the order of the members
    mutual = there & there.transpose(0, 2, 1) & np.triu(np.ones((n, n), bool), 1)
    x, y = np.where(mutual, known, 0.0), np.where(mutual, known.transpose(0, 2, 1), 0.0)
    m, all_ = mutual.sum(axis=(1, 2)), lambda v: v.sum(axis=(1, 2))
    reciprocity = _pearson(m, all_(x), all_(y), all_(x * x), all_(y * y), all_(x * y))
    out["reciprocity"] = np.where(m > 0, reciprocity, np.nan)
    out["asymmetry"] = np.where(m > 0, np.sqrt(2 * all_((x - y) ** 2)) / (np.sqrt(2 * all_((x + y) ** 2)) + 1e-9), np.nan)
    got = there.sum(axis=1)
    mean = np.sort(np.where(got > 0, _ratio(known.sum(axis=1), got.astype(float)), np.nan), axis=1)  # NaN last
    size, total = (got > 0).sum(axis=1), np.nansum(mean, axis=1)
    out["gini_in_degree"] = np.where(size > 0, _ratio(2 * np.nansum(np.arange(1, n + 1) * mean, axis=1) - (size + 1) * total, size * total, 0.0), np.nan)
    gave = there.sum(axis=2)
    each, raters = _spread(known, there), gave >= 2
    out["mean_rater_std"] = _ratio(np.where(raters, each, 0.0).sum(axis=1), raters.sum(axis=1).astype(float))
    out["std_rater_std"] = _spread(np.where(raters, each, 0.0), raters)
    x, y = np.where(there, gave[:, :, None], 0).astype(float), np.where(there, got[:, None, :], 0).astype(float)
    e = there.sum(axis=(1, 2))
    out["assortativity"] = np.where(e > 0, _pearson(e, all_(x), all_(y), all_(x * x), all_(y * y), all_(x * y)), np.nan)
    out["clustering"] = clustering(w)
    if not triads:
        return out
    average = _ratio(known.sum(axis=2), gave.astype(float))
    above = there & (known > average[:, :, None])
    return out | {f"triad_{c}": v for c, v in census(above).items()}
