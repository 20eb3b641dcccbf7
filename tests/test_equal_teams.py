"""Equal teams have their permutations and models in common."""

from __future__ import annotations

import numpy as np

from ratingscope.operators import models
from ratingscope.operators import perturb_kernel as kernel


def _teams(copies: int) -> tuple[np.ndarray, list[str], list[list[str]]]:
    s = np.random.default_rng(2).integers(0, 20, (2, 3, 3)).astype(float)
    s[1, :, 2] = np.nan  # gave nothing
    b = 2 * copies
    return np.tile(s, (copies, 1, 1)), [f"0|f|t{k}|q" for k in range(b)], [[f"{m}{k // 2}" for m in "abc"] for k in range(b)]


def test_equal_teams_share_matrices():
    """Two raters or three, with two orders each: at most ten matrices, whatever the number of teams; each permutation has its own."""
    s, ids, emails = _teams(40)
    perms = list(range(1, 21))
    some, at = kernel.dealt(s, ids, emails, perms)
    assert len(some) <= 10 and at.shape == (80, 20)
    assert np.array_equal(some[at], kernel.single_outlier(s, ids, emails, perms), equal_nan=True)
    alone = [kernel.dealt(s[k : k + 1], ids[k : k + 1], emails[k : k + 1], perms) for k in range(len(s))]
    assert all(np.array_equal(some[at[k]], x[y[0]], equal_nan=True) for k, (x, y) in enumerate(alone))


def test_what_is_said_of_silent_members_makes_no_other_matrix(monkeypatch):
    """Excluding leaves the third member out, so its row, the only difference of these teams, is not asked for."""
    s = np.tile(_teams(1)[0][1:], (6, 1, 1))
    s[:, 2, 0] = range(6)
    sizes, core = [], models._peerrank
    monkeypatch.setattr(models, "_peerrank", lambda x, inside: sizes.append(len(x)) or core(x, inside))
    found = models.solve_all(s, ("peerrank-exclude",))["peerrank-exclude"]
    assert sizes == [1] and found[0].shape == (6, 3)


def test_matrices_whose_hashes_meet_stay_apart(monkeypatch):
    class Zeros:
        def integers(self, *_, **__):
            return np.zeros(9, np.uint64)

    s = np.arange(36.0).reshape(4, 3, 3)
    s = np.concatenate([s, s])
    for k in (0, 1):
        first, which = models.distinct(s)
        assert (s[first][which] == s).all()
        monkeypatch.setattr(models.np.random, "default_rng", lambda *_: Zeros())
def test_equal_matrices_are_solved_once(monkeypatch):
    s, _, _ = _teams(40)
    want, sizes, solve = {m: models.solve(s, m) for m in models.NAMES}, [], models.solve
    monkeypatch.setattr(models, "solve", lambda x, m: sizes.append(len(x)) or solve(x, m))
    got = models.solve_distinct(s, models.NAMES)
    assert max(sizes) <= 2
    for m, found in want.items():
        for x, y in zip(got[m], found):
            assert np.allclose(np.asarray(x, float), np.asarray(y, float), atol=1e-12, equal_nan=True)
