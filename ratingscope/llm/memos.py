"""What a Python worker remembers between the slices of a task: bounded, short keys only, and of one operator at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import islice

import pyarrow as pa

#: Longer keys are worked out anew each time.
LONGEST_KEY = 40
_held: dict[str, list[Memo]] = {}


class Memo(dict):
    """``memo[key]`` computes ``make(key)`` and keeps it if the key is short. With ``limit`` entries (some 200 bytes each)
    the older half goes. ``owner`` is the module that uses it."""

    def __init__(self, owner: str, limit: int, make: Callable | None = None):
        super().__init__()
        self.make, self.limit = make, limit
        _held.setdefault(owner, []).append(self)

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST_KEY:
            self[key] = value
            if len(self) > self.limit:
                self.halve()
        return value

    def halve(self) -> None:
        kept = dict(islice(self.items(), len(self) // 2, None))
        self.clear()
        self.update(kept)

    def trim(self, added: Iterable) -> None:
        """After entries were put in for the time of a slice: long keys go, and the older half if there are too many."""
        for key in added:
            if len(key) > LONGEST_KEY:
                self.pop(key, None)
        while len(self) > self.limit:
            self.halve()


def keep_only(owner: str) -> None:
    """Empty the memos of all other operators."""
    for name, memos in _held.items():
        if name != owner:
            for memo in memos:
                memo.clear()


@contextmanager
def for_task(owner: str) -> Iterator[None]:
    """A block in which a task of ``owner`` works. What it remembers goes at its end, as the worker may idle beside others."""
    keep_only(owner)
    try:
        yield
    finally:
        keep_only("")
        pa.default_memory_pool().release_unused()
