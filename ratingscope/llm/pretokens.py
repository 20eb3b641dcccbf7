"""Cut a text into chunks that can be tokenised each on its own."""

from __future__ import annotations

import re

_CUT = re.compile(r"(?<!^)(?= \S)")
_LONE = re.compile(r" (?!\S)")


def chunks(text: str) -> tuple[str, list[str]]:
    """The text as a first chunk and further ones that each begin with a space, which is left off:
    ``first + "".join(" " + c for c in rest)`` is the text.

    A space followed by a non-space always begins a new match of the pre-token pattern (the match is
    `` ?letters``, `` ?digits`` or `` ?others``), so each chunk can be treated on its own."""
    if _LONE.search(text) is None:
        first, *rest = text.split(" ")
    else:
        first, *rest = _CUT.split(text)
        rest = [c[1:] for c in rest]
    if not first and rest:  # the text begins with a space
        return " " + rest[0], rest[1:]
    return first, rest
