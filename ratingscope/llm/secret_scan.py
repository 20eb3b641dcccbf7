"""Secret scan with guess costs (operator 13).

Three patterns find what has the form of a secret: assignments, access keys and long hexadecimal runs. They miss passwords that
hold other characters or stand behind other names, and there the form says little: what follows ``pwd:`` may be a word. So each value in
a credential context is judged by what guessing it would cost, the cheapest way to put it together from common words, dates, repeats,
keyboard walks and spans that have to be tried character by character. A dynamic programme over the value finds it: the
least cost of every prefix is that of a shorter one and of the piece between them. Costs are decimal logarithms of guesses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from math import inf, log10

from pyspark.sql import DataFrame

from ratingscope.llm.common import map_slices

# The three forms, with the least length of what they match (of the value, for assignments).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of fewer fails anyway
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "guess")

#: Names that a credential stands behind: after them comes a colon or an equals sign.
NAMES = ("password", "passwd", "passphrase", "passwort", "kennwort", "passcode", "pwd", "pw", "secret", "token", "api[_-]?key", "access[_-]?key", "secret[_-]?key", "private[_-]?key", "credentials?", "contraseña", "mot de passe")
_VALUE = r"""([^\s"'`,;<>(){}\[\]]+)"""
CONTEXTS = (
    re.compile(r"(?i:" + "|".join(NAMES) + r""")["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*["'`]?""" + _VALUE),
    re.compile(r"(?i:bearer|basic)[\x20\t]+" + _VALUE),
    re.compile(r"://[^\s/:@\"'<>]+:([^\s/@\"'<>]+)@"),  # user:value@host
)

#: Words that guessing begins with, the commonest first.
WORDS = (
    "password", "admin", "welcome", "qwerty", "letmein", "monkey", "dragon", "master", "login", "secret", "love", "sunshine", "princess", "football", "baseball", "shadow", "iloveyou",
    "superman", "batman", "trustno", "hello", "freedom", "whatever", "starwars", "test", "guest", "root", "user", "default", "changeme", "pass", "passwort", "token", "key", "demo", "example",
    "sample", "temp", "summer", "winter", "spring", "autumn", "monday", "january", "secure", "server", "system", "oracle", "mysql", "postgres", "redis", "public", "private", "internal", "the",
    "your", "here", "none", "null", "true", "false", "undefined", "required", "optional", "string", "value", "change", "please", "insert", "placeholder", "dummy", "foo", "bar", "xxx", "prod", "dev",
)
RANK = {w: k for k, w in enumerate(WORDS, 1)}
#: The rows of a keyboard, and letters that stand for others.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
STANDS_FOR = {"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t"}
DATE = re.compile(r"(?:(?P<y1>19\d\d|20\d\d)(?P<s>[-/._]?)(?:0?[1-9]|1[0-2])(?P=s)(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])(?P<t>[-/._]?)(?:0?[1-9]|1[0-2])(?P=t)(?P<y2>19\d\d|20\d\d)|(?P<y3>19\d\d|20\d\d))")

#: Guesses for a character that nothing explains, for the border between two pieces, and the year that dates are counted from.
CHARACTER, BORDER, YEAR = 1.0, log10(2), 2020
#: The longest repeated unit and the longest walk that may end anywhere; a longer walk counts as a whole.
LONGEST_UNIT, LONGEST_WALK = 16, 24
#: A value that takes so many guesses is a secret.
SECRET = 10.0

_AT = {c: (x + y / 2, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
#: Direction of each pair of neighbouring keys.
_STEP = {(a, b): (xb - xa, yb - ya) for a, (xa, ya) in _AT.items() for b, (xb, yb) in _AT.items() if a != b and abs(xb - xa) <= 1 and abs(yb - ya) <= 1}
_LONGEST_WORD = max(map(len, WORDS))


def _words(low: str, plain: str, value: str, i: int) -> Iterator[tuple[int, float]]:
    for j in range(i + 2, min(len(value), i + _LONGEST_WORD) + 1):
        for text, swapped in ((low[i:j], False), (plain[i:j], True)):
            rank = RANK.get(text)
            if rank is not None:
                part = value[i:j]
                upper = sum(c.isupper() for c in part)
                yield j, log10(rank) + (0 if not upper else log10(2) if part[0].isupper() and upper in (1, len(part)) else upper * log10(2)) + (log10(2) * sum(c in STANDS_FOR for c in part) if swapped else 0)
                break


def _walk_ends(low: str) -> tuple[list[int], list[int]]:
    """For each beginning where the walk over neighbouring keys ends, and its turns up to there."""
    n = len(low)
    ends, turns, after = list(range(1, n + 1)), [0] * n, None
    for i in range(n - 2, -1, -1):
        step = _STEP.get((low[i], low[i + 1]))
        if step:
            ends[i], turns[i] = ends[i + 1], turns[i + 1] + (step != after)
        after = step
    return ends, turns


def _walks(low: str, i: int, whole: int, whole_turns: int) -> Iterator[tuple[int, float]]:
    """Three or more neighbouring keys, or characters that follow each other; each turn has some five ways to go."""
    turns, last = 0, None
    for j in range(i + 2, min(whole, i + LONGEST_WALK) + 1):
        step = _STEP[low[j - 2], low[j - 1]]
        turns, last = turns + (step != last), step
        if j - i >= 3:
            yield j, log10(len(_AT)) + turns * log10(5) + log10(j - i)
    if whole - i > LONGEST_WALK:
        yield whole, log10(len(_AT)) + whole_turns * log10(5) + log10(whole - i)
    for by in (1, -1):
        j = i + 1
        while j < len(low) and low[j].isascii() and low[j].isalnum() and ord(low[j]) - ord(low[j - 1]) == by:
            j += 1
            if j - i >= 3:
                yield j, log10(36) + log10(2) + log10(j - i)


def _dates(value: str, i: int) -> Iterator[tuple[int, float]]:
    m = DATE.match(value, i)
    if m:
        year = log10(max(20, abs(int(m["y1"] or m["y2"] or m["y3"]) - YEAR)))
        yield m.end(), year + (0 if m["y3"] else log10(365) + (log10(4) if (m["s"] or m["t"]) else 0))
        if not m["y3"] and (y := re.match(r"19\d\d|20\d\d", value[i : i + 4])):
            yield i + 4, log10(max(20, abs(int(y[0]) - YEAR)))


def _repeats(value: str) -> list[list[tuple[int, int]]]:
    """For each beginning the (unit, number) of the repeats there, each as often as it goes on."""
    n = len(value)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for unit in range(1, min(LONGEST_UNIT, n // 2) + 1):
        same = 0
        for i in range(n - unit - 1, -1, -1):
            same = same + 1 if value[i] == value[i + unit] else 0
            if same >= unit and (unit > 1 or same >= 2):
                out[i].append((unit, same // unit + 1))
    return out


def guess_cost(value: str) -> float:
    """The decimal logarithm of the guesses that the cheapest segmentation takes; 0 for an empty value."""
    n = len(value)
    low = value.lower() if len(value.lower()) == n else value
    plain = "".join(STANDS_FOR.get(c, c) for c in low)
    repeats, (walk_ends, walk_turns) = _repeats(value), _walk_ends(low)
    unit_cost = lru_cache(maxsize=1024)(guess_cost)
    best = [inf] * (n + 1)  # of the prefix of each length
    best[0] = 0.0
    tried = inf  # of the prefix that ends in a span without explanation
    for i in range(n):
        here = best[i] + (BORDER if i else 0.0)
        for pieces in (_words(low, plain, value, i), _walks(low, i, walk_ends[i], walk_turns[i]), _dates(value, i), ((i + u * k, unit_cost(value[i : i + u]) + log10(k)) for u, k in repeats[i])):
            for j, cost in pieces:
                if here + cost < best[j]:
                    best[j] = here + cost
        tried = min(tried, here) + CHARACTER
        if tried < best[i + 1]:
            best[i + 1] = tried
    return best[n]


def _is_prose(value: str) -> bool:
    """Letters alone, of one case but for the first: a word, not a secret."""
    rest = value[1:].replace("-", "")
    return value.replace("-", "").isalpha() and (rest == rest.lower() or value == value.upper())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what has the form of a secret, from the left, without overlap within a kind."""
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    return sorted(out)


def guessed_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Values in a credential context that cost ``SECRET`` guesses or more and that no form has found; not references to values
    kept elsewhere, addresses, or words of prose."""
    found = set()
    for k, context in enumerate(CONTEXTS):
        if k != 1 and ":" not in text and "=" not in text:
            continue
        for m in context.finditer(text):
            value = m[1].rstrip(".:!?")
            start, end = m.start(1), m.start(1) + len(value)
            if not value or value[0] in "$%" or "://" in value or (k == 0 and re.search(r"@[\w-]+\.", value)) or _is_prose(value):
                continue
            if not any(a < end and start < b for a, _, b in base) and guess_cost(value) >= SECRET:
                found.add((start, 3, end))
    return sorted(found)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_guess long, base_sha256 string, spans string) of every text.

    Spans are ``kind:start:end`` in code points, the end exclusive, by start and then kind, comma-joined; base_sha256 is the digest of
    those of the three forms alone (without any, of the empty string). For an assignment the span is all that the pattern matches, for a guess
    the value. A null or empty text has none; a null id stays null; repeated rows give repeated rows. Only the two named columns are
    read. The whole of every text is searched and the whole of every value judged. A map without shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(cols: list[list]) -> list[list]:
        counts, digests, spans = [[], [], [], []], [], []
        for text in cols[1]:
            base = base_spans(text or "")
            more = guessed_spans(text or "", base)
            joined = lambda found: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)
            for k, c in enumerate(counts):
                c.append(sum(x[1] == k for x in base) if k < 3 else len(more))
            digests.append(sha256(joined(base).encode()).hexdigest())
            spans.append(joined(sorted(base + more)))
        return [cols[0], *counts, digests, spans]

    return map_slices(df.select(id_col, text_col), run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")
