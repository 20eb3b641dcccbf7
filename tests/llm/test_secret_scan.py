import random
import re
from hashlib import sha256
from math import inf, log10

import pytest

from ratingscope.llm import secret_scan as scan

SCHEMA = "doc_id long, text string, n_hex string, spans int"


def slow_base(text):
    """The three forms, from their definitions, match by match."""
    out = []
    for k, pattern, flags, least in ((0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 8), (1, "AKIA[A-Z0-9]+", 0, 16), (2, "[0-9a-f]+", 0, 32)):
        at = 0
        while m := re.compile(pattern, flags).search(text, at):
            at = m.end()
            if len(m[2] if k == 0 else m[0]) >= least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def slow_cost(value):
    """The least cost over all segmentations, by trying all of them."""
    low = value.lower()
    plain = "".join(scan.STANDS_FOR.get(c, c) for c in low)
    repeats, (ends, turns) = scan._repeats(value), scan._walk_ends(low)
    pieces = lambda i: [*scan._words(low, plain, value, i), *scan._walks(low, i, ends[i], turns[i]), *scan._dates(value, i), *((i + u * k, slow_cost(value[i : i + u]) + log10(k)) for u, k in repeats[i])]

    def rest(i, first=True):
        if i == len(value):
            return 0.0
        border = 0.0 if first else scan.BORDER
        known = [cost + rest(j, False) for j, cost in pieces(i)]
        spans = [(j - i) * scan.CHARACTER + rest(j, False) for j in range(i + 1, len(value) + 1)]
        return border + min(known + spans, default=inf)

    return rest(0)


def test_cost_is_the_least_of_all_segmentations():
    r = random.Random(4)
    for _ in range(150):
        value = "".join(r.choice(("pass", "word", "admin", "P@ss", "qwe", "abc", "321", "1", "z", "xx", "2019", "-", "é", "aa")) for _ in range(r.randint(1, 4)))[:11]
        assert scan.guess_cost(value) == pytest.approx(slow_cost(value)), value


def test_costs_order_as_guessing_does():
    cost = scan.guess_cost
    assert cost("") == 0 and cost("password") == 0
    assert cost("password") < cost("Password") < cost("P@ssword") < cost("P@ssword2019") < cost("P@ssword2019x7!") < cost("tR8!kz0qVw7")
    for weak in ("password123", "qwertyuiop", "aaaaaaaaaaaaaaaa", "abcabcabcabcabc", "2019-12-31", "admin2020", "zxcvbnm,./", "changeme123", "letmein!!"):
        assert cost(weak) < scan.SECRET, weak
    for strong in ("tR8!kz0qVw7", "correct-horse-battery", "9f!2kd#L0s", "3da3a2ce706927ddf6"):
        assert cost(strong) >= scan.SECRET, strong
    for n in (10, 1000, 200_000):  # repeats and walks of any length
        assert cost("x" * n) < 8 and cost("ab1" * n) < 10
    assert cost("qw" * 30_000) < cost("kz8!" + "qw" * 30_000)
    r = random.Random(1)
    assert cost("".join(r.choice("abcdefghxyz0189") for _ in range(20_000))) > 5_000


def texts():
    r = random.Random(9)
    bits = ["password", "PassWord", "token", "api_key", "apikey", "ſecret", "toKen", "=", ":", " ", "  ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "Zz+/9_", ".-", "é", "日", "\n", "x", "none"]
    out = ["".join(r.choice(bits) for _ in range(r.randint(1, 25))) for _ in range(3000)]
    return [*out, "", None, "same password=abcdefgh1", "same password=abcdefgh1", "a" * 300_000, "password" * 30_000, "AKIA" * 50_000, "é" * 1000 + " token = '" + "f" * 100_000 + "'"]


def test_forms_as_by_hand(spark):
    docs = spark.createDataFrame([(k if k % 9 else None, t, "clash", 1) for k, t in enumerate(texts())], SCHEMA)
    rows = scan.find(docs).collect()
    joined = lambda found: ",".join(f"{scan.KINDS[k]}:{a}:{b}" for a, k, b in found)
    want = []
    for k, t in enumerate(texts()):
        base = slow_base(t or "")
        want.append((str(k if k % 9 else None), sha256(joined(base).encode()).hexdigest(), *(sum(x[1] == n for x in base) for n in range(3))))
    assert sorted((str(r.doc_id), r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in rows) == sorted(want)
    for r in rows:
        spans = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        kept = ",".join(":".join(x) for x in spans if x[0] != "guess")
        assert sha256(kept.encode()).hexdigest() == r.base_sha256 and r.n_guess == sum(x[0] == "guess" for x in spans)
        assert spans == sorted(spans, key=lambda x: (int(x[1]), scan.KINDS.index(x[0])))


def test_guesses_add_what_the_forms_miss():
    found = lambda t: [t[a:b] for a, _, b in scan.guessed_spans(t, scan.base_spans(t))]
    assert found("pwd: tR8!kz0qVw7.") == ["tR8!kz0qVw7"]
    assert found("password = x!9Lq#72pZ and more") == ["x!9Lq#72pZ"]
    assert found("see postgres://me:q8Zr!77kLp@host/db") == ["q8Zr!77kLp"]
    assert found("Authorization: Bearer eyJhbGciOi.J9.x_2") == ["eyJhbGciOi.J9.x_2"]
    for clean in ("password: required", "the token = undefined", "Passwort: Sicherheitsabfrage", "secret: ${VAULT_SECRET_12345}", "password: P@ssw0rd", "pwd=admin2020", "token: https://example.com/a1b2c3d4", "pw = someone99@example.com", "pass the salt", "no secret here", "PASSWORD: CHANGEME"):
        assert found(clean) == [], clean
    assert found("password=abcdefgh1!Q9z#") == []  # within an assignment


def test_empty_table(spark):
    assert scan.find(spark.createDataFrame([], SCHEMA)).count() == 0
