import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ratingscope.llm import kneser_ney as kn


def padded(text):
    return bytes([kn.BEGIN]) * (kn.ORDER - 1) + text.encode()


def brute(texts):
    """Interpolated modified Kneser-Ney in dictionaries; returns p(context of 4 bytes, next)."""
    grams = Counter(padded(t)[k : k + kn.ORDER] for t in texts for k in range(len(t.encode())))
    tables = {kn.ORDER: grams}
    for k in range(kn.ORDER - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    stats = {}
    for k, c in tables.items():
        n = [sum(v == j for v in c.values()) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        d = [min(max(j - (j + 1) * y * n[j] / n[j - 1] if n[j - 1] and n[j] else 0.5 * j, 0.05), j - 0.05) for j in (1, 2, 3)]
        by = defaultdict(list)
        for g, v in c.items():
            by[g[:-1]].append(v)
        stats[k] = d, by

    def p(context, w):
        k = len(context) + 1
        lower = p(context[1:], w) if context else 1 / 256
        d, by = stats[k]
        if context not in by:
            return lower
        cut = lambda v: d[min(v, 3) - 1]
        total, v = sum(by[context]), tables[k].get(context + bytes([w]), 0)
        return ((v - cut(v)) if v else 0) / total + sum(map(cut, by[context])) / total * lower

    return p


def test_model_against_dictionaries(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("aab c\nÉé1.!X") for _ in range(r.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    model = kn.train(kn.count_ngrams(df))
    p = brute(texts)
    seen = {g for t in texts for g in (padded(t)[k : k + 5] for k in range(len(t.encode())))}
    asked = sorted(seen)[::7] + [bytes([g[0], 33, *g[2:]]) for g in sorted(seen)[::5]] + [b"zzzzz", b"zzaab", b"zzzz\x00"]
    asked = spark.createDataFrame([(int.from_bytes(g, "big"),) for g in asked], "gram long").distinct()
    got = {x.gram.to_bytes(5, "big"): x.nll for x in kn._scored(asked, model).collect()}
    assert len(got) == asked.count() > 100
    for g, nll in got.items():
        assert math.exp(-nll) == pytest.approx(p(g[:4], g[4]), rel=1e-9), g
    for context in (b"aab ", b"\xff\xff\xffa", b"zzzz"):
        assert sum(p(context, w) for w in range(256)) == pytest.approx(1)


def test_ngrams_against_a_loop():
    texts = ["", "a", "né日", "", "abcdefg"]
    grams, sizes = kn.ngrams(texts)
    assert sizes.tolist() == [len(t.encode()) for t in texts]
    assert [int(g).to_bytes(5, "big") for g in grams] == [padded(t)[k : k + 5] for t in texts for k in range(len(t.encode()))]
    assert kn.ngrams([])[0].tolist() == kn.ngrams(["", ""])[0].tolist() == []


def prose(r, n):
    return " ".join(r.choice(["the", "of", "and", "reading", "tion", "ent", "here", "walks"]) for _ in range(n)).capitalize() + "."


def test_scores_and_thresholds(spark, monkeypatch):
    monkeypatch.setattr(kn, "SLICE_BYTES", 5000)  # several slices a task
    r = random.Random(2)
    rows = [(k, prose(r, r.randint(5, 80)), "en") for k in range(400)]
    junk = [(1000, "THE!! OF!! AND!! READING!! ENT!! " * 8, "en"), (1001, "qzx vvkj %%% ### xqj " * 8, "en"), (1002, None, "en"), (1003, "", None), (1004, "was ist das", "de")]
    df = spark.createDataFrame([(*x, 0) for x in rows + junk + rows[:3]], "doc_id long, text string, lang string, keep int")
    trusted = spark.createDataFrame([(k,) for k in range(300)] + [(None,), (5,), (7777,)], "doc_id long")
    got = {x.doc_id: x for x in kn.score(df, trusted).collect()}
    assert kn.score(df, trusted).count() == 408
    assert not any(got[k].keep for k in (1000, 1001, 1002, 1003)) and got[1004].keep
    assert got[1002].perplexity is None
    assert sum(not got[k].keep for k in range(400)) <= 6  # held-out and trained prose stays
    held = {x.k for x in spark.range(300).selectExpr("id k", "pmod(xxhash64(id), 5) h").where("h = 0").collect()}
    p = brute([t for k, t, _ in [*rows, *rows[:3]] if k < 300 and k not in held])
    data = padded(rows[350][1])
    nll = [-math.log(p(data[k : k + 4], data[k + 4])) for k in range(len(data) - 4)]
    assert got[350].perplexity == pytest.approx(math.exp(np.mean(nll)), rel=1e-9)


def test_shuffle_join_of_trusted_ids_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(kn, "BROADCAST_IDS", 0)
    df = spark.createDataFrame([(1, "abc", "en")], "doc_id long, text string, lang string")
    ids = spark.createDataFrame([(1,)], "doc_id long")
    assert [x.keep for x in kn.score(df, ids).collect()] == [True]
    assert [x.keep for x in kn.score(df, ids.limit(0)).collect()] == [True]
    assert kn.score(df.limit(0), ids).count() == 0
