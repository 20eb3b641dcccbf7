import hashlib
import random
import re
from collections import defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pytest

from ratingscope.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, digest string, n_convs int"


def by_hand(rows):
    """The same from dictionaries of tuples."""
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            ident = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            turns[c].append((turn is not None, turn or 0, ident, role, text))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in turns.items()}
    members = defaultdict(set)
    whole = {}
    for c, own in turns.items():
        h, base = crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        whole[c] = tuple(turns.get(base, [])[:h] + own[h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].add(c)
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        leaves[n] = sum(leaves[c] for c in children[n]) or 1
        saved[n] = (len(members[n]) - 1) * words + sum(saved[c] for c in children[n])
    ends = {n: ",".join(map(str, sorted(c for c in m if whole[c] == n))) for n, m in members.items()}
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in members.items()
    )


def nodes(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.select(COLUMNS).collect())


def fixture():
    r = random.Random(5)
    rows = []
    for c in [*range(-25, 300), 10**12, 10**12 + 1]:
        hot = r.random() < 0.4
        for turn in range(r.choice((0, 1, 1, 2, 4, 9))):
            text = f"shared {turn} a  b" if hot and turn < 7 else r.choice(("x", "y z", None, "", "　wide\x1fone \x0b two"))
            rows.append((c, None if turn == 0 and c % 7 == 0 else turn, r.choice(("user", "user", None)), text, "clash", 7))
    rows += [(None, 1, "user", "nobody's", "", 0), (5, 1, "user", "twice", "", 0), (5, 1, "user", "twice", "", 0), (6, 2, "b", "tie", "", 0), (6, 2, "a", "tie", "", 0)]
    rows += [(400, t, "user", f"turn {t % 3}", "", 0) for t in range(120)] + [(401, t, "user", f"turn {t % 3}", "", 0) for t in range(121)]
    rows += [(402, 0, "user", "long " * 200_000, "", 0)]
    return rows


@pytest.mark.parametrize("many, band, table", [(256, 4096, 50_000), (3, 4, 30), (2, 1, 1)])
def test_as_by_hand(spark, monkeypatch, many, band, table):
    """Also with a large top, blocks cut every few turns and small tables."""
    monkeypatch.setattr(prefix_trie, "TABLE_NODES", table)
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA)
    if band == 1:  # a band is a job
        rows = [r for r in rows if r[0] is None or r[0] < 400]
        df = df.where("conv_id is null or conv_id < 400")
    assert nodes(prefix_trie.trie(df, many=many, band=band)) == by_hand(rows)


def test_sql_gives_the_same(spark, tmp_path):
    rows = [r for r in fixture() if r[0] != 402]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/t")
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW conversations AS FROM '{tmp_path}/t/*.parquet'")
        got = db.sql(prefix_trie.TRIE_SQL).fetchall()
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got) == by_hand(rows)


def test_empty_table(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "u", "t", "", 0)], SCHEMA)).count() == 0


def test_slots_are_minimal_perfect_and_verified():
    r = np.random.default_rng(1)
    keys = r.integers(0, 2**63, (20_000, 2), dtype=np.uint64)
    keys[:50, 0] = 7  # equal halves
    table = prefix_trie.SlotTable(keys)
    assert np.array_equal(np.sort(table.slots(keys)), np.arange(len(keys)))
    other = keys.copy()
    other[:, 1] += np.uint64(1)
    assert (table.slots(other) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.SlotTable(keys[[3, 3]])
