"""Prefix trie of conversations, counted in tables of minimal perfect hashes (operator 11).

A node is a distinct sequence of first turns, named by a 128-bit digest that is chained from turn to turn. Conversations
are read in order, so a task holds one chain at a time however long it is; what members of a node have in common
is added up by grouping, with partial sums before the shuffle.

Sums over subtrees need parents and children in one place. Nodes with many members are few and closed upwards (a child has
no more members than its parent): they are the top of the trie. Every other node belongs to a block, the subtree
below the top that it lies in, cut anew every ``BAND`` turns; so a block has few conversations and few depths, and neither a
first turn that a third of all conversations share nor one endless conversation fills a task. A task takes whole blocks,
gives their digests slots by a minimal perfect hash, scatters the counts into flat arrays and adds them up along an array of parent slots
from the deepest turn upwards. Roots of blocks hand their sums to the band above, the first band to the top.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingscope.llm.common import if_small, written

#: Digests are so many bytes; the root's is all zeros, which no digest of a turn is.
SIZE = 16
ROOT = bytes(SIZE)
#: The block of nodes of the top.
TOP = b""
#: A node with so many members, or a 250,000th of all turns, is in the top, which so has a million nodes at most.
MANY, TOP_SHARE = 256, 250_000
#: Turns of a block's depth.
BAND = 4_096
#: Nodes that share a slot table, beyond which no further block is added.
TABLE_NODES = 50_000
#: Places of a level of the perfect hash for each key that comes to it.
ROOM = 2
#: Conversation numbers of one chunk of a node's ends differ by less than two to this.
CHUNK_BITS = 12


class SlotTable:
    """A minimal perfect hash of n distinct digests (n x 2 words of 64 bits) onto 0 .. n - 1.

    A level hashes the keys that are left into twice as many places; keys alone in theirs keep it, the others go on to the
    next level. A slot is the number of kept places before its own. Each slot remembers its digest, so what is looked up is
    compared whole: a digest that isn't among the keys has no slot (-1), never another one's."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.keys = np.empty_like(keys)
        left, used = np.arange(len(keys)), 0
        while len(left):
            if len(self.levels) == 64:
                raise ValueError("digests are not distinct")
            places = ROOM * len(left)
            at = self._place(keys[left], places)
            alone = np.bincount(at, minlength=places) == 1
            slot = used + np.cumsum(alone) - 1
            self.levels.append((places, alone, slot))
            kept = alone[at]
            self.keys[slot[at[kept]]] = keys[left[kept]]
            used += int(kept.sum())
            left = left[~kept]

    def _place(self, keys: np.ndarray, places: int) -> np.ndarray:
        """Digests are random bits, so a level mixes the halves by its own odd factors."""
        n = np.uint64(2 * len(self.levels) + 1)
        with np.errstate(over="ignore"):
            mixed = keys[:, 0] * (n * np.uint64(0x9E3779B97F4A7C15)) + keys[:, 1] * (n * np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1))
        mixed ^= mixed >> np.uint64(29)
        return (mixed % np.uint64(places)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1)
        left, levels = np.arange(len(keys)), self.levels
        for k, (places, alone, slot) in enumerate(levels):
            self.levels = levels[:k]  # _place knows its level by their number
            at = self._place(keys[left], places)
            self.levels = levels
            found = alone[at]
            out[left[found]] = slot[at[found]]
            left = left[~found]
        same = out >= 0
        same[same] = (self.keys[out[same]] == keys[same]).all(axis=1)
        return np.where(same, out, -1)


def _words(column: pa.Array) -> np.ndarray:
    """Digests as an array of n x 2 words, zeros for null."""
    return np.frombuffer(b"".join(ROOT if x is None else x for x in column.to_pylist()), np.uint64).reshape(-1, 2)


# ---------------------------------------------------------------- turns and their chains


def turns(conversations: DataFrame) -> DataFrame:
    """(base, own, conv_id, turn, ident, words): each turn with the digest of role and text in place of them. base is the
    conversation that lends its first turns, own whether this is another one."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.substring(F.sha2(whole, 256), 1, 2 * SIZE)).alias("ident"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    base = F.col("conv_id") - F.col("conv_id") % 20
    return rows.select(base.alias("base"), (F.col("conv_id") != base).alias("own"), "conv_id", "turn", "ident", "words")


CHAIN = "block binary, digest binary, parent binary, parent_block binary, depth long, words long, conv_id long, ends boolean"
_CHAIN = [("block", pa.binary()), ("digest", pa.binary()), ("parent", pa.binary()), ("parent_block", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.bool_())]


class _Chain:
    """The prefixes of one conversation after the other, as rows."""

    def __init__(self, top: frozenset[bytes], band: int):
        self.top, self.band, self.rows, self.open = top, band, [], None

    def begin(self, conv: int) -> None:
        self.end()
        self.open = (TOP, ROOT, None, None, 0, 0, conv)

    def add(self, ident: bytes, words: int) -> None:
        block, digest, _, _, depth, _, conv = self.open
        self.rows.append((*self.open, False))
        new = hashlib.sha256(digest + ident).digest()[:SIZE]
        if new in self.top:
            self.open = (TOP, new, digest, None, depth + 1, words, conv)
        elif block == TOP or depth % self.band == 0:
            self.open = (new, new, digest, block, depth + 1, words, conv)
        else:
            self.open = (block, new, digest, None, depth + 1, words, conv)

    def end(self) -> None:
        if self.open:
            self.rows.append((*self.open, True))
        self.open = None

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(_CHAIN)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _CHAIN)], names=[n for n, _ in _CHAIN])


def chains(turns_: DataFrame, top: Iterable[bytes] = (), band: int = BAND) -> DataFrame:
    """One row for every prefix of every rebuilt conversation, the root's too: its digest and its parent's, depth, words of
    its last turn, whether the conversation ends there, and the block that it lies in."""
    heavy = turns_.sparkSession.sparkContext.broadcast(frozenset(top) | {ROOT})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, conv, base = _Chain(heavy.value, band), None, None
        for batch in batches:
            for b, own, c, ident, words in zip(*(batch.column(k).to_pylist() for k in ("base", "own", "conv_id", "ident", "words"))):
                if c != conv:
                    if b != base:
                        base, lent = b, []
                    conv, at, skip = c, 0, crc32(str(c).encode()) % 4 if own else 0
                    chain.begin(c)
                    for turn in lent[:skip]:
                        chain.add(*turn)
                if not own and at < 3:
                    lent.append((ident, words))
                if at >= skip:
                    chain.add(ident, words)
                at += 1
                if len(chain.rows) >= 10_000:
                    yield chain.take()
        chain.end()
        yield chain.take()

    order = ["base", "own", "conv_id", F.col("turn").asc_nulls_first(), "ident"]
    return turns_.repartition("base").sortWithinPartitions(*order).mapInArrow(run, CHAIN)


# ---------------------------------------------------------------- sums over subtrees

NODE = "block binary, digest binary, parent binary, parent_block binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _sum_up(t: pa.Table) -> pa.RecordBatch:
    """The sums of whole blocks: (digest, parent, depth, words, conv_id, n_convs, children, leaves, saved), the last three from
    blocks below."""
    t = t.combine_chunks()
    digest, parent = _words(t["digest"]), _words(t["parent"])
    number = lambda c: t[c].to_numpy()
    table = SlotTable(digest)
    own = table.slots(digest)
    up = np.where(t["parent"].is_null().to_numpy(), -1, table.slots(parent))  # the root has no parent
    n = len(own)
    above, depth, convs, conv = (np.empty(n, np.int64) for _ in range(4))
    children, leaves, saved = (np.zeros(n, np.int64) for _ in range(3))
    above[own], depth[own], convs[own], conv[own] = up, number("depth"), number("n_convs"), number("conv_id")
    children[own], leaves[own], saved[own] = number("children"), number("leaves"), number("saved") + (number("n_convs") - 1) * number("words")
    inside = above >= 0
    children += np.bincount(above[inside], minlength=n)
    leaves[children == 0] = 1
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        level = level[inside[level]]
        np.add.at(leaves, above[level], leaves[level])
        np.add.at(saved, above[level], saved[level])
    parent_conv = pa.array(np.where(inside, conv[above], 0), mask=~inside)
    slots = pa.array(own)
    take = lambda x: pc.take(x if isinstance(x, pa.Array) else pa.array(x), slots)
    whole = lambda c: t[c].combine_chunks() if t[c].num_chunks != 1 else t[c].chunk(0)
    columns = [whole("block"), whole("digest"), whole("parent"), whole("parent_block"), take(depth), take(conv), take(parent_conv), take(convs), take(children), take(leaves), take(saved)]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in NODE.split(", ")])


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_sum_up`` over tables that end where a block does."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < TABLE_NODES:
            continue
        last = held[-1].column("block")[-1].as_py()
        blocks = batch.column("block").to_pylist()
        cut = next((k for k in range(len(blocks) - 1, -1, -1) if blocks[k] != last), -1) + 1
        if cut == 0 and held[0].column("block")[0].as_py() == last:
            continue  # one block so far
        if cut == 0:  # the last block began in an earlier batch
            table = pa.Table.from_batches(held)
            whole = table["block"].to_pylist()
            at = next(k for k in range(len(whole) - 1, -1, -1) if whole[k] != last) + 1
            done, rest = table.slice(0, at), table.slice(at)
        else:
            done, rest = pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]), pa.Table.from_batches([batch.slice(cut)])
        yield _sum_up(done)
        held, rows = rest.to_batches(), rest.num_rows
    if rows:
        yield _sum_up(pa.Table.from_batches(held))


def _summed(nodes: DataFrame, below: DataFrame | None) -> DataFrame:
    """Sums of the nodes of one band, given what the roots of the band below hand up (parent, children, leaves, saved)."""
    if below is None:
        nodes = nodes.withColumns({c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")})
    else:
        nodes = nodes.join(below.withColumnRenamed("parent", "digest"), "digest", "left").fillna(0, ["children", "leaves", "saved"])
    columns = ["block", "digest", "parent", "parent_block", "depth", "words", "conv_id", "n_convs", "children", "leaves", "saved"]
    return nodes.select(columns).repartition("block").sortWithinPartitions("block").mapInArrow(_whole_blocks, NODE)


def _handed_up(summed: DataFrame) -> DataFrame:
    """What roots of blocks add to their parents."""
    return summed.where("digest = block").groupBy("parent").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))


def _ends(chain: DataFrame) -> DataFrame:
    """(digest, ends_sha256): digest of the ascending numbers of the conversations that end at a node. Numbers are joined in
    chunks first, so the task that a node's chunks come to in order hashes few rows and holds one at a time."""
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    chunks = chain.where("ends").groupBy("digest", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.array_join(ids, ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out: list[tuple[bytes, str]] = []
            for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist()):
                if digest != node:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state = digest, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _ended(out)
        if node is not None:
            yield _ended([(node, state.hexdigest())])

    return chunks.repartition("digest").sortWithinPartitions("digest", "chunk").select("digest", "ids").mapInArrow(run, "digest binary, ends_sha256 string")


def _ended(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.binary()), pa.array([e for _, e in rows], pa.string())], names=["digest", "ends_sha256"])


def trie(conversations: DataFrame, many: int = MANY, band: int = BAND) -> DataFrame:
    """All nodes of the trie of rebuilt conversations: (digest, parent digest, conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256).

    Conversation c is rebuilt as the first h turns of conversation c - c % 20 (those that it has; none if it isn't there) and
    its own turns after its first h, h being the CRC-32 of c's decimal digits modulo 4. A node's members are the rebuilt
    conversations that begin with it; conv_id is the smallest. n_children are its children, n_leaves the childless nodes of its
    subtree, itself included, saved_tokens the words that sharing saves there: each node's members but one times the words of
    its last text. ends_sha256 is the digest of the numbers, ascending and comma-joined, of the members that end there.

    A null role or text is empty. Null turns come first; turns of equal number are ordered by the digest of role and text, and
    repeated rows are turns of their own. Rows with a null conv_id belong to no conversation and are left out. A conversation
    whose rebuilt form has no turns is a member of the root. An empty table has no root and gives no rows. Only the four
    named columns are read. The chain of one conversation is followed in one task, turn by turn, and never held."""
    spark = conversations.sparkSession
    t = written(turns(conversations), "turns")
    total = t.count()
    least = max(many, total // TOP_SHARE)
    heavy = chains(t).groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("digest")
    # rebuilt turns and roots are at most five times the turns, so these are 1.25 million at most
    top = [bytes(r.digest) for r in heavy.toLocalIterator()]
    chain = written(chains(t, top, band), "chains")
    first = [F.first(c).alias(c) for c in ("parent", "parent_block", "depth", "words")]
    nodes = written(chain.groupBy("block", "digest").agg(*first, F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")), "nodes")
    level = F.when(F.col("block") != F.lit(TOP), F.floor((F.col("depth") - 1) / band)).otherwise(-1)
    deepest = nodes.agg(F.max(level)).first()[0]
    out, below = None, None
    for k in range(-1 if deepest is None else deepest, -2, -1):
        part = written(_summed(nodes.where(level == k), below), "summed")
        out = part if out is None else out.unionByName(part)
        below = _handed_up(out)
    if out is None:
        out = spark.createDataFrame([], NODE)
    # the parents of blocks' roots: the top, and the last turns of bands
    above = nodes.where((F.col("block") == F.lit(TOP)) | (F.col("depth") % band == 0)).select(F.col("digest").alias("parent"), F.col("conv_id").alias("_above"))
    inner = out.where((F.col("block") == F.lit(TOP)) | (F.col("digest") != F.col("block")))
    roots = out.where("digest = block").join(if_small(above, "parents"), "parent").withColumn("parent_conv_id", F.col("_above")).select(out.columns)
    ended = written(_ends(chain), "ends")
    nothing = hashlib.sha256(b"").hexdigest()
    all_ = inner.unionByName(roots).join(ended, "digest", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing)))
    return all_.select("digest", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: The same for DuckDB, as one statement. CRC-32 is its bitwise definition, folded over the bits of the decimal digits.
TRIE_SQL = r"""WITH t AS (SELECT conv_id AS c, octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '') AS turn_text,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, words, sha256(turn_text) AS ident, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(turn_text)) - 1 AS pos FROM t),
h AS (SELECT c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: list_transform(range(0, 8), lambda b: (ascii(d) >> b) & 1)))),
  lambda r, m: CASE WHEN xor(r, m) & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) % 4 AS h FROM (SELECT DISTINCT c FROM o)),
b AS (SELECT h.c, o.pos, o.ident, o.words FROM h JOIN o ON o.c = h.c - h.c % 20 WHERE o.pos < h.h
  UNION ALL SELECT o.c, o.pos, o.ident, o.words FROM o JOIN h USING (c) WHERE o.pos >= h.h),
p AS (SELECT c, words, row_number() OVER w AS depth, string_agg(ident, '') OVER (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING) AS path, count(*) OVER (PARTITION BY c) AS length FROM b WINDOW w AS (PARTITION BY c ORDER BY pos)
  UNION ALL SELECT h.c, 0, 0, '', coalesce(length, 0) FROM h LEFT JOIN (SELECT c, count(*) AS length FROM b GROUP BY c) USING (c)),
n AS (SELECT path, depth, any_value(words) AS words, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE depth = length), '') AS ends FROM p GROUP BY path, depth),
k AS (SELECT left(path, CAST(64 * (depth - 1) AS BIGINT)) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
s AS (SELECT up AS path, sum(CAST(n_children = 0 AS INT)) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM (SELECT n_children, n_convs, words, unnest(list_transform(range(0, CAST(depth + 1 AS BIGINT)), lambda d: left(path, CAST(64 * d AS BIGINT)))) AS up FROM m) GROUP BY 1)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s USING (path) LEFT JOIN n q ON m.depth > 0 AND q.path = left(m.path, CAST(64 * (m.depth - 1) AS BIGINT))"""
