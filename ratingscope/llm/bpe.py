"""Byte-level BPE encoding and decoding (operator 9).

A pre-token is a linked list of byte positions. Every adjacent pair that is a merge goes into the
bucket of its rank; a two-level bitmap over the ranks (256 words of 256 bits) says which buckets hold
something, so the next rank is two find-first-set steps away. A bucket holds list positions in the
order of the text; entries whose pair has changed since are skipped when they come up. Each merge
adds at most two entries, so a pre-token of n bytes takes O(n) queue steps however long it is. The
pre-tokens of a slice of documents that a worker has not met yet share one queue.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from sys import byteorder

import numpy as np
import regex
from pyspark.sql import DataFrame

from ratingscope.llm.common import map_slices
from ratingscope.llm.memos import Memo
from ratingscope.llm.pretokens import chunks

#: Entries that a worker keeps of each memo: pre-tokens that begin with a space, others, and chunks of several pre-tokens.
MEMO_WORDS, MEMO_PIECES, MEMO_CHUNKS = 350_000, 20_000, 120_000
#: Bytes of pre-tokens that share a queue; a single longer one has its own.
QUEUE_BYTES = 1 << 18
#: Tokens of up to so many bytes are decoded by a table; a text with a longer one takes the other way.
TABLE_BYTES = 16


class BytePairEncoder:
    """Merge ranks of byte strings; ``encode_pieces`` gives the ids of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.findall = regex.compile(pattern).findall
        self.id_of_byte = np.array([ranks[bytes([b])] for b in range(256)])
        self.rank_of_pair = np.full(65_536, -1)
        for t, r in ranks.items():
            if len(t) == 2:
                self.rank_of_pair[t[0] << 8 | t[1]] = r
        self.bit = [1 << k for k in range(max(256, (max(ranks.values()) >> 8) + 1))]
        self.bytes_of_id = {i: t for t, i in ranks.items()}
        n = max(ranks.values()) + 1
        self.token_table, self.token_size = np.zeros((n, TABLE_BYTES), np.uint8), np.full(n, TABLE_BYTES + 1)
        for t, i in ranks.items():
            if len(t) <= TABLE_BYTES:
                self.token_table[i, : len(t)] = list(t)
                self.token_size[i] = len(t)
        self.words = Memo(__name__, MEMO_WORDS)  # packed ids of pre-tokens, with the space before them left off
        self.pieces = Memo(__name__, MEMO_PIECES)  # of those without a space before them
        self.spaced = Memo(__name__, MEMO_CHUNKS)  # of chunks of several pre-tokens, with the space before them left off

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token. All share one queue: the merges of different pre-tokens don't touch, so
        taking the lowest rank of all is taking the lowest of each."""
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        n = len(data)
        if not n:
            return [[] for _ in pieces]
        stops = np.cumsum([len(p) for p in pieces])
        first = bytearray(n + 1)  # 1 where a pre-token begins, and at the end
        for stop in [0, *stops.tolist()]:
            first[stop] = 1
        ranks = np.full(n, -1)
        ranks[:-1] = self.rank_of_pair[data[:-1] << 8 | data[1:]]
        ranks[stops[stops > 0] - 1] = -1
        # a very long pre-token takes four bytes a number
        numbers = list if n <= QUEUE_BYTES else lambda x: array("i", x)
        token = numbers(self.id_of_byte[data].tolist())  # of the part that begins at i
        end = numbers(range(1, n + 1))  # where that part ends
        before = numbers(range(-1, n - 1))  # where the part before begins
        whole, at = self.ranks.get, 0
        for stop, p in zip(stops.tolist(), pieces):  # a pre-token that is itself a token stays whole
            if (known := whole(p)) is not None:
                token[at], end[at] = known, stop
                ranks[at:stop] = -1
            at = stop
        there = np.flatnonzero(ranks >= 0)
        there = there[np.argsort(ranks[there], kind="stable")]
        kinds, starts = np.unique(ranks[there], return_index=True)
        buckets = dict(zip(kinds.tolist(), map(np.ndarray.tolist, np.split(there, starts[1:])))) if len(there) else {}
        rank_at = numbers(ranks.tolist())  # of the pair that begins at i; -1: no merge
        bit, words, top = self.bit, [0] * len(self.bit), 0
        for rank in buckets:  # bit b of words[w]: bucket 256 w + b holds positions; bit w of top: words[w] is not 0
            words[rank >> 8] |= bit[rank & 255]
            top |= bit[rank >> 8]
        data, get = b"".join(pieces), self.ranks.get
        while top:
            w = (top & -top).bit_length() - 1
            low = words[w] & -words[w]
            rank = w << 8 | low.bit_length() - 1
            words[w] ^= low
            if not words[w]:
                top ^= bit[w]
            held = buckets.pop(rank)
            held.sort()
            for k, i in enumerate(held):
                if rank_at[i] != rank:
                    continue  # stale
                mid = end[i]
                end[i] = stop = end[mid]
                token[i], rank_at[mid], lower = rank, -1, False
                pairs = []
                if first[stop]:
                    rank_at[i] = -1
                else:
                    before[stop] = i
                    pairs.append((i, data[i : end[stop]]))
                if not first[i]:
                    pairs.append((before[i], data[before[i] : stop]))
                for j, both in pairs:
                    rank_at[j] = new = get(both, -1)
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(j)
                        else:
                            buckets[new] = [j]
                            words[new >> 8] |= bit[new & 255]
                            top |= bit[new >> 8]
                        lower |= new < rank
                if lower and k + 1 < len(held):  # the rest of this bucket waits for the lower rank
                    buckets[rank] = held[k + 1 :]
                    words[w] |= low
                    top |= bit[w]
                    break
        out, i = [], 0
        for stop in stops.tolist():
            ids = []
            while i < stop:
                ids.append(token[i])
                i = end[i]
            out.append(ids)
        return out

    def _learn(self, words: set[str], pieces: set[str]) -> tuple[list[str], list[str]]:
        """Put those of these pre-tokens that are lacking into ``words`` and ``pieces``, queue by queue, and return them."""
        lacking = [w for w in words if w not in self.words], [p for p in pieces if p not in self.pieces]
        queue, size = [], 0
        for memo, space, new in zip((self.words, self.pieces), (" ", ""), lacking):
            for k, p in enumerate(new, 1):
                queue.append(p)
                size += len(p)
                if size >= QUEUE_BYTES // 4 or k == len(new):
                    memo.update(zip(queue, map(_pack, self.encode_pieces([(space + q).encode() for q in queue]))))
                    queue, size = [], 0
        return lacking

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian unsigned 32-bit integers."""
        words, pieces, spaced, findall = self.words, self.pieces, self.spaced, self.findall
        parts = [chunks(t) for t in texts]
        new = {c for _, rest in parts for c in rest}
        new = [c for c in new if c not in words and c not in spaced]
        split = {c: findall(" " + c) for c in new}
        begin = [findall(f) for f, _ in parts]
        need: tuple[set, set] = set(), set()
        for found in (*split.values(), *begin):
            for p in found:
                if len(p) > 1 and p[0] == " ":
                    need[0].add(p[1:])
                else:
                    need[1].add(p)
        learned = self._learn(*need)

        def ids(found: list[str]) -> bytes:
            return b"".join([words[p[1:]] if len(p) > 1 and p[0] == " " else pieces[p] for p in found])

        several = {c: ids(found) for c, found in split.items() if len(found) > 1}
        spaced.update(several)
        out = []
        for b, (_, rest) in zip(begin, parts):
            out.append(ids(b) + b"".join([words[c] if c in words else spaced[c] for c in rest]))
        words.trim(learned[0])
        pieces.trim(learned[1])
        spaced.trim(several)
        return out

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, dtype="<u4")
        sizes = self.token_size[ids]
        if len(ids) == 0 or sizes.max() > TABLE_BYTES:
            return b"".join(map(self.bytes_of_id.__getitem__, ids.tolist()))
        return self.token_table[ids][np.arange(TABLE_BYTES) < sizes[:, None]].tobytes()


def _pack(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BytePairEncoder:
    """The encoder of a rank file (base64 token and rank a line); once per Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return BytePairEncoder(ranks, pattern)


def encode(df: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): token ids of every text as little-endian unsigned 32-bit integers.

    One row per input row, repeated rows too. A null or empty text has no ids (empty binary); a null id stays null. Only the two
    named columns are read, so further columns of any name are harmless. A map without shuffle:
    tasks hold slices of rows and bounded memos."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(cols: list[list]) -> list[list]:
        enc = encoder(vocab_path, pattern)
        return [cols[0], enc.encode([t or "" for t in cols[1]])]

    return map_slices(df.select(id_col, text_col), run, f"`{id_col}` {kind}, ids binary")


def decode(df: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, bytes binary): the bytes that the ids stand for; null ids decode to no bytes."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(cols: list[list]) -> list[list]:
        enc = encoder(vocab_path, pattern)
        return [cols[0], cols[1], [enc.decode(x or b"") for x in cols[1]]]

    return map_slices(df.select(id_col, ids_col), run, f"`{id_col}` {kind}, ids binary, bytes binary")


def round_trip(df: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``decode`` returns for what ``encode`` returns, (id, ids, bytes), in one pass of one worker a task."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(cols: list[list]) -> list[list]:
        enc = encoder(vocab_path, pattern)
        ids = enc.encode([t or "" for t in cols[1]])
        return [cols[0], ids, [enc.decode(x) for x in ids]]

    return map_slices(df.select(id_col, text_col), run, f"`{id_col}` {kind}, ids binary, bytes binary")


def digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of what ``decode`` returns, by Spark's own functions."""
    from pyspark.sql import functions as F

    return df.select(id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
