"""Alignment of the tokens of two tokenizers (operator 12).

Both tokenizers take the whole text. Neither joins anything across a single space between two words, so a worker has the libraries
tokenise each word once and remembers which window it is. There lies an anchor: tokens of both end, verified on their bytes, and the
next ones of both begin with the space. What lies between two anchors is a window, and one window comes back over and over. So the
alignment of a window is worked out once for its two tuples of ids and remembered: groups between shared ends, and links between
overlapping tokens. Every stretch between two neighbouring ends, of either tokenizer, lies in one token of each and is their link; so new windows
are aligned all together, as arrays of ends.

How many documents hold a pair of ids linked is known only after all of them were aligned. Documents are aligned in slices of some
megabytes of text; a slice is a row with its distinct pairs and, packed, which of them each document holds how often. Pairs are
counted over all slices by a grouping, and the counts come back to the slices that hold the pair by a join, so a pair of which all
documents are full has a row a slice. No table of pairs is broadcast or passes through the driver.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingscope.llm import memos
from ratingscope.llm.common import slices, written
from ratingscope.llm.token_counts import _byte_of_char

#: Rows and bytes of a slice; a single text may be longer.
SLICE_ROWS, SLICE_BYTES = 8_192, 4 << 20
#: Words that a worker remembers.
MEMO_WORDS = 200_000
#: A pair of ids is one number: A's id times this plus B's.
ID_B = 1 << 20

#: Words that are tokenised at once.
JOINED = 500

_BETWEEN_WORDS = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


def _plain(word: str) -> bool:
    """Whether spaces before and after the word are single ones between words."""
    return word != "" and not word[0].isspace() and not word[-1].isspace() and "▁" not in word


#: Groups as text, their number, pairs of overlapping tokens as 64-bit integers, tokens of A, tokens of B.
Aligned = tuple[str, int, bytes, int, int]


class Aligner:
    """The two tokenizers, their tokens' bytes, and the words and windows met so far."""

    def __init__(self, path_a: str, path_b: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = _byte_of_char()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for s, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(back[c] for c in s)
        # where merges are in the order of their ids, as tiktoken has it, that library gives the same tokens in an eighth of the time
        with open(path_a, encoding="utf-8") as f:
            model = json.load(f)["model"]
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        ranks = {bytes(back[c] for c in s): i for s, i in model["vocab"].items() if s not in special}
        self.quick = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if made == sorted(made) else None
        piece, n = self.b.id_to_piece, self.b.get_piece_size()
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(n)]
        self.sizes = [np.array([len(t) for t in x]) for x in (self.bytes_a, self.bytes_b)]
        # an id with what follows it: of A a comma or the bar, of B a comma or the end of the group
        self.written = [f"{i}{c}" for n, end in ((len(self.bytes_a), "|"), (len(self.bytes_b), ";")) for i in range(n) for c in (",", end)]
        self.known = memos.Memo(__name__, MEMO_WORDS)  # of each word the ids of its window; None: the tokens' bytes aren't the word's
        self.windows = memos.Memo(__name__, MEMO_WORDS)

    def _matching(self, words: list[bytes], ids: list[bytes], k: int) -> np.ndarray:
        """Whether the bytes of each word's tokens are the word's."""
        table = (self.bytes_a, self.bytes_b)[k]
        flat = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.array([len(w) for w in words])
        stops = np.cumsum([len(x) // 4 for x in ids])
        ends = np.concatenate([[0], np.cumsum(self.sizes[k][flat])])[stops]
        if (ends == np.cumsum(sizes)).all() and b"".join(map(table.__getitem__, flat.tolist())) == b"".join(words):
            return np.ones(len(words), bool)
        parts = np.split(flat, stops[:-1])
        return np.array([b"".join(map(table.__getitem__, x.tolist())) == w for x, w in zip(parts, words)], bool)

    def _align_windows(self, keys: list[tuple[bytes, bytes]]) -> list[Aligned]:
        """Of windows, each two tuples of ids that stand for the same bytes."""
        (a, b), ends, counts = (np.frombuffer(b"".join(k[side] for k in keys), "<u4").astype(np.int64) for side in (0, 1)), [], []
        for side, x in enumerate((a, b)):
            ends.append(np.cumsum(self.sizes[side][x]))
            counts.append(np.array([len(k[side]) // 4 for k in keys]))
        marks = np.zeros(int(ends[0][-1]) + 1, np.int8)
        marks[ends[0]] += 1
        marks[ends[1]] += 1
        every, shared = np.flatnonzero(marks), np.flatnonzero(marks == 2)
        pairs = a[np.searchsorted(ends[0], every)] * ID_B + b[np.searchsorted(ends[1], every)]
        stops = ends[0][np.cumsum(counts[0]) - 1]  # where windows end
        links, groups = np.diff(np.searchsorted(every, stops, side="right"), prepend=0), np.diff(np.searchsorted(shared, stops, side="right"), prepend=0)
        of = [np.searchsorted(shared, e) for e in ends]  # the group of each token
        last = [np.append(g[1:] != g[:-1], True) for g in of]
        codes = np.concatenate([2 * a + last[0], 2 * len(self.bytes_a) + 2 * b + last[1]])
        codes = codes[np.argsort(np.concatenate([2 * of[0], 2 * of[1] + 1]), kind="stable")]
        texts, packed = list(map(self.written.__getitem__, codes.tolist())), pairs.tobytes()
        out, at, link = [], 0, 0
        for n_a, n_b, n_groups, n_links in zip(counts[0].tolist(), counts[1].tolist(), groups.tolist(), links.tolist()):
            out.append(("".join(texts[at : at + n_a + n_b])[:-1], n_groups, packed[8 * link : 8 * (link + n_links)], n_a, n_b))
            at, link = at + n_a + n_b, link + n_links
        return out

    def _tokens_a(self, words: list[str], whole: list[bytes]) -> list[bytes]:
        """Packed ids of A for words with the space before them. Words between single spaces are tokenised in one go."""
        out: dict[str, bytes] = {}
        plain = [k for k, w in enumerate(words) if _plain(w)] if self.quick else []
        for part in (plain[k : k + JOINED] for k in range(0, len(plain), JOINED)):
            ids = np.array(self.quick.encode_ordinary(" " + " ".join([words[k] for k in part])), "<u4")
            ends, stops = np.cumsum(self.sizes[0][ids]), np.cumsum([len(whole[k]) for k in part])
            upto = np.searchsorted(ends, stops)
            if (ends[upto] == stops).all():  # else they are tokenised one by one
                packed, at = ids.tobytes(), 0
                for k, stop in zip(part, (4 * (upto + 1)).tolist()):
                    out[words[k]] = packed[at:stop]
                    at = stop
        rest = [w for w in words if w not in out]
        out.update((w, array("I", e.ids).tobytes()) for w, e in zip(rest, self.a.encode_batch_fast([" " + w for w in rest], add_special_tokens=False)))
        return [out[w] for w in words]

    def _learn(self, new: list[str]) -> None:
        """Tokenise words that haven't been met, A with the space before them, B adds it, and align new windows."""
        whole = [b" " + w.encode() for w in new]
        ids_a, ids_b = self._tokens_a(new, whole), [array("I", x).tobytes() for x in self.b.encode(new, num_threads=1)]
        good = self._matching(whole, ids_a, 0) & self._matching(whole, ids_b, 1)
        keys = [(x, y) if g else None for x, y, g in zip(ids_a, ids_b, good.tolist())]
        self.known.update(zip(new, keys))
        fresh = list({k for k in keys if k and k not in self.windows})
        if fresh:
            self.windows.update(zip(fresh, self._align_windows(fresh)))

    def align(self, texts: list[str]) -> tuple[list[list], np.ndarray, np.ndarray]:
        """Per document n_a, n_b, n_groups, n_links, groups_sha256; and for all links of all documents the number of the
        document and the pair."""
        cut = [t.split(" ") if t else [] for t in texts]
        odd = {w for w in set().union(*cut) if not _plain(w)}
        if odd:
            cut = [c if odd.isdisjoint(c) else _BETWEEN_WORDS.split(t) for c, t in zip(cut, texts)]
        distinct = list(set().union(*cut))
        new = [w for w in distinct if w not in self.known]
        if new:
            self._learn(new)
        ids = [self.known[w] for w in distinct]
        found = [self.windows[k] if k else None for k in ids]
        self.known.trim(new)
        for gone in self.windows.keys() - set(self.known.values()) if len(self.windows) > len(self.known) else ():
            del self.windows[gone]
        numbers = np.fromiter(map({w: k for k, w in enumerate(distinct)}.__getitem__, chain.from_iterable(cut)), np.int64)
        doc = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
        wrong = np.array([f is None for f in found], bool)
        good = ~np.isin(doc, doc[wrong[numbers]])
        numbers, doc = numbers[good], doc[good]
        found = [f or ("", 0, b"", 0, 0) for f in found]
        of = lambda k: np.array([f[k] for f in found], np.int64)
        n_links = np.array([len(f[2]) // 8 for f in found], np.int64)
        summed = [np.bincount(doc, x[numbers], len(texts)).astype(np.int64).tolist() for x in (of(3), of(4), of(1), n_links)]
        parts, listed, digests, since = [f[0] for f in found], numbers.tolist(), [], 0
        for stop in np.searchsorted(doc, np.arange(len(texts)), side="right").tolist():
            digests.append(sha256(";".join(map(parts.__getitem__, listed[since:stop])).encode()).hexdigest() if stop > since else "")
            since = stop
        flat, first = np.frombuffer(b"".join(f[2] for f in found), np.int64), np.cumsum(n_links) - n_links
        each = n_links[numbers]
        at = np.repeat(first[numbers] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        return [*summed, digests], np.repeat(doc, each), flat[at]


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str, pattern: str) -> Aligner:
    return Aligner(path_a, path_b, pattern)


_STATS = ("n_a long", "n_b long", "n_groups long", "n_links long", "groups_sha256 string")


def align(df: DataFrame, path_a: str, path_b: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum long, groups_sha256) of every text.

    A's tokens are those of a space and the text, B's those of the text, special strings being plain text; ``pattern`` is what A's
    file splits texts by. Bytes where tokens
    of both end cut them into groups; n_links counts the pairs of overlapping tokens. A pair of ids counts the documents that
    hold it linked, rows that repeat being documents of their own; count_sum adds the counts of a document's links, n_best is how
    many of them have the highest count that A's id has. groups_sha256 is the digest of the groups in order, ``a1,a2|b1;a3|b2``.

    Null and empty texts, and those whose tokens' bytes aren't a space and the text (as with U+2581), have no tokens: zeros and
    an empty string; a null id stays null. An empty table gives no rows. Only the two named columns are read."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = df.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"ids array<{kind}>", *(f"{c.split()[0]} array<{c.split()[1]}>" for c in _STATS), "pairs array<long>", "held_by array<long>", "packed binary"])
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def of_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with memos.for_task(__name__):
            tool = aligner(path_a, path_b, pattern)
            for batch in batches:
                for part in slices(batch, SLICE_ROWS, SLICE_BYTES):
                    stats, doc, pair = tool.align([t or "" for t in part.column(1).to_pylist()])
                    pairs, at = np.unique(pair, return_inverse=True)
                    held, times = np.unique(doc * max(1, len(pairs)) + at, return_counts=True)
                    doc, at = held // max(1, len(pairs)), held % max(1, len(pairs))
                    per_doc = np.bincount(doc, minlength=part.num_rows)
                    packed = zlib.compress(b"".join(x.astype("<u4").tobytes() for x in (per_doc, np.diff(at, prepend=0), times)), 1)
                    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                    arrays = [one(part.column(0)), *(one(pa.array(x, f.type.value_type)) for x, f in zip(stats, list(arrow)[1:])), one(pa.array(pairs)), one(pa.array(np.bincount(at, minlength=len(pairs)))), pa.array([packed])]
                    yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, arrow)], schema=arrow)

    table = written(df.select(id_col, text_col).mapInArrow(of_slices, schema).withColumn("slice", F.monotonically_increasing_id()), "aligned")
    held = table.select(F.explode(F.arrays_zip("pairs", "held_by")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.held_by").alias("count"))
    best = F.max("count").over(Window.partitionBy(F.floor(F.col("pair") / ID_B)))  # an id of A has as many rows as B has ids, at most
    counts = held.withColumn("best", F.col("count") == best)
    mine = table.select("slice", F.posexplode("pairs").alias("at", "pair")).join(counts, "pair")
    # as many rows of a slice as it has distinct pairs
    back = mine.groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("at", "count", "best"))).alias("c"))
    met = table.join(back, "slice", "left").select("ids", *(c.split()[0] for c in _STATS), "packed", F.col("c.count").alias("count"), F.col("c.best").alias("best"))
    result = f"`{id_col}` {kind}, " + ", ".join([*_STATS[:4], "n_best long", "count_sum long", _STATS[4]])
    out_arrow = to_arrow_schema(_parse_datatype_string(result))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = lambda c: batch.column(c).slice(k, 1).flatten()
                ids = one("ids")
                n, raw = len(ids), np.frombuffer(zlib.decompress(batch.column("packed")[k].as_py()), "<u4").astype(np.int64)
                per_doc, (step, times) = raw[:n], np.split(raw[n:], 2)
                at = np.cumsum(step.astype(np.int32).astype(np.int64))  # steps back were packed as large numbers
                sums = []
                for c in ("best", "count"):
                    value = one(c).to_numpy(zero_copy_only=False).astype(np.int64)
                    added = np.concatenate([[0], np.cumsum(value[at] * times)]) if len(at) else np.zeros(1, np.int64)
                    stop = np.cumsum(per_doc)
                    sums.append(pa.array(added[stop] - added[stop - per_doc]))
                yield pa.RecordBatch.from_arrays([ids, *(one(c.split()[0]) for c in _STATS[:4]), *sums, one("groups_sha256")], schema=out_arrow)

    return met.mapInArrow(finish, result)
