"""Token counts at every prefix (operator 2).

In byte-level BPE a sequence of tokens is an encoding exactly when every two neighbours are: encoded
together they stay these two tokens. So the encoding of a prefix of i bytes ends in the one token that
(a) the vocabulary has and (b) may follow the last token of the prefix that it leaves. Going from left
to right, ``last[i]`` and ``count[i] = count[i - len(last[i])] + 1`` are found for every prefix, and
questions such as "how much text fits in 1,024 tokens" are read off without encoding anything again.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import regex
from pyspark.sql import DataFrame

from ratingscope.llm.common import map_slices
from ratingscope.llm.memos import Memo
from ratingscope.llm.pretokens import chunks

#: Entries that a worker keeps of each memo.
MEMO_CHUNKS, MEMO_PIECES, MEMO_PAIRS = 200_000, 150_000, 200_000


def _byte_of_char() -> dict[str, int]:
    """The byte alphabet of byte-level BPE files: printable Latin-1 characters stand for themselves,
    the other bytes for characters from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Counts of the tokens of texts and of all their prefixes, under a byte-level BPE vocabulary."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, back = spec["model"], _byte_of_char()
        to_bytes = lambda s: bytes(back[c] for c in s)
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        marks = {t["content"] for t in spec.get("added_tokens", [])}
        self.ids = {to_bytes(s): i for s, i in model["vocab"].items() if s not in marks}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = model["vocab"]
        self.merged = {(ids[a], ids[b]): k for k, (a, b) in enumerate(merges)}  # pair -> rank of the merge
        self.parts = {ids[a + b]: (ids[a], ids[b]) for a, b in merges}
        self.rank = {ids[a + b]: k for k, (a, b) in enumerate(merges)}  # of the merge that makes a token
        self.begins = {t[:k]: -1 for t in self.ids for k in range(1, len(t))} | self.ids  # -1: only the beginning of tokens
        self.findall = regex.compile(pattern).findall
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.pairs = Memo(__name__, MEMO_PAIRS, self._stay_apart)
        self.pieces = Memo(__name__, MEMO_PIECES, lambda p: self.prefix_counts(p.encode())[-1])
        self.spaced = Memo(__name__, MEMO_CHUNKS, lambda c: self._chunk(" " + c))

    def _stay_apart(self, pair: tuple[int, int]) -> bool:
        """Whether tokens a, b in a row stay so when their bytes are encoded: undo the merges that made
        them, latest first, and look for a merge across the border that would have come before."""
        (a, b), limit = pair, len(self.merged) + 1
        merged, parts, rank = self.merged, self.parts, self.rank
        while True:
            across = merged.get((a, b))
            if across is not None and across < limit:
                return False
            made_a, made_b = rank.get(a, -1), rank.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:  # of merges of one rank the left one comes first, so the right is undone first
                limit, a = made_a, parts[a][1]
            else:
                limit, b = made_b + 1, parts[b][0]

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Tokens of piece[:i] for i = 0 .. len(piece), piece being one pre-token."""
        begins, pairs, n = self.begins.get, self.pairs, len(piece)
        count, last = [0] * (n + 1), [-1] * (n + 1)
        for start in range(n):
            before, more = last[start], count[start] + 1
            for stop in range(start + 1, n + 1):
                token = begins(piece[start:stop])
                if token is None:
                    break  # no token begins so
                if token >= 0 and last[stop] < 0 and (start == 0 or pairs[before, token]):
                    last[stop], count[stop] = token, more
        return count

    def _chunk(self, chunk: str) -> int:
        return sum(map(self.pieces.__getitem__, self.findall(chunk)))

    def _counts(self, text: str) -> list[int]:
        first, rest = chunks(text)
        return [self._chunk(first), *map(self.spaced.__getitem__, rest)]

    def count(self, text: str) -> int:
        """Tokens of the whole text; a special string in it is one token, as the library has it by default."""
        if self.cut_special and any(s in text for s in self.special):
            return sum(1 if k % 2 else sum(self._counts(part)) for k, part in enumerate(self.cut_special(text)))
        return sum(self._counts(text))

    def every_prefix(self, text: str) -> list[int]:
        """Tokens of text[:k] for k = 0 .. len(text). A special string counts as text until it is complete."""
        if not (self.cut_special and any(s in text for s in self.special)):
            return self._plain_prefixes(text)
        parts, out = self.cut_special(text), [0]
        for k in range(0, len(parts), 2):
            base = out[-1]
            mark = parts[k + 1] if k + 1 < len(parts) else ""
            out += [base + x for x in self._plain_prefixes(parts[k] + mark)[1:]]
            if mark:
                out[-1] = base + sum(self._counts(parts[k])) + 1
        return out

    def _plain_prefixes(self, text: str) -> list[int]:
        out, settled, run, run_from = [0], 0, None, 0
        done = 0  # characters before the piece; settled: their tokens when a non-space comes next
        for piece in self.findall(text):
            if _SPACE.match(piece) and not (done and _SPACE.match(text, done - 1)):
                stop = _SPACE.match(text, done).end()
                run_from, run_base, run = done, settled, self.prefix_counts(text[done:stop].encode())
            contraction = piece[0] == "'" and len(piece) > 1 and piece[1].isalpha()
            table, at = None, 0
            for k, c in enumerate(piece, 1):
                at += len(c.encode())
                if _SPACE.match(c):  # the white space at the end of a prefix is one pre-token, at each of its lengths
                    out.append(run_base + run[len(text[run_from : done + k].encode())])
                elif contraction and k < len(piece):
                    out.append(settled + self._chunk(piece[:k]))
                else:
                    table = table or self.prefix_counts(piece.encode())
                    out.append(settled + table[at])
            settled += self.pieces[piece]
            done += len(piece)
        return out

    def fit(self, text: str, budget: int) -> int:
        """The most characters that a prefix of at most ``budget`` tokens can have."""
        if self.cut_special and any(s in text for s in self.special):
            return max(k for k, n in enumerate(self.every_prefix(text)) if n <= budget)
        first, rest = chunks(text)
        counts = [self._chunk(first), *map(self.spaced.__getitem__, rest)]
        sums = [0, *accumulate(counts)]
        if sums[-1] <= budget:
            return len(text)
        at = max(0, bisect_right(sums, budget) - 2)  # from the chunk before, for white space at the border
        parts = [first, *(" " + c for c in rest)]
        tail = self._plain_prefixes("".join(parts[at : at + 3]))
        return sum(map(len, parts[:at])) + max(k for k, n in enumerate(tail) if sums[at] + n <= budget)


#: White space as the pattern has it: without U+001C to U+001F, unlike str.isspace and the module re.
_SPACE = regex.compile(r"\s+")


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> PrefixCounter:
    return PrefixCounter(path, pattern)


def token_counts(df: DataFrame, vocab_path: str, pattern: str, budget: int, id_col: str = "doc_id", text_col: str = "text", prefixes: bool = False) -> DataFrame:
    """(id, n_bytes long, n_tokens long, fit_chars long[, prefix_tokens array<int>]) of every text.

    n_tokens is what the vocabulary's library counts for the whole text without added tokens;
    fit_chars the most characters that keep a prefix within ``budget`` tokens; prefix_tokens, on request,
    the count at every character (element k + 1: of the first k characters). A null text counts as empty:
    0 bytes, 0 tokens, fit_chars 0, prefix_tokens [0]; a null id stays null. Repeated rows give repeated rows; only the
    two named columns are read. A map without shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(cols: list[list]) -> list[list]:
        c = counter(vocab_path, pattern)
        texts = [t or "" for t in cols[1]]
        counts = [c.count(t) for t in texts]
        out = [cols[0], [len(t.encode()) for t in texts], counts, [len(t) if n <= budget else c.fit(t, budget) for t, n in zip(texts, counts)]]
        return out + ([[c.every_prefix(t) for t in texts]] if prefixes else [])

    schema = f"`{id_col}` {kind}, n_bytes long, n_tokens long, fit_chars long"
    return map_slices(df.select(id_col, text_col), run, schema + (", prefix_tokens array<int>" if prefixes else ""))
