import base64
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from ratingscope.llm import bpe, common, memos, token_counts

ODD = ["<|endoftext|>", "'ll", "  ", "\n", " ", "\t \n", "é", "日本", "don't", "x'", "'s", " 12", "½", "a", "😀", "<|end", "!!", " ?", " ", "　b"]
VOCAB = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
COUNTS = P.path("byte_bpe_50k.json"), P.PATTERN


def texts():
    r = random.Random(7)
    return ["", None, "x" * 5000 + "ab" * 5000, " " * 300, "same", "same"] + ["".join(r.choice(ODD) for _ in range(r.randint(1, 9))) for _ in range(1500)]


def test_encode_decode_as_tiktoken(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB[0], "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts())], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(docs, *VOCAB), *VOCAB).collect()
    assert len(rows) == docs.count() and sorted(rows) == sorted(bpe.round_trip(docs, *VOCAB).collect())
    for r, t in zip(sorted(rows), texts()):
        assert np.frombuffer(r.ids, "<u4").tolist() == lib.encode_ordinary(t or "")
        assert r.bytes == (t or "").encode()


def test_lower_rank_that_appears_later_is_taken_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 260, b"de": 301, b"abcde": 299}
    assert bpe.BytePairEncoder(ranks, P.PATTERN).encode_pieces([b"abcde", b"bcbc"]) == [[299], [300, 300]]


def test_counts_and_all_prefixes_as_the_library(spark):
    lib = Tokenizer.from_file(COUNTS[0])
    n = lambda s: len(lib.encode(s, add_special_tokens=False).ids)
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    rows = token_counts.token_counts(docs, *COUNTS, budget=5, prefixes=True).collect()
    for r, t in zip(sorted(rows), texts()):
        t = t or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), n(t))
        if len(t) < 100:
            want = [n(t[:k]) for k in range(len(t) + 1)]
            assert r.prefix_tokens == want
            assert r.fit_chars == max(k for k, x in enumerate(want) if x <= 5)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, *VOCAB).count() == 0
    assert token_counts.token_counts(docs, *COUNTS, budget=5).count() == 0


def test_budget_of_long_texts_with_control_characters():
    c = token_counts.counter(*COUNTS)
    for t in ("!\x1f" * 2000, "\xa0\xa0\x1c" * 900, "word \x1e" * 1500):
        k = c.fit(t, 1024)
        assert c.count(t[:k]) <= 1024 < c.count(t[: k + 1])


def test_null_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "a b", 1, "x"), (1, None, 2, "y"), (None, None, 3, "z")], "doc_id long, text string, n_tokens int, ids string")
    assert sorted((r.doc_id is None, r.n_tokens) for r in token_counts.token_counts(docs, *COUNTS, budget=5).collect()) == [(False, 0), (True, 0), (True, 2)]
    assert sorted((r.doc_id is None, len(r.ids)) for r in bpe.encode(docs, *VOCAB).collect()) == [(False, 0), (True, 0), (True, 8)]


def test_long_texts_in_bounded_memory():
    """Slices are bounded in bytes, memos in entries, and long keys aren't kept."""
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 1_000_000] * 512 + ["y" * 20_000_000, ""]})
    parts = list(common.slices(batch))
    assert sum(p.num_rows for p in parts) == 514 and all(p.num_rows == 1 or p.nbytes <= common.SLICE_BYTES for p in parts)
    r, enc = random.Random(3), bpe.encoder(*VOCAB)
    words = ("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 60))) for _ in range(600_000))
    text = " ".join(words)  # some 20 MB of different words
    assert enc.decode(enc.encode([text])[0]) == text.encode()
    for memo in (enc.words, enc.pieces, enc.spaced):
        assert len(memo) <= memo.limit and max(map(len, memo), default=0) <= memos.LONGEST_KEY
    memos.keep_only("another")
    assert not enc.words and not enc.pieces and not enc.spaced
    one = "".join(r.choice("abcdefgh") for _ in range(1_000_000))  # one pre-token
    assert enc.decode(enc.encode([one])[0]) == one.encode()
