import random
from collections import defaultdict
from hashlib import sha256

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ratingscope.llm import alignment
from ratingscope.llm.token_counts import _byte_of_char

FILES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN
SCHEMA = "doc_id long, text string, n_a string, pairs int"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def by_hand(texts):
    """Byte by byte, with the libraries over whole texts."""
    a, b = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    back, name = _byte_of_char(), {i: s for s, i in a.get_vocab().items()}
    docs = []
    for text in texts:
        text = text or ""
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ax = [bytes(back[c] for c in name[i]) for i in x]
        by = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not text or b"".join(ax) != (" " + text).encode() or b"".join(by) != (" " + text).encode():
            docs.append(([], [], [], []))
            continue
        owner = [[k for k, t in enumerate(s) for _ in t] for s in (ax, by)]
        pairs = sorted(set(zip(*owner)))
        groups, stops = [([], [])], [set(), set()]
        for stop, s in zip(stops, (ax, by)):
            n = 0
            for t in s:
                n += len(t)
                stop.add(n)
        shared = sorted(stops[0] & stops[1])
        groups = []
        for since, until in zip([0, *shared], shared):
            groups.append([[ids[k] for k in sorted(set(o[since:until]))] for o, ids in zip(owner, (x, y))])
        docs.append((x, y, groups, [(x[i], y[j]) for i, j in pairs]))
    held = defaultdict(int)
    for d in docs:
        for p in set(d[3]):
            held[p] += 1
    top = defaultdict(int)
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    out = []
    for x, y, groups, links in docs:
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((len(x), len(y), len(groups), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), sha256(text.encode()).hexdigest() if x else ""))
    return out


def texts():
    r = random.Random(2)
    bits = ["the", " the", " ", "  ", "\n", "\t", "é", "日本", "don't", " 12", "½", "😀", "<|endoftext|>", "<s>", "▁", "Straße", " unbelievable", "x" * 9, " ", "　", "ﬁ", "á", "\x00", "!!", " ."]
    out = ["".join(r.choice(bits) for _ in range(r.randint(1, 14))) for _ in range(500)]
    words = ["alpha", "the", "Übergröße", "l'été", "1999", "x,y;", "日本語", "(note)"]
    return [*out, None, "", " ", "the same", "the same", " leads", "▁", "ends ", " ".join(r.choice(words) for _ in range(900)), "y" * 3000]


@pytest.mark.parametrize("rows", [8192, 7])
def test_as_by_hand(spark, monkeypatch, rows):
    """Also in small slices."""
    monkeypatch.setattr(alignment, "SLICE_ROWS", rows)
    docs = spark.createDataFrame([(k if k % 11 else None, t, "clash", 1) for k, t in enumerate(texts())], SCHEMA)
    got = alignment.align(docs, *FILES)
    assert got.columns[0] == "doc_id" and set(COLUMNS) == set(got.columns)
    want = [(k if k % 11 else None, *w) for k, w in enumerate(by_hand(texts()))]
    assert sorted(map(str, map(tuple, got.select(COLUMNS).collect()))) == sorted(map(str, want))


def test_no_piece_joins_words():
    """What cutting between words rests on: B's pieces have spaces at their beginning only."""
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    assert not any("▁" in b.id_to_piece(i).lstrip("▁") for i in range(b.get_piece_size()))


def test_what_is_remembered_is_bounded():
    tool = alignment.aligner(*FILES)
    tool.align(["the cat sat on the mat " * 50 + "x" * 5000, " lead  two\nthree \tfour"])
    assert tool.known["cat"] and "x" * 5000 not in tool.known
    assert len(tool.known) <= alignment.MEMO_WORDS and max(map(len, tool.known)) <= 40 and tool.windows.keys() <= set(tool.known.values())


def test_very_long_text_and_empty_table(spark):
    long = "".join(f"word{k % 977} " for k in range(300_000))  # more than a slice
    rows = {r.doc_id: r for r in alignment.align(spark.createDataFrame([(1, long, "", 0), (2, "word3 word4", "", 0)], SCHEMA), *FILES).collect()}
    assert rows[1].n_groups >= 300_000 and rows[2].n_groups >= 2 and rows[1].count_sum >= rows[1].n_links
    assert alignment.align(spark.createDataFrame([], SCHEMA), *FILES).count() == 0
