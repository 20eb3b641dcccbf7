import random

import xxhash

from ratingscope.llm import line_dedup as ld

STEP = 0x9E3779B97F4A7C15


def gram(words):
    """The polynomial of the words' hashes, word by word, and its scramble."""
    x = 0
    for w in words:
        x = (x * STEP + xxhash.xxh64_intdigest(w)) % 2**64
    x = (x ^ x >> 31) * STEP % 2**64
    return x ^ x >> 29


def brute(rows, run_words, sure_words):
    """Everything again in plain loops: grams, window minima, first places, extension."""
    cut = {i: ld.lines(t) for i, t in rows}
    norm = {i: [" ".join(x.lower().split()) for x in ls] for i, ls in cut.items()}
    size = {i: [len(x.split()) for x in ls] for i, ls in norm.items()}

    def end(i, k, least):
        total = 0
        for e in range(k, len(norm[i])):
            total += size[i][e]
            if total >= least:
                return e + 1
        return None

    places = {}
    for i, ls in norm.items():
        windows = [(k, end(i, k, sure_words)) for k in range(len(ls)) if end(i, k, sure_words)] or [(0, len(ls))]
        for a, b in windows:
            inside = [k for k in range(a, len(ls)) if end(i, k, run_words) and end(i, k, run_words) <= b]
            if inside:
                k = min(inside, key=lambda k: (gram(norm[i][k : end(i, k, run_words)]), -k))
                places.setdefault(gram(norm[i][k : end(i, k, run_words)]), set()).add((i, k))
    gone, met, by_source = {i: set() for i in norm}, {i: [] for i in norm}, {}
    for found in places.values():
        s, q = min(found)
        for i, k in found - {(s, q)}:
            a, b = k, q
            while a and b and norm[i][a - 1] == norm[s][b - 1]:
                a, b = a - 1, b - 1
            start = a
            while a < len(norm[i]) and b < len(norm[s]) and norm[i][a] == norm[s][b]:
                gone[i].add(a)
                by_source.setdefault((i, s), set()).add(a)
                a, b = a + 1, b + 1
            met[i].append((s, start, a))
    beyond = {}
    for i, runs in met.items():
        for s, a, b in runs:
            for k in range(max(0, a + run_words - sure_words), min(b - run_words, len(norm[i]) - sure_words) + 1):
                if not all(m in by_source[i, s] for m in range(k, k + sure_words)):
                    beyond.setdefault(tuple(norm[i][k : k + sure_words]), set()).add((i, k))
    for found in beyond.values():
        for i, k in found - {min(found)}:
            gone[i].update(range(k, k + sure_words))
    out = {}
    for i, ls in cut.items():
        kept = "".join(x for k, x in enumerate(ls) if k not in gone[i])
        out[i] = "".join(ls) if not gone[i] else kept.rstrip() if kept.strip() else ""
    return out


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    line = lambda: " ".join(r.choice(vocab) for _ in range(r.randint(3, 14))) + r.choice([".", ".", ",", "!"])
    passages = [[line() for _ in range(r.randint(4, 12))] for _ in range(6)]
    out = []
    for _ in range(n):
        if out and r.random() < 0.2:
            out.append(r.choice(out))
            continue
        ls = [line() for _ in range(r.randint(0, 25))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) - 3)
            ls[r.randint(0, len(ls)) :] = p[a:] + ls[-3:]
        out.append("".join(x + r.choice([" ", "\n", "  \n\n"]) for x in ls))
    return list(enumerate(out))


def test_lines_join_to_the_text():
    for t in ["", "\n\na. b, c\n", "no end", "a.b.c. d", "x! \n\n y…  z", " "]:
        assert "".join(ld.lines(t)) == t


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed, 120)
        df = spark.createDataFrame([(i, t, "x", i) for i, t in rows + rows[:4]], "doc_id long, text string, runs string, line_stats long")
        got = ld.dedup_lines(df, run_words=25, sure_words=50).collect()
        assert len(got) == len(rows) + 4
        want = brute(rows, 25, 50)
        assert sum(t != want[i] for i, t in rows) > 30
        for r in got:
            assert r.text == want[r.doc_id], r.doc_id
            assert r.runs == "x"


def test_passage_in_the_middle_goes_and_clean_texts_stay(spark):
    r = random.Random(5)
    words = lambda n: " ".join(f"u{r.randrange(10**9)}" + ("." if k % 9 == 8 else "") for k in range(n))
    passage = words(60)
    a, b, clean = words(80) + " " + passage + ". " + words(20), words(50) + ". " + passage + ". " + words(70), words(200)
    df = spark.createDataFrame([(1, a), (2, b), (3, clean), (4, a), (5, None), (6, "")], "doc_id long, text string")
    got = {x.doc_id: x for x in ld.dedup_lines(df).collect()}
    assert got[1].text == a and got[3].text == clean and got[4].text == "" and got[6].text == ""
    assert got[5].text is None and got[5].line_stats is None
    left = got[2].text.split()
    assert len([w for w in passage.split() if w in left]) <= 9 and len(left) >= 115
    assert ld.dedup_lines(df.limit(0)).count() == 0


def test_repeats_within_one_text_and_null_ids(spark):
    block = "".join(f"a{k} b{k} c{k} d{k} e{k} f{k}. " for k in range(12))
    df = spark.createDataFrame([(1, block * 3), (None, block), (None, block)], "doc_id long, text string")
    got = [tuple(x)[:2] for x in ld.dedup_lines(df).collect()]
    assert sorted(got, key=str) == sorted([(1, block.rstrip()), (None, ""), (None, "")], key=str)


def test_every_shared_run_of_51_words_goes_wherever_it_begins(spark):
    """Against raw runs of words: what several texts share stands once, also inside a line."""
    r = random.Random(8)
    own = lambda n: [f"u{r.randrange(10**9)}" + ("," if k % 11 == 10 else "") for k in range(n)]
    rows, known = [], []
    for k in range(60):
        passage = own(51)
        known.append(passage)
        rows += [(2 * k, " ".join(own(r.randint(0, 60)) + passage + own(r.randint(0, 60)))), (2 * k + 1, " ".join(own(r.randint(0, 60)) + passage + own(r.randint(0, 60))))]
    got = {x.doc_id: x for x in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, passage in enumerate(known):
        first, later = rows[2 * k][1], rows[2 * k + 1][1].split()
        assert got[2 * k].text == first
        assert got[2 * k + 1].text.split() == [w for w in later if w not in set(passage)]
        assert got[2 * k + 1].line_stats.words_removed == 51


def test_window_minima_against_a_loop():
    r = random.Random(3)
    for n in [0, 24, 25, 26, 49, 50, 51, 200] * 4:
        for vocab in (1, 3, 10**6):
            words = " ".join(str(r.randrange(vocab)) for _ in range(n))
            grams = [gram(words.split()[k : k + 25]) for k in range(n - 24)]
            at, marks = ld.fingerprints(every := ld.grams(ld.hashed(words), 25), 25, 50)
            assert every.tolist() == grams
            ends = range(26, len(grams) + 1) if len(grams) > 26 else [len(grams)] * bool(grams)
            want = {min(range(max(0, e - 26), e), key=lambda k: (grams[k], -k)) for e in ends}
            assert at.tolist() == sorted(want) and marks.tolist() == [grams[k] for k in sorted(want)]


def test_many_texts_at_once_as_one_by_one():
    r = random.Random(4)
    for vocab in (2, 10, 10**6):
        texts = ["", " ", "\u3000x\xa0y\n", "Ärger " * 40 + "w" * 40, *(" ".join("w" * r.randrange(3) + str(r.randrange(vocab)) for _ in range(r.choice([0, 3, 24, 25, 26, 49, 50, 51, 90, 300]))) for _ in range(120))]
        words = ld.hash_words(texts)
        assert [w.tolist() for w in words] == [[xxhash.xxh64_intdigest(w) for w in t.lower().split()] for t in texts]
        for w, (at, marks) in zip(words, ld.all_fingerprints(words, 25, 50), strict=True):
            want = ld.fingerprints(ld.grams(w, 25), 25, 50)
            assert at.tolist() == want[0].tolist() and marks.tolist() == want[1].tolist()


def test_lines_that_went_whole_are_counted():
    text = "\n one two, three.\n\nfour five\nsix. seven"
    assert ld.lines(text) == ["\n one ", "two, ", "three.\n\n", "four ", "five\n", "six. ", "seven"]
    assert ld.without_runs(text, [1, 3], [2, 5]) == ("\n one three.\n\nsix. seven", 2, 3)
    assert ld.without_runs(text, [0, 2], [2, 3]) == ("four five\nsix. seven", 3, 3)
    assert ld.without_runs(text, [0], [7]) == ("", 6, 7)


def chains(seed, n=150):
    """Texts of pieces of few passages, so that earlier texts hold parts of what later ones share."""
    r = random.Random(seed)
    passages = [[f"p{k}x{j}" for j in range(90)] for k in range(3)]
    out = []
    for _ in range(n):
        ws = [f"u{r.randrange(10**9)}" for _ in range(r.randint(0, 10))]
        for _ in range(r.randint(1, 3)):
            p, a = r.choice(passages), r.randint(0, 60)
            ws += p[a : a + r.randint(22, 75)] + [f"u{r.randrange(10**9)}" for _ in range(r.randint(0, 30))]
        out.append(" ".join(ws))
    return list(enumerate(out))


def test_no_run_of_50_words_stays_in_two_places(spark, monkeypatch):
    """The property itself, whatever the algorithm; with hot sources split as well."""
    monkeypatch.setattr(ld, "HOT", 20)
    for seed in range(4):
        rows = chains(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        runs = {r["_key"]: r.runs for r in ld.find_repeats(df).collect()}
        keys = {r.doc_id: r.k for r in df.selectExpr("doc_id", "xxhash64(doc_id, text) as k").collect()}
        seen, before = {}, {}
        for i, t in rows:
            ws = t.split()
            gone = {k for a, b in runs.get(keys[i], []) for k in range(a, b)}
            for k in range(len(ws) - 49):
                if not gone.intersection(range(k, k + 50)):
                    assert seen.setdefault(tuple(ws[k : k + 50]), (i, k)) == (i, k)
            for k in range(len(ws) - 24):
                before.setdefault(tuple(ws[k : k + 25]), (i, k))
            for k in gone:  # only what an earlier text or place has goes
                assert any(before[tuple(ws[m : m + 25])] < (i, m) for m in range(max(0, k - 24), min(k, len(ws) - 25) + 1))
        assert sum(map(bool, runs.values())) > 100


def test_very_long_texts(spark):
    words = [f"v{k}" for k in range(150_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[70_000:90_000])), (3, "x " * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in ld.dedup_lines(df).collect()}
    assert got[1].line_stats.words_removed == 0 and got[2].text == "" and len(got[3].text.split()) < 100
