import base64
import gzip
import hashlib
import random

from ratingscope.llm import html_extract as hx
from ratingscope.llm import warc


def brute_match(a, b):
    """Simple tree matching after its definition, for trees without runs of like siblings."""
    if a.label != b.label:
        return 0
    m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + brute_match(x, y))
    return 1 + m[-1][-1]


def random_tree(r, depth=0):
    node = hx.Node(t := r.choice("abcd"), t)
    if depth < 4:
        kids = [random_tree(r, depth + 1) for _ in range(r.randint(0, 4))]
        node.children = [k for n, k in enumerate(kids) if n == 0 or kids[n - 1].label != k.label]
    return node


def test_tree_matching_against_the_definition():
    r = random.Random(3)
    for _ in range(200):
        a, b = random_tree(r), random_tree(r)
        assert hx.match(a, b)[0] == brute_match(a, b)


PAGES = {
    "<body><header><a>Home</a></header><main><header><h1>T &amp; x</h1></header><p>a&nbsp;b<p>c <b>d</b><br>e<div class='cookie-notice'>no</div><ul><li>1<li>2</ul><section id=comments><article>bad</article></section></main><aside>x</aside></body>": "T & x\na b\nc d e\n1\n2",
    "<nav>m</nav><article class='post'><h1>H</h1><p>one</p><form>f</form><script>s('<p>')</script><style>z</style><div class='ad-slot'>ad</div><p>two &#x41;&#66;</p></article><footer>f</footer>": "H\none\ntwo AB",
    "<p>no article <i>here</i></p><div role=navigation>n</div><div class=sidebar>s</div>": "no article here",
    "plain < text & more": "plain < text & more",
    "<article><p>unclosed <b>bold<p>next": "unclosed bold\nnext",
    "<div class='menu-layout'><article><p>in</p></article></div>": "in",
    "<article><article class='comment'>c</article><p>x<!-- <p>no --></p></article>": "x",
    "": "",
    "<article></article>": "",
    "<" * 50 + "p>x": "<" * 49 + "\nx",
}


def test_pages(spark):
    rows = [(k, f"http://h{k}.example/", h) for k, h in enumerate(PAGES)] + [(100, None, None), (101, "http://x/", "<p>y")]
    df = spark.createDataFrame([(*x, "t") for x in rows + rows[:1]], "page_id long, url string, html string, text string")
    got = hx.extract(df).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        want = "" if r.page_id == 100 else "y" if r.page_id == 101 else PAGES[rows[r.page_id][2]]
        assert (r.text, r.n_chars) == (want, len(want)), r
    assert hx.extract(df.limit(0)).count() == 0


def test_constant_nodes_of_a_host_are_template(spark):
    page = lambda k: f"<body><div><p>Share this with your friends</p></div><div><p>story {k} begins</p><p>and {k * 7} goes on</p><p>Call us today</p></div></body>"
    rows = [(k, "https://Site.example/p", page(k)) for k in range(8)]
    rows += [(50 + k, "http://copies.example/", "<p>same story</p>") for k in range(20)]  # copies are no template
    got = {r.page_id: r.text for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"story {k} begins\nand {k * 7} goes on" for k in range(8))
    assert all(got[50 + k] == "same story" for k in range(20))


def test_warc_derivatives(spark, tmp_path):
    rows = [(1, "http://a/", "<p>Hé &amp; x</p><script>s</script>"), (2, None, None), (2, None, None), (3, "http://b/", "")]
    pages = spark.createDataFrame([(*x, "t") for x in rows], "page_id long, url string, html string, type string")
    source = {r.record_id: r for r in warc.responses(pages, "2024-01-01T00:00:00Z").collect()}
    got = warc.derivatives(warc.responses(pages, "2024-01-01T00:00:00Z"), keep="source").collect()
    assert len(got) == 8
    by = {}
    for r in got:
        by.setdefault(r.refers_to, {})[r.type] = r
        assert r.fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(bytes(r.block)).digest()).decode()
        assert int(r.fields["Content-Length"]) == len(r.block)
    assert set(by) == set(source)
    for ident, pair in by.items():
        meta, conv = pair["metadata"], pair["conversion"]
        assert conv.fields["WARC-Concurrent-To"] == meta.record_id and f"conversion-record-id: {conv.record_id}\r\n" in bytes(meta.block).decode()
        assert f"source-payload-digest: {source[ident].fields['WARC-Payload-Digest']}\r\n" in bytes(meta.block).decode()
        assert "source-header-content-type: text/html; charset=utf-8\r\n" in bytes(meta.block).decode()
        assert (meta.target_uri, meta.date) == (source[ident].target_uri, source[ident].date)
    texts = {r.source: bytes(r.block).decode() for r in got if r.type == "conversion"}
    assert texts == {1: "Hé & x", 2: "", 3: ""}
    # written as files and read back
    made = warc.derivatives(warc.responses(pages, "2024-01-01T00:00:00Z"))
    warc.write_text_records(made, str(tmp_path / "out"))
    back = warc.read_warc(spark, str(tmp_path / "out" / "*.txt"))
    key = lambda r: (r.record_id, r.type, bytes(r.block))
    assert sorted(map(key, back.collect())) == sorted(map(key, made.collect()))
    assert warc.derivatives(warc.responses(pages.limit(0), "")).count() == 0


def test_warc_sources(spark, tmp_path):
    def record(kind, fields, block):
        head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html;\r\n charset=latin-1\r\nX-A: b\r\n\r\n<p>caf\xe9</p>"
    image = b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG\r\n\r\n\x00"
    data = [record("warcinfo", {"WARC-Record-ID": "<urn:i>"}, b"x: y\r\n"), record("response", {"WARC-Record-ID": "<urn:1>", "WARC-Target-URI": "http://a/", "WARC-Date": "2020", "WARC-Block-Digest": "sha1:OWN", "WARC-Payload-Digest": "sha1:PAY"}, http), record("response", {"WARC-Record-ID": "<urn:2>"}, image)]
    (tmp_path / "a.warc").write_bytes(b"".join(data))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    records = warc.read_warc(spark, str(tmp_path))
    assert records.count() == 6
    got = warc.derivatives(records).collect()
    assert len(got) == 6  # of each file: two metadata records, one conversion
    for r in got:
        if r.type == "conversion":
            assert bytes(r.block).decode() == "café" and r.refers_to == "<urn:1>"
        elif r.refers_to == "<urn:1>":
            text = bytes(r.block).decode()
            assert "source-block-digest: sha1:OWN\r\n" in text and "source-payload-digest: sha1:PAY\r\n" in text and "source-header-x-a: b\r\n" in text
            assert "source-header-content-type: text/html; charset=latin-1\r\n" in text


def test_copies_of_an_article_are_no_template(spark):
    def page(menu, title, paragraphs):
        body = "".join(f"<p>{x}</p>" for x in paragraphs)
        return f"<body><div class='menu'>{menu}</div><article><h1>{title}</h1>{body}<div class='x'><p>Call us</p></div></article></body>"

    long = [f"paragraph {k} of the long one" for k in range(12)]
    rows = [(k, "http://a.example/", page(f"menu {k}", "Long", long)) for k in range(6)]  # copies that differ in their menus
    rows += [(10 + k, "http://a.example/", page("menu", f"Short {k}", [f"one {k}", f"two {k}"])) for k in range(30)]
    rows += [(50 + k, "http://mirror.example/", page(f"menu {k}", "Long", long)) for k in range(9)]
    slot = lambda k: page("menu", "Long", [*long, f"unnamed slot {k}"])
    rows += [(70 + k, "http://slots.example/", slot(k)) for k in range(9)]
    other = lambda k: f"<body><div class='top'><p>Welcome back</p></div><section><p>other {k}</p></section></body>"
    rows += [(90 + k, "http://a.example/", other(k)) for k in range(8)]  # a second layout, with a wrapper of its own
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in hx.extract(df).collect()}
    assert all(got[k] == "\n".join(["Long", *long]) for k in range(6))
    assert all(got[10 + k] == f"Short {k}\none {k}\ntwo {k}" for k in range(30))
    assert all(got[50 + k].startswith("\n".join(["Long", *long])) for k in range(9))
    assert all(got[70 + k].startswith("\n".join(["Long", *long, f"unnamed slot {k}"])) for k in range(9))
    assert all(got[90 + k] == f"other {k}" for k in range(8))


def test_alignment_decides_what_names_do_not(spark):
    """No element or class says which part is the article: menus and adverts change with every page, and only the layout's
    alignment tells that the long varying part is the content. Without the wrapper the rest comes too."""
    r = random.Random(6)
    say = lambda n: " ".join(r.choice(["lorem", "ipsum", "dolor", "amet", "sed"]) + str(r.randrange(999)) for _ in range(n))
    rows, want = [], {}
    for k in range(12):
        title, body, links = say(4), [say(r.randint(15, 60)) for _ in range(r.randint(2, 6))], [say(1) for _ in range(r.randint(3, 6))]
        top = "".join(f"<div class='e'><a href='/{x}'>{x}</a></div>" for x in links)
        rows.append((k, "http://plain.example/", f"<body><div class='q'>{top}</div><div class='r'>{say(5)}</div><div class='z'><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in body)}</div><div class='y'><p>{say(6)}</p></div></body>"))
        want[k] = "\n".join([title, *body])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in hx.extract(df).collect()}
    assert got == want
    assert all(hx.main_text(h) != want[k] and want[k] in hx.main_text(h) for k, _, h in rows)


def test_article_text_does_not_go_by_its_names():
    page = (
        "<article><p>Body</p><p class='share-price'>Shares rose</p><p class='comment-on-law'>A comment on the law</p>"
        "<section id='related-work'><h2>Related</h2><p>" + "Others have written about this before, at length. " * 3 + "</p></section>"
        "<div class='share'><a>Tweet</a> <a>Mail</a></div><div class='comments'><p>" + "I have read this and I do not agree at all. " * 4 + "</p></div><p class='ad'>Buy</p></article>"
    )
    assert hx.main_text(page).split("\n") == ["Body", "Shares rose", "A comment on the law", "Related", ("Others have written about this before, at length. " * 3).strip()]


def test_deep_nesting_keeps_its_structure(spark):
    for deep in (250, 20_000):
        page = "<div>" * deep + "<nav>menu</nav><p>text</p><p>more" + "</div>" * deep + "<p>end</p>"
        assert hx.main_text(page) == "text\nmore\nend"
    rows = [(k, "http://deep.example/", "<div>" * 3000 + f"<nav>m</nav><p>text {k}</p>" + "</i></q>" * 3000) for k in range(6)]
    rows.append((None, None, "<article>" + "<p>" + "word " * 200_000 + "</article>"))
    got = {x.page_id: x.text for x in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"text {k}" for k in range(6)) and len(got[None]) == 999_999


PROSE = "Others have written about this before, and at some length, as the list below shows. " * 5


def test_article_text_in_forms_headers_and_odd_elements():
    """Forms around the article, headers in it, names that hold a word for an advert, formulas and fallbacks keep their text."""
    say = PROSE.strip()
    for page, want in {
        f"<body><form id=aspnetForm><nav>m</nav><main><p>{say}</p></main><footer>f</footer></form></body>": say,
        f"<body><form><article><h1>T</h1><p>{say}</p><form>x</form></article></form></body>": f"T\n{say}",
        f"<body><form><div><h1>T</h1><p>{say}</p></div></form><p>after</p></body>": f"T\n{say}\nafter",
        f"<body><p>{say}</p><form><p>Subscribe here</p></form></body>": say,
        f"<article><p>{say}</p><form><p>{say}</p></form></article>": say,
        f"<article><p>a</p><div class='widget-review'><p>{say}</p></div><section id='ads-history'><p>{say}</p></section><div class='newsletter-history'>{say}</div></article>": "\n".join(["a", say, say, say]),
        f"<article class='widget-review'><p>{say}</p></article>": say,
        f"<article><p>a</p><div class='newsletter-box'>Sign up</div><div class='ads-list'><a>{say}</a></div><div class='widget'>{say}</div><div class='user-comments'>{say}</div></article>": "a",
        "<header><p>Site</p></header><article><header><p>Lead</p><nav>n</nav></header><p>x</p><header class='banner'>b</header></article>": "Lead\nx",
        "<article><p>If <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> then <object data=f><param name=p>fallback</object></p></article>": "If x=1 then fallback",
        "<article><p title='a hidden gem' data-class='ad'>kept</p><p hidden>gone</p></article>": "kept",
    }.items():
        got = hx.main_text(page)
        assert got == want, (page[:80], got)


def test_constant_parts_under_a_thousand_containers_and_in_longer_runs(spark):
    deep = "<div>" * 1000 + "{}" + "</div>" * 1000
    rows = [(k, "http://deep.example/", "<body>" + deep.format(f"<section><b>Notice to all of our readers</b></section><p>story {k} and {k * 7}</p>") + "</body>") for k in range(8)]
    body = lambda k: "".join(f"<p>part {n} of {k}</p>" + "<p>Read this too</p>" * (n == k % 3) for n in range(3 + k % 4)) + "<p>Copyright line</p>"
    rows += [(100 + k, "http://runs.example/", f"<body><div>{body(k)}</div></body>") for k in range(24)]
    got = {r.page_id: r.text for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"story {k} and {k * 7}" for k in range(8))
    assert all(got[100 + k] == "\n".join(f"part {n} of {k}" for n in range(3 + k % 4)) for k in range(24))


def test_members_of_runs_meet_by_text():
    r = random.Random(8)
    for _ in range(300):
        make = lambda: [hx.Node("#text", "#text", text=r.choice("abcdefghij")) for _ in range(r.randint(1, 9))]
        x, y = make(), make()
        a, b = [n.text for n in x], [n.text for n in y]
        pairs = [(x.index(p), y.index(q)) for p, q in hx._members(x, y)]
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
        single = [t for t in a if a.count(t) == 1 and b.count(t) == 1]
        longest = [0] * len(single)
        for i, t in enumerate(single):
            longest[i] = 1 + max((longest[k] for k in range(i) if b.index(single[k]) < b.index(t)), default=0)
        met = [i for i, j in pairs if a[i] == b[j] and a[i] in single]
        assert len(x) == 1 == len(y) or len(met) >= max(longest, default=0)
