"""Main text of web pages by wrapper induction (operator 6).

The pages of a host are aligned with one of them, the reference, by simple tree matching: two trees match
in their roots' labels and in the best ordered matching of their children. Runs of like siblings (paragraphs, list
items) are matched as one: members whose text stands once in both runs meet in their longest common order, the others by position
between these. So a page costs what its markup costs, not its square. Trees of any depth are matched whole.

The pages of a host that have the same frame of containers are a layout, and each layout has a reference of its own. Spark
counts, for each text node of a reference, in how many pages of the layout it stands with the same text, and how much text stands there;
pages with one main text count once. Nodes that stay constant over the layout are template and leave its pages. The container that
holds most of the text that varies from page to page and is no link is the layout's content, whatever it is called; what lies
outside of it is template too, menus and adverts that change with every page as well. Names of elements and classes only choose inside of it:
an article in it, and menus, forms, adverts and reader comments that are left out of it. Inside an article, a name that is only part of a
longer one (``ads-history``) leaves nothing out that has text of its own, and headers stay. A form that holds the article, or nearly
all of the page's text, is a container like others. Pages without a layout of their own go by names alone.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from functools import lru_cache
from collections import Counter, defaultdict
from collections.abc import Generator, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingscope.llm.common import if_small, map_slices, written

#: Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea select svg canvas video audio annotation annotation-xml noframes".split())
BLOCKS = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul caption".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Elements, roles and words of class names or ids of what isn't the article.
APART = frozenset("nav header footer aside form menu dialog button head title search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments disqus reply replies widget login signin signup pagination pager".split())
#: Those of WORDS that say the same as part of any longer name.
READERS = frozenset("comment comments disqus reply replies".split())
#: Words that name such parts, but articles' sections as well; they count where a part is mostly links or has little text.
VAGUE = frozenset("notice notification alert share sharing social related recommended recommendations register skip".split())
#: Elements that are text by themselves; only a class that is one of WORDS as a whole tells them from the article.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td th li dd dt figcaption span a b i em strong".split())
#: A start tag that ends open elements: <p> and other blocks end a paragraph, items end the item before.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
ENDS = {t: CLOSES.get(t, set()) | ({"p"} if t in BLOCKS else set()) for t in (*CLOSES, *BLOCKS)}
SCOPES = frozenset("table ul ol dl article section div main body html td th".split())
#: A part with a vague name is left out if its text that is no link has fewer characters or is a smaller share.
VAGUE_CHARS, VAGUE_SHARE = 80, 0.8
#: The same for a part of an article that has one of WORDS only as part of a longer name.
LOOSE_CHARS = 200
#: A form that holds so large a share of a page's text that is no link, and paragraphs or headings, is a plain container.
FORM_SHARE = 0.8
#: The content of a layout is the smallest container with so large a share of the varying text.
CONTENT_SHARE = 0.7
#: A text node of the reference is constant if so large a share of the layout's pages has it with the same text; a layout has so
#: many pages with different main texts at least.
LEAST_PAGES, SAME_SHARE = 5, 0.95
#: Constant nodes inside <article> or <main> that make up a larger share of its text are no template: the pages are copies.
MOST_TEMPLATE = 0.5
#: Containers that make a layout, and how deep they are looked at; layouts with too few pages are pooled as one.
FRAME, FRAME_DEPTH, POOLED = frozenset("html body div section main article center form table tbody tr td".split()), 5, 0

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TELLS = re.compile("class|id|role|hidden", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")


class Node:
    """An element, or a text (tag ``#text``). ``apart``: it is no part of the article by its own tag and attributes (``named``:
    by its attributes; ``loose``: only by a part of a longer name); ``vague``: it may be none. ``key``: a number for label and text."""

    __slots__ = ("tag", "label", "apart", "named", "loose", "vague", "children", "text", "index", "key")

    def __init__(self, tag: str, label: str, named: bool = False, text: str = "", vague: bool = False, loose: bool = False):
        self.tag, self.label, self.named, self.loose, self.vague, self.text = tag, label, named, loose, vague, text
        self.apart, self.children, self.index, self.key = named or tag in APART, [], -1, None


@lru_cache(maxsize=4096)
def _kind(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """Label, ``named``, ``vague`` and ``loose`` of an element."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))  # the first of equal ones counts
    own = f"{found.get('class', '')} {found.get('id', '')}"
    whole = {w.lower() for w in own.split()}
    parts = whole if tag in PROSE else whole | {w.lower() for w in _PARTS.findall(own)}
    sure = bool(whole & WORDS or parts & READERS) or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true"
    named = sure or bool(parts & WORDS)
    vague = tag not in PROSE and bool(parts & VAGUE) and not named
    return f"{tag}.{found.get('class', '')}", named, vague, named and not sure and tag not in APART


def _element(tag: str, attributes: str) -> Node:
    label, named, vague, loose = _kind(tag, attributes if _TELLS.search(attributes) else "")
    return Node(tag, label, named, vague=vague, loose=loose)


def parse(page: str) -> Node:
    """A tree of a page. Never fails: what is open at the end is closed there, stray end tags are ignored."""
    root = Node("#root", "#root")
    stack, at, end, opened, forms = [root], 0, len(page), Counter(), []
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if page[m.start()] != "<" or at - m.start() == 1:
                _add_text(stack[-1], m[0])
            continue
        tag = tag.lower()
        if m[1]:
            _close(stack, tag, opened)
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at) if not m[3].endswith("/") else None
            at = stop.end() if stop else (at if m[3].endswith("/") else end)
            continue
        if tag == "title":
            stop = re.compile(r"</title\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        _imply(stack, tag, opened)
        node = _element(tag, m[3])
        stack[-1].children.append(node)
        if tag == "form" and not node.named:
            forms.append(node)
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            opened[tag] += 1
    if forms:
        _plain_forms(root, forms)
    return root


def _plain_forms(root: Node, forms: list[Node]) -> None:
    """Forms around an article, or around nearly all of the text of a page without one, are plain containers."""

    def held(top: Node) -> tuple[bool, bool, int]:
        article = says = False
        own, stack = 0, [top]
        while stack:
            node = stack.pop()
            article |= node.tag in ("article", "main")
            says |= node.tag in ("p", "h1", "h2", "h3")
            own += len(plain(node.text)) if node.tag == "#text" else 0
            stack.extend(c for c in node.children if c.tag not in ("a", "label", "legend", "option") and (not c.apart or c.tag in ("form", "header") or c.loose))
        return article, says, own

    any_article, _, total = held(root)
    inside, stack = {}, [(root, None)]
    while stack:  # a form within a form is a form
        node, outer = stack.pop()
        if node.tag == "form":
            inside[id(node)] = outer
        stack.extend((c, outer or (node if node.tag == "form" else None)) for c in node.children)
    for form in forms:
        if inside.get(id(form)) is None:
            article, says, own = held(form)
            form.apart = not (article or not any_article and says and own >= max(VAGUE_CHARS, FORM_SHARE * total))


def _add_text(parent: Node, text: str) -> None:
    if parent.children and parent.children[-1].tag == "#text":
        parent.children[-1].text += text
    else:
        parent.children.append(Node("#text", "#text", text=text))


def _cut(stack: list[Node], k: int, opened: Counter) -> None:
    for node in stack[k:]:
        opened[node.tag] -= 1
    del stack[k:]


def _close(stack: list[Node], tag: str, opened: Counter) -> None:
    for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
        if stack[k].tag == tag:
            return _cut(stack, k, opened)
        if tag in INLINE and stack[k].tag in BLOCKS:
            return  # an inline end tag doesn't end a block


def _imply(stack: list[Node], tag: str, opened: Counter) -> None:
    ends = ENDS.get(tag, ())
    for t in ends:
        if opened[t]:
            break
    else:
        return
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in ends:
            _cut(stack, k, opened)
            return _imply(stack, tag, opened) if tag in CLOSES else None
        if stack[k].tag in SCOPES:
            return


def texts(root: Node) -> list[Node]:
    """The text nodes that aren't blank, numbered in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag == "#text":
            if not node.text.isspace():
                node.index = len(out)
                out.append(node)
        else:
            stack.extend(reversed(node.children))
    return out


def texts_below(top: Node) -> list[Node]:
    """The numbered text nodes of an element."""
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        if node.tag == "#text":
            out += [node] * (node.index >= 0)
        elif node is top or not _leaves(node, inside=True):
            stack.extend(reversed(node.children))
    return out


# ---------------------------------------------------------------- simple tree matching


def _runs(node: Node) -> list[list[Node]]:
    out: list[list[Node]] = []
    for c in node.children:
        if c.tag == "#text" and c.text.isspace():
            continue
        if out and out[-1][0].label == c.label:
            out[-1].append(c)
        else:
            out.append([c])
    return out


def _key(top: Node) -> int:
    """A number for the labels and texts of a tree."""
    chain, node = [], top
    while node.key is None and len(node.children) == 1:
        chain.append(node)
        node = node.children[0]
    if node.tag == "#text" and not node.text.isspace():  # as below, without a stack
        node.key = hash(" ".join(node.text.split()))
        for above in reversed(chain):
            above.key = hash((above.label, node.key))
            node = above
    stack = [top]
    while stack:
        node = stack[-1]
        if node.key is None:
            if node.tag == "#text":
                node.key = hash(" ".join(node.text.split()))
            elif missing := [c for c in node.children if c.key is None]:
                stack.extend(missing)
                continue
            else:
                node.key = hash((node.label, *(c.key for c in node.children if c.tag != "#text" or not c.text.isspace())))
        stack.pop()
    return top.key


def _members(x: list[Node], y: list[Node]) -> list[tuple[Node, Node]]:
    """The members of two runs that meet."""
    if len(x) == 1 and len(y) == 1:
        return [(x[0], y[0])]
    ours, theirs = [_key(n) for n in x], [_key(n) for n in y]
    if ours == theirs:
        return list(zip(x, y))
    once, there = Counter(ours), Counter(theirs)
    place = {k: j for j, k in enumerate(theirs) if there[k] == 1}
    # the longest rising sequence of the places of such members: ends of sequences by length, and who stands before whom
    ends: list[int] = []
    last: list[int] = []
    before: dict[int, int] = {}
    for i, k in enumerate(ours):
        if once[k] == 1 and k in place:
            n = bisect_left(ends, place[k])
            ends[n:n + 1], last[n:n + 1] = [place[k]], [i]
            before[i] = last[n - 1] if n else -1
    anchors, i = [], last[-1] if last else -1
    while i >= 0:
        anchors.append((i, place[ours[i]]))
        i = before[i]
    out, i, j = [], 0, 0
    for p, q in (*reversed(anchors), (len(x), len(y))):
        out += zip(x[i:p], y[j:q])
        out += zip(x[p:p + 1], y[q:q + 1])
        i, j = p + 1, q + 1
    return out


def _is_text(node: Node) -> bool:
    return node.tag == "#text" and not node.text.isspace()


def _steps(a: Node, b: Node) -> Generator:
    """Matches two trees of one label. Yields pairs of elements to match first and is sent their results; yields its own at last: the
    size, and nested lists of pairs."""
    left, right = _runs(a), _runs(b)
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    found: dict[tuple[int, int], tuple[int, list]] = {}
    for i, x in enumerate(left):
        row, above = best[i + 1], best[i]
        for j, y in enumerate(right):
            top = max(above[j + 1], row[j])
            if x[0].label == y[0].label:
                total, parts = 0, []
                for pair in _members(x, y):
                    p, q = pair
                    if p.tag == "#text":
                        total += 1
                        parts.append(pair)
                    elif len(p.children) == 1 == len(q.children) and _is_text(p.children[0]) and _is_text(q.children[0]):
                        total += 2
                        parts.append((p.children[0], q.children[0]))
                        if p.tag in FRAME:
                            parts.append(pair)
                    else:
                        n, more = yield pair
                        total += n
                        parts.append(more)
                found[i, j] = total, parts
                top = max(top, above[j] + total)
            row[j + 1] = top
    taken, i, j = [(a, b)] if a.tag in FRAME else [], len(left), len(right)
    while i and j:
        if (i - 1, j - 1) in found and best[i][j] == best[i - 1][j - 1] + found[i - 1, j - 1][0]:
            i, j = i - 1, j - 1
            taken.append(found[i, j][1])
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    yield 1 + best[-1][-1], taken


def match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Size of the best ordered matching of two trees, and the text nodes and containers that it pairs, in no order."""
    if a.label != b.label:
        return 0, []
    if a.tag == "#text":
        return 1, [(a, b)]
    open_, answer = [_steps(a, b)], None  # trees may be deeper than calls can nest
    while open_:
        step = open_[-1].send(answer)
        if isinstance(step[0], Node):
            open_.append(_steps(*step))
            answer = None
        else:
            open_.pop()
            answer = step
    pairs, stack = [], [answer[1]]
    while stack:
        for x in stack.pop():
            (pairs if isinstance(x, tuple) else stack).append(x)
    return answer[0], pairs


def plain(text: str) -> str:
    return " ".join(html.unescape(text).split())


def all_text(page: str | None) -> str:
    """The text of all blocks of a page."""
    blocks: list[list[str]] = [[]]
    _walk(parse(page or ""), blocks, set(), whole=True)
    return "\n".join(x for x in (plain("".join(b)) for b in blocks) if x)


@lru_cache(maxsize=32)
def _wrapper(reference: str, constant: tuple[int, ...], weights: tuple[float, ...]) -> tuple[Node, set[int], Node | None]:
    """The tree of a reference, its template nodes and its content. ``weights``: mean length of each text node that isn't constant."""
    root = parse(reference)
    nodes = texts(root)
    links, stack = set(), [(root, False)]
    mass: dict[int, float] = {}
    order = []
    while stack:
        node, link = stack.pop()
        order.append(node)
        if node.tag == "#text" and link:
            links.add(node.index)
        stack.extend((c, link or node.tag == "a") for c in node.children)
    for node in reversed(order):  # children before their parents
        own = weights[node.index] if 0 <= node.index < len(weights) and node.index not in links else 0.0
        mass[id(node)] = own + sum(mass[id(c)] for c in node.children)
    content, total = root, mass[id(root)]
    while total > 0 and content.tag not in ("article", "main"):
        inner = [c for c in content.children if c.tag in FRAME and mass[id(c)] >= CONTENT_SHARE * total]
        if not inner or _headed([c for c in content.children if c is not inner[0]], mass):
            break
        content = inner[0]
    fixed = set(constant)
    return root, fixed - _copied(root, fixed), content if total > 0 and content.tag in FRAME and content.tag not in ("html", "body") and nodes else None


def _headed(nodes: list[Node], mass: dict[int, float]) -> bool:
    """Whether there is a heading of the first or second level that varies in these parts."""
    stack = [n for n in nodes if not n.apart]
    while stack:
        node = stack.pop()
        if node.tag in ("h1", "h2") and mass[id(node)] > 0:
            return True
        stack.extend(c for c in node.children if mass[id(c)] > 0 and not c.apart)
    return False


def main_text(page: str | None, reference: str | None = None, constant: list[int] | None = None, weights: list[float] | None = None) -> str:
    """The text of a page's article, blocks joined by line breaks. With a wrapper, only what is aligned with the content of the
    reference, or lies in it, is the article, and text nodes that match a constant node and have its text are template."""
    if not page:
        return ""
    root = parse(page)
    template, content = set(), None
    if reference:
        other, fixed, inside = _wrapper(reference, tuple(constant or ()), tuple(weights or ()))
        texts(root)
        pairs = match(other, root)[1]
        template = {p.index for r, p in pairs if r.index in fixed and plain(r.text) == plain(p.text)}
        content = next((p for r, p in pairs if r is inside), None)
    return _article_text(root, template, content)


def _article_text(root: Node, template: set[int], content: Node | None) -> str:
    tops = _articles(root)
    if content is not None:
        held, stack = set(), [content]
        while stack:
            node = stack.pop()
            held.add(id(node))
            stack.extend(node.children)
        tops = [t for t in tops if id(t) in held] or [content]
    blocks: list[list[str]] = [[]]
    for top in tops or [root]:
        blocks.append([])
        _walk(top, blocks, template, inside=bool(tops))
    return "\n".join(x for x in (plain("".join(b)) for b in blocks) if x)


def _copied(root: Node, fixed: set[int]) -> set[int]:
    """The constant nodes inside the articles of a reference, if they make up most of their text."""
    inside = [n for top in _articles(root) for n in texts_below(top)]
    same = [n for n in inside if n.index in fixed]
    return {n.index for n in same} if sum(len(plain(n.text)) for n in same) > MOST_TEMPLATE * sum(len(plain(n.text)) for n in inside) else set()


def _articles(root: Node) -> list[Node]:
    """The outermost <article> elements outside of what is apart, or else <main> elements; if there are none, those
    that a <div> or <section> with such a name holds."""
    for want, loose in (("article", False), ("main", False), ("article", True), ("main", True)):
        out, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.tag == want and (not node.apart or _stays(node)):
                out.append(node)
            elif not node.apart or loose and node.tag in ("div", "section") or node.tag in ("body", "html"):
                stack.extend(reversed(node.children))
        if out:
            return out
    return []


def _walk(top: Node, blocks: list[list[str]], template: set[int], whole: bool = False, inside: bool = False) -> None:
    stack: list[Node | None] = [top]
    while stack:
        node = stack.pop()
        if node is None:
            blocks.append([])
        elif node.tag == "#text":
            if node.index not in template or not template:
                blocks[-1].append(node.text)
        elif node.tag in ("br", "img", "wbr"):
            blocks[-1].append("" if node.tag == "wbr" else " ")
        elif not whole and node is not top and _leaves(node, inside):
            blocks.append([])
        else:
            block = node.tag in BLOCKS
            if block:
                blocks.append([])
                stack.append(None)
            stack.extend(reversed(node.children))


def _leaves(node: Node, inside: bool = False) -> bool:
    """Whether an element is left out. Inside an article, or with a heading of the first or second level, a header is the article's own."""
    if node.tag == "header" and (inside and not (node.named or node.vague) or any(c.tag in ("h1", "h2", "hgroup") for c in node.children)):
        return False
    if node.tag in ("html", "body"):
        return False
    return node.apart and not (inside and _stays(node)) or node.vague and not _says_much(node)


def _stays(node: Node) -> bool:
    """Whether an element with a word for what is apart in a longer name is part of an article for all that."""
    return node.loose and _says_much(node, LOOSE_CHARS)


def _says_much(top: Node, least: int = VAGUE_CHARS) -> bool:
    """Whether a part has text of its own, and not mostly links."""
    own = links = 0
    stack = [(top, False)]
    while stack:
        node, link = stack.pop()
        if node.tag == "#text":
            n = len(plain(node.text))
            own, links = own + n * (not link), links + n * link
        elif not node.apart or node is top:
            stack.extend((c, link or node.tag == "a") for c in node.children)
    return own >= least and own >= VAGUE_SHARE * (own + links)


# ---------------------------------------------------------------- Spark


def with_host(pages: DataFrame, url_col: str) -> DataFrame:
    """Adds _host: the lower-case host of the address, '' where there is none."""
    return pages.withColumn("_host", F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit("")))


def layout(root: Node) -> int:
    """A number for the frame of a page: its containers outside of articles and of what is apart, numbers in names left out."""
    found, stack = set(), [(root, 0)]
    while stack:
        node, depth = stack.pop()
        for c in node.children:
            if c.tag in FRAME and (not c.apart or c.tag in ("html", "body")):
                found.add(f"{depth} {_DIGITS.sub('', c.label)}")
                if depth < FRAME_DEPTH and c.tag not in ("article", "main"):
                    stack.append((c, depth + 1))
    return xxhash.xxh64_intdigest("\n".join(sorted(found))) - (1 << 63)


def _page(pages: DataFrame, html_col: str) -> DataFrame:
    """Adds _page: 128 bits that stand for host and html."""
    return pages.withColumn("_page", F.unhex(F.md5(F.concat_ws("\0", F.col("_host"), F.col(html_col)))))


def layouts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(_page binary, _layout long, counts boolean) of each different page of a host: its layout, and whether it is the one that
    counts for its main text (by its own markup). Layouts with fewer than ``LEAST_PAGES`` such pages are pooled; if the
    pool has too few as well, it goes by the host's largest layout."""
    own = _page(with_host(pages, url_col).where(F.length(html_col) > 0), html_col).select("_host", "_page", F.col(html_col).alias("html"))

    def look(cols: list[list]) -> list[list]:
        kinds, mains = [], []
        for page in cols[2]:
            root = parse(page)
            kinds.append(layout(root))
            mains.append(xxhash.xxh128_digest(_article_text(root, set(), None).encode("utf-8", "surrogatepass")))
        return [cols[0], cols[1], kinds, mains]

    seen = written(map_slices(own, look, "_host string, _page binary, kind long, main binary", rows=64).distinct(), "looks")
    once = seen.groupBy("_host", "kind", "main").agg(F.min("_page").alias("first"))
    sizes = once.groupBy("_host", "kind").agg(F.count("*").alias("n")).withColumn("big", F.col("n") >= LEAST_PAGES)
    hosts = sizes.groupBy("_host").agg(F.max(F.when(F.col("big"), F.struct("n", "kind"))).alias("largest"), F.coalesce(F.sum(F.when(~F.col("big"), F.col("n"))), F.lit(0)).alias("pool"))
    named = F.when(F.col("big"), F.col("kind")).when((F.col("pool") >= LEAST_PAGES) | F.col("largest").isNull(), F.lit(POOLED)).otherwise(F.col("largest.kind"))
    kinds = sizes.join(hosts, "_host").select("_host", "kind", "big", named.alias("_layout"))
    placed = seen.join(kinds, ["_host", "kind"]).join(once, ["_host", "kind", "main"])
    # strays that go by the largest layout don't count in it
    counts = (F.col("_page") == F.col("first")) & (F.col("big") | (F.col("_layout") == POOLED))
    # pages with one main text in several pooled layouts count once as well
    placed = placed.select("_host", "_page", "_layout", "main", counts.alias("counts"))
    only = placed.where("counts").groupBy("_host", "_layout", "main").agg(F.min("_page").alias("only"))
    return placed.join(only, ["_host", "_layout", "main"], "left").select("_page", "_layout", F.coalesce(F.col("counts") & (F.col("_page") == F.col("only")), F.lit(False)).alias("counts"))


def wrappers(pages: DataFrame, placed: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(_host, _layout, reference string, constant array<int>, weights array<double>): the wrapper of each layout (of ``layouts``):
    its constant text nodes, and the mean length of the text at each other one. The reference is the page with the least hash."""
    own = _page(with_host(pages, url_col).where(F.length(html_col) > 0), html_col).select("_host", "_page", F.col(html_col).alias("html"))
    own = own.join(placed.where("counts").drop("counts"), "_page").groupBy("_host", "_layout", "_page").agg(F.first("html").alias("html"))
    reference = written(own.groupBy("_host", "_layout").agg(F.min_by("html", "_page").alias("reference"), F.count("*").alias("total")).where(F.col("total") >= LEAST_PAGES), "references")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], Node] = {}
        own: list[str] = []
        for batch in batches:
            counts = defaultdict(lambda: [0, 0])
            for at in range(0, batch.num_rows, 64):
                for host, kind, page, ref in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    if (host, kind) not in seen:
                        seen = {(host, kind): parse(ref)}  # the rows of a layout follow each other
                        own = [plain(n.text) for n in texts(seen[host, kind])]
                    for r, p in match(seen[host, kind], parse(page))[1]:
                        if r.index >= 0:
                            found = counts[host, kind, r.index]
                            found[0] += r.text == p.text or own[r.index] == plain(p.text)
                            found[1] += len(p.text)
            hosts, kinds, nodes = zip(*counts) if counts else ((), (), ())
            same, chars = zip(*counts.values()) if counts else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(kinds, pa.int64()), pa.array(nodes, pa.int32()), pa.array(same, pa.int64()), pa.array(chars, pa.int64())], names=["_host", "_layout", "node", "same", "chars"])

    by = ["_host", "_layout"]
    counted = own.join(reference, by).select(*by, "html", "reference").mapInArrow(align, "_host string, _layout long, node int, same long, chars long")
    nodes = counted.groupBy(*by, "node").agg(F.sum("same").alias("same"), F.sum("chars").alias("chars")).join(reference.select(*by, "total"), by)
    nodes = nodes.withColumn("fixed", F.col("same") >= SAME_SHARE * F.col("total"))
    slots = F.map_from_entries(F.collect_list(F.struct("node", F.when(F.col("fixed"), 0.0).otherwise(F.col("chars") / F.col("total")).alias("w"))))
    found = nodes.groupBy(*by).agg(F.sort_array(F.collect_list(F.when(F.col("fixed"), F.col("node")))).alias("constant"), slots.alias("slots"), F.max("node").alias("last"))
    weights = F.transform(F.sequence(F.lit(0), "last"), lambda k: F.coalesce(F.col("slots")[k], F.lit(0.0)))
    return written(reference.drop("total").join(found.select(*by, "constant", weights.alias("weights")), by), "wrappers")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text string, n_chars long): the main text of every page; n_chars its code points.

    A null or empty page, and one without text, gives the empty text. A page of a host with fewer than
    ``LEAST_PAGES`` pages of different main texts has no wrapper and is read by its own markup. Pages without an address are taken as
    one host; ids may be null or repeated. Repeated rows stay repeated; broken markup never fails; only the three columns are read."""
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col))
    placed = if_small(layouts(pages, url_col, html_col), "layouts")
    joined = _page(with_host(pages.select(id_col, url_col, html_col), url_col), html_col).join(placed.drop("counts"), "_page", "left")
    joined = joined.join(wrappers(pages, placed, url_col, html_col), ["_host", "_layout"], "left")

    def run(cols: list[list]) -> list[list]:
        out = [main_text(*page) for page in zip(*cols[2:])]
        return [cols[0], cols[1], out, list(map(len, out))]

    return map_slices(joined.select(id_col, url_col, html_col, "reference", "constant", "weights"), run, f"{kinds}, text string, n_chars long", rows=64)
