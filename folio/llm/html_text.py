"""Main text of web pages by wrapper induction.

Pages of a host are aligned by simple tree matching of their DOM trees, with runs of like siblings folded into one node. The trees of all of a host's pages
are merged into its wrapper; then every page is aligned to the wrapper, and each of its nodes learns on how many pages it stood and whether its text was always the same. Nodes
that stay the same while others vary are the template; varying nodes are the slots that content stands in. A page's
template nodes are dropped, and what remains of the article is written block by block. What varies from page to page and still is no
article (menus, adverts, forms, comments) is told by its element, role or name.

A node is template only if it stood on at least LEAST_PAGES pages and LEAST_SHARE of the host's. Aligned nodes have the same path of signs, so paths on fewer pages
hold no template, and they are left out before trees are merged; this bounds a wrapper and changes no result. Equal trees are merged once, others in groups by their hash, and groups again until one tree is left. Pages of a host with the same article (by the
hash of what would be extracted without a wrapper) count as one, so an article under several addresses is no evidence against its own text.

What a page adds is a count, a smallest and a largest hash for each node, so neither order nor partitions change a result, and a host with any share of all pages is counted where its pages lie. Pages are of
any size and depth: trees are walked without recursion and in time proportional to the page, but for the alignment of a level with another, which takes the product of their different children.

A null html or one without text gives an empty text. A null or odd url counts as a host of its own. A host whose pages are all alike (or that has less than
three) shows no template, so nothing is dropped as one. Repeated rows give equal results. Markup may be broken in any way; elements are
closed as browsers do. A kept column named ``text`` or ``n_chars`` is replaced by the result; other extra columns may have any name.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textbatch import small_batches, steps, tidy

#: Different trees that a task merges at once.
GROUP = 64
LEAST_PAGES = 3
LEAST_SHARE = 0.25
#: Wrappers are broadcast up to so many bytes in all; beyond, pages are joined with them by host.
BROADCAST_BYTES = 32 << 20

# Element names by how they lay out and nest (HTML's own classes).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SAME = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "thead": ("thead tbody tfoot tr td th", ("table",)), "tbody": ("thead tbody tfoot tr td th", ("table",)), "tfoot": ("thead tbody tfoot tr td th", ("table",))}
# Elements, roles and name parts of what is no article.
NOT_TEXT = frozenset("head script style noscript template iframe object embed svg canvas form button select textarea input nav footer aside menu dialog title xmp noembed noframes audio video map".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
NOT_NAMES = frozenset("nav navbar navigation menu menus sidebar sidebars footer header masthead topbar ad ads adv advert adverts advertisement advertisements adsense banner banners cookie cookies consent gdpr notice notices notification popup modal overlay promo promotion social share sharing related recommended recommendations comment comments reply replies respond discussion disqus breadcrumb breadcrumbs newsletter subscribe subscription signup login widget widgets sponsor sponsored sponsors toolbar pagination pager skip hidden paywall tagcloud toc".split())
MAIN_NAMES = frozenset("article main content post entry story text body".split())

#: Within an article a name only rejects an element if these and the names above are all that it says: ``comment-list`` does, ``menu-recipe`` doesn't.
NEUTRAL = MAIN_NAMES | frozenset("list box wrap wrapper container area section block inner outer item items bar panel links link title form feed group module unit slot row col column left right top bottom site page primary secondary js first last blog web app button buttons icons icon holder".split())

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"(?i)\b(class|id|role|hidden|aria-hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_PARTS = re.compile(r"[A-Za-z]+")
_HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")


class Node:
    __slots__ = ("tag", "attrs", "kids", "up", "in_article")

    def __init__(self, tag: str, attrs: str = "", up: Node | None = None):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up
        self.in_article = up is not None and (up.in_article or up.tag == "article")

    def words(self) -> dict[str, str]:
        return {m[1].lower(): next(x for x in (*m.groups()[1:], "") if x is not None) for m in _ATTR.finditer(self.attrs)} if self.attrs else {}

    def tokens(self) -> list[list[str]]:
        """The parts, in lower case, of each class and of the id."""
        w = self.words()
        return [[p.lower() for p in _PARTS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", t))] for t in (*w.get("class", "").split(), w.get("id", ""))]

    def names(self) -> list[str]:
        return [p for t in self.tokens() for p in t]

    def sign(self) -> str:
        return ".".join([self.tag, *sorted(set(self.names()))]) if self.attrs else self.tag

    def rejected(self, inside: bool) -> bool:
        """Whether the element, its role or its name says that it is no article; inside one, part of a name isn't enough."""
        if self.tag in NOT_TEXT:
            return True
        if self.tag == "header":
            return not self.in_article
        if not self.attrs:
            return False
        w = self.words()
        if w.get("role", "").lower() in NOT_ROLES or w.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(w.get("style", "")) or re.search(r"(?i)(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", self.attrs)):
            return True
        if self.tag in ("article", "body", "html", "main") or NOT_NAMES.isdisjoint(self.names()):
            return False
        if not inside:
            return True
        tokens = [t for t in self.tokens() if t]
        return not any(MAIN_NAMES.issuperset(t) for t in tokens) and any(not NOT_NAMES.isdisjoint(t) and (NOT_NAMES | NEUTRAL).issuperset(t) for t in tokens)


def _tag_end(text: str, at: int, last: dict[str, int]) -> int:
    """Where a tag ends: after the next ``>`` outside quotes. A quote that nothing closes is an ordinary character."""
    start = at
    while m := _STOP.search(text, at):
        if m[0] == ">":
            return m.end()
        at = m.end() if last[m[0]] <= m.start() else text.find(m[0], m.end()) + 1
    return text.find(">", start) + 1


def parse(text: str) -> Node:
    """The tree of a page; texts are strings among the children, character references decoded."""
    now = root = Node("#root")
    opened: Counter[str] = Counter()

    def say(part: str) -> None:
        if part:
            now.kids.append(entities.unescape(part) if "&" in part else part)

    def leave(to: Node) -> Node:
        n = now
        while n is not to:
            opened[n.tag] -= 1
            n = n.up
        return to

    said = look = 0
    last = {c: text.rfind(c) for c in "\"'>"}
    while (i := text.find("<", look)) >= 0:
        m = None
        if text.startswith("<!--", i):
            end = text.find("-->", i + 4)
            end = len(text) if end < 0 else end + 3
        elif i > last[">"]:
            break
        elif m := _TAG.match(text, i):
            end = _tag_end(text, m.end(), last)
        elif text[i + 1 : i + 2] in ("!", "?"):
            end = text.find(">", i) + 1
        else:
            look = i + 1
            continue
        say(text[said:i])
        said = look = end
        if not m:
            continue
        tag, attrs = m[2].lower(), text[m.end() : end - 1]
        if m[1]:
            if opened[tag]:
                n = now
                while n.tag != tag:
                    n = n.up
                now = leave(n.up)
            continue
        if tag in CLOSES_P and opened["p"]:
            n = now
            while n.up and n.tag != "p" and n.tag in INLINE:
                n = n.up
            if n.tag == "p":
                now = leave(n.up)
        if tag in SAME:
            ends, stop = SAME[tag]
            ends, out, n = ends.split(), None, now
            while n.up and n.tag not in stop and any(opened[e] for e in ends):
                if n.tag in ends:
                    out = n
                n = n.up
            now = leave(out.up) if out else now
        new = Node(tag, attrs.strip(), now)
        now.kids.append(new)
        if tag in RAW:
            close = re.compile(rf"(?i)</{re.escape(tag)}\s*[^>]*>").search(text, end)
            if tag in ("title", "textarea"):
                new.kids.append(entities.unescape(text[end : close.start() if close else len(text)]))
            said = look = close.end() if close else len(text)
        elif tag not in VOID and not attrs.endswith("/"):
            now = new
            opened[tag] += 1
    say(text[said:])
    return root


# --- wrappers --------------------------------------------------------------------------------------------------------------------
# A node of a folded tree is [sign, hash of its text, children]; a wrapper's has its number instead of a hash.

#: A prime below 2 ** 62 and a factor.
_MODULUS, _BASE = 0x365B96B7A2BEEE31, 0x1F3D5B79A2C4E681


@functools.lru_cache(10_000)
def _power(n: int) -> int:
    return pow(256, n, _MODULUS)


def text_hashes(root: Node) -> dict[int, int]:
    """A hash of the words below each element that is no inline one, by the element's id.

    It is their bytes, a space after each word, read as one number, modulo a prime: each is cut out of that of the page up to there.
    """
    sums, ends, parts, begin, out = [0], [0], [], {}, {}

    def flush() -> None:
        if words := "".join(parts).split():
            said = (" ".join(words) + " ").encode("utf-8", "surrogatepass")
            sums.append((sums[-1] * _power(len(said)) + int.from_bytes(said)) % _MODULUS)
            ends.append(ends[-1] + len(said))
        parts.clear()

    todo: list = [(root, False)]
    while todo:
        n, done = todo.pop()
        if isinstance(n, str):
            parts.append(n)
            continue
        if n.tag not in INLINE:
            flush()
            if done:
                i = begin[id(n)]
                out[id(n)] = (sums[-1] - sums[i] * _power(ends[-1] - ends[i])) % _MODULUS
                continue
            begin[id(n)] = len(sums) - 1
            todo.append((n, True))
        todo += [(k, False) for k in reversed(n.kids)]
    return out


def skeleton(root: Node) -> tuple[list, list]:
    """The folded tree of a page and, of the same shape, the DOM nodes that each folded node stands for."""
    hashes = text_hashes(root)
    top: tuple[list, list] = ([], [])
    todo = [([root], *top)]
    while todo:
        nodes, kids, places = todo.pop()
        groups: list[tuple[str, list[Node]]] = []
        for k in nodes:
            for c in k.kids:
                if not isinstance(c, str) and c.tag not in INLINE and c.tag not in RAW:
                    sign = c.sign()
                    if groups and groups[-1][0] == sign:
                        groups[-1][1].append(c)
                    else:
                        groups.append((sign, [c]))
        for sign, same in groups:
            h, below, where = 0, [], []
            for n in same:
                h = (h * _BASE + hashes[id(n)] + 1) % _MODULUS
            kids.append([sign, h, below])
            places.append((same, where))
            todo.append((same, below, where))
    return top


def flat(nodes: list) -> str:
    """A tree of any depth as JSON: in order from the top, each node with the number of its children."""
    out, todo = [], list(reversed(nodes))
    while todo:
        sign, h, kids = todo.pop()
        out.append((sign, h, len(kids)))
        todo += reversed(kids)
    return json.dumps((len(nodes), out), separators=(",", ":"))


def deep(said: str) -> list:
    """What flat() wrote, as a tree again."""
    n, nodes = json.loads(said)
    top: list = []
    todo = [(top, n)]
    for sign, h, many in nodes:
        while len(todo[-1][0]) == todo[-1][1]:
            todo.pop()
        kids: list = []
        todo[-1][0].append([sign, h, kids])
        todo.append((kids, many))
    return top


def preorder(nodes: list) -> Iterator[list]:
    """A forest's nodes from the top, in order."""
    todo = list(reversed(nodes))
    while todo:
        yield (node := todo.pop())
        todo += reversed(node[2])


def shape(nodes: list) -> str:
    """A forest's signs, in order from the top, each with the number of its children."""
    return json.dumps((len(nodes), [(n[0], len(n[2])) for n in preorder(nodes)]), separators=(",", ":"))


def grown(said: str) -> list:
    """What shape() wrote, as a forest whose nodes have their places in it for hashes."""
    n, signs = json.loads(said)
    top: list = []
    todo = [(top, n)]
    for i, (sign, many) in enumerate(signs):
        while len(todo[-1][0]) == todo[-1][1]:
            todo.pop()
        kids: list = []
        todo[-1][0].append([sign, i, kids])
        todo.append((kids, many))
    return top


def paths(nodes: list) -> list[int]:
    """A hash of each node's signs from the top down to its own, in preorder."""
    out, todo = [], [(n, b"") for n in reversed(nodes)]
    while todo:
        node, above = todo.pop()
        here = xxhash.xxh3_128_digest(above + node[0].encode("utf-8", "surrogatepass"))
        out.append(int.from_bytes(here[:8], signed=True))
        todo += [(k, here) for k in reversed(node[2])]
    return out


def pruned(nodes: list, kept: frozenset[int]) -> list:
    """The forest without nodes of other paths; what stands below one goes with it."""
    out: list = []
    where = {id(n): out for n in nodes}
    for node, path in zip(preorder(nodes), paths(nodes), strict=True):
        into = where[id(node)]
        below: list | None = None
        if into is not None and path in kept:
            into.append([node[0], 0, below := []])
        where.update((id(k), below) for k in node[2])
    return out


def merged(trees: list[list]) -> list:
    """One forest that holds all, the largest first, so that others find their places in it."""
    return functools.reduce(merge, sorted(trees, key=lambda t: (-sum(1 for _ in preorder(t)), shape(t))))


def placed(mine: list, theirs: list) -> list[int]:
    """For each of the first forest's nodes, in preorder, the number of its partner in the second, or -1."""
    known, got = match(mine, theirs), {}
    todo = [(mine, theirs)]
    while todo:
        x, y = todo.pop()
        for i, j in known[id(x), id(y)][1]:
            got[id(x[i])] = y[j][1]
            if x[i][2] and y[j][2]:
                todo.append((x[i][2], y[j][2]))
    return [got.get(id(n), -1) for n in preorder(mine)]


def _align(a: list, b: list, known: dict) -> tuple[int, list[tuple[int, int]]]:
    """The largest number of nodes matched in order, given those of the children, and the pairs of this level."""
    gain_of = lambda x, y: 1 + (known[id(x[2]), id(y[2])][0] if x[2] and y[2] else 0)
    # What the other level has no sign of can't be matched.
    both = {x[0] for x in a} & {y[0] for y in b}
    at, to = [i for i, x in enumerate(a) if x[0] in both], [j for j, y in enumerate(b) if y[0] in both]
    a, b = [a[i] for i in at], [b[j] for j in to]
    signs = [x[0] for x in a]
    if signs == [y[0] for y in b] and len(both) == len(signs):
        return sum(map(gain_of, a, b)), list(zip(at, to, strict=True))
    gain = {}
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            most = max(below[j], row[j + 1])
            if a[i][0] == b[j][0]:
                gain[i, j] = gain_of(a[i], b[j])
                most = max(most, gain[i, j] + below[j + 1])
            row[j] = most
    pairs, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if (i, j) in gain and best[i][j] == gain[i, j] + best[i + 1][j + 1]:
            pairs.append((at[i], to[j]))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return best[0][0], pairs


def match(a: list, b: list) -> dict:
    """Simple tree matching of two lists of children: for each two lists that may be matched, by their ids, how many nodes and which pairs."""
    known: dict = {}
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        if (id(x), id(y)) not in known:
            by: dict[str, list] = {}
            for q in y:
                by.setdefault(q[0], []).append(q[2])
            wait = [(p[2], q) for p in x if p[2] for q in by.get(p[0], ()) if q and (id(p[2]), id(q)) not in known]
            if wait:
                todo += wait
                continue
            known[id(x), id(y)] = _align(x, y, known)
        todo.pop()
    return known


def merge(a: list, b: list) -> list:
    """A tree with the nodes of both: matched ones once, others where they stood."""
    known = match(a, b)
    out: list = []
    todo = [(a, b, out)]
    while todo:
        x, y, into = todo.pop()
        i = j = 0
        for p, q in [*(known[id(x), id(y)][1] if x and y else ()), (len(x), len(y))]:
            into += x[i:p]
            into += y[j:q]
            if p < len(x) and q < len(y):
                below: list = []
                into.append([x[p][0], 0, below])
                todo.append((x[p][2], y[q][2], below))
            i, j = p + 1, q + 1
    return out


# --- extraction ------------------------------------------------------------------------------------------------------------------

#: Shapes whose alignment to a wrapper a task remembers; for the wrapper that it has in hand.
KNOWN_SHAPES = 200
SLOTS = ("p", "div", "section", "article", "h1", "h2", "td", "li")


class Wrapper:
    """A host's wrapper with what its pages said: for each node its pages, and its text's hash if that was always the same. rare: whether a slot that is too rare for the wrapper varies."""

    def __init__(self, tree: str, seen: int, stats: str, rare: bool):
        self.nodes = grown(tree)
        said = json.loads(stats)
        varied = {x["node"] for x in said if not x["same"] and x["n"] >= LEAST_PAGES}
        varies = rare or any(not kids and k in varied and sign.split(".")[0] in SLOTS for sign, k, kids in preorder(self.nodes))
        # Template nodes with the hashes of their texts.
        self.constant = {x["node"]: x["h"] for x in said if x["same"] and x["n"] >= max(LEAST_PAGES, LEAST_SHARE * seen)} if varies else {}
        self.placed: dict[str, list[int]] = {}

    def places(self, kids: list) -> list[int]:
        """placed(kids, nodes), remembered by shape."""
        if (found := self.placed.get(name := shape(kids))) is None:
            if len(self.placed) >= KNOWN_SHAPES:
                self.placed.clear()
            found = self.placed[name] = placed(kids, self.nodes)
        return found


def template_nodes(page: Node, wrapper: Wrapper | None) -> set[int]:
    """The ids of the page's nodes that are template: aligned to a wrapper's node that never varied on its part of the host's pages, and saying the same."""
    constant: set[int] = set()
    if wrapper is None or not wrapper.constant:
        return constant
    kids, places = skeleton(page)
    for node, k, same in zip(preorder(kids), wrapper.places(kids), stood(places), strict=True):
        if wrapper.constant.get(k) == node[1]:
            constant.update(map(id, same))
    return constant


def stood(places: list) -> Iterator[list[Node]]:
    """The DOM nodes of a skeleton's nodes in preorder."""
    todo = list(reversed(places))
    while todo:
        same, below = todo.pop()
        yield same
        todo += reversed(below)


def blocks(node: Node, dropped: set[int], inside: bool) -> list[str]:
    """Texts of the node's blocks in page order, white space folded; rejected and dropped nodes are left out. inside: the node is an article's container."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    todo: list = [node]
    while todo:
        n = todo.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            held.append(n)
        elif n.tag == "br":
            held.append(" ")
        elif n is node or not (id(n) in dropped or n.rejected(inside)):
            if n.tag not in INLINE:
                flush()
                todo.append(None)
            todo += reversed(n.kids)
    flush()
    return out


def _find(root: Node, dropped: set[int], wanted) -> list[Node]:
    """Outermost nodes that are wanted, in page order."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if isinstance(n, str) or id(n) in dropped or (n is not root and n.rejected(False)):
            continue
        if n is not root and wanted(n):
            out.append(n)
        else:
            todo += reversed(n.kids)
    return out


def article(root: Node, dropped: set[int]) -> list[str]:
    """Blocks of all article containers in page order, or of the whole page where there is none."""
    for wanted in (lambda n: n.tag == "article", lambda n: n.tag == "main" or n.words().get("role") == "main", lambda n: n.tag in ("div", "section") and not MAIN_NAMES.isdisjoint(n.names())):
        if found := [b for n in _find(root, dropped, wanted) for b in blocks(n, dropped, True)]:
            return found
    return blocks(root, dropped, False)


def extract(text: str, wrapper: Wrapper | None) -> str:
    root = parse(text)
    return "\n".join(article(root, template_nodes(root, wrapper)))


# --- on Spark --------------------------------------------------------------------------------------------------------------------

def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def wrappers(pages: DataFrame, url: str, html: str, scratch: Scratch) -> DataFrame:
    """(host, wrapper, seen: the number of differing pages, stats as JSON, rare) from all pages; hosts where no path is on enough pages have none."""
    given = pages.select(host(F.col(url)).alias("host"), F.col(html).alias("html")).where("host <> '' and html is not null")

    @tidy
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, "html"):
            keys, shapes, hashes = [], [], []
            for t in texts:
                root = parse(t)
                keys.append(xxhash.xxh3_128_digest("\n".join(article(root, set())).encode("utf-8", "surrogatepass")))
                kids = skeleton(root)[0]
                shapes.append(shape(kids))
                hashes.append([n[1] for n in preorder(kids)])
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(keys, pa.binary()), pa.array(shapes, pa.string()), pa.array(hashes, pa.list_(pa.int64()))], ["host", "article", "shape", "hashes"])

    @tidy
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, shapes in steps(batches, "shape"):
            rows = [(name, path, n) for name, said, n in zip(batch.column("host").to_pylist(), shapes, batch.column("n").to_pylist(), strict=True) for path in set(paths(grown(said)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["host", "path", "n"])

    @tidy
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, shapes in steps(batches, "shape"):
            found = [shape(pruned(grown(s), frozenset(kept))) for s, kept in zip(shapes, batch.column("paths").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.string())], ["host", "wrapper"])

    def join(table: pa.Table) -> pa.Table:
        tree = merged([grown(t) for t in table.column("wrapper").to_pylist()])
        return pa.table({"host": pa.array([table.column("host")[0].as_py()], pa.string()), "wrapper": pa.array([shape(tree)], pa.string())})

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrapper = functools.lru_cache(100)(grown)
        held: dict[tuple[str, int], list[int]] = {}

        @functools.lru_cache(2000)
        def plan(said: str, known: str) -> list[tuple[int, int]]:
            """(place in the page, number) of aligned nodes and, with numbers from -2 down that tell their paths, of leaves of other paths that could be slots."""
            nodes = grown(said)
            to, out = placed(nodes, wrapper(known)), {}
            for node, k, path in zip(preorder(nodes), to, paths(nodes), strict=True):
                if k >= 0:
                    out[k] = node[1]
                elif not node[2] and node[0].split(".")[0] in SLOTS:
                    out.setdefault(-2 - (path & (1 << 62) - 1), node[1])
            return [(i, k) for k, i in out.items()]

        def out() -> pa.RecordBatch:
            cols = [[k[0] for k in held], [k[1] for k in held], *([v[i] for v in held.values()] for i in range(3))]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), *[pa.int64()] * 4), strict=True)], ["host", "node", "n", "low", "high"])

        def see(key: tuple[str, int], h: int) -> None:
            now = held.setdefault(key, [0, h, h])
            now[0], now[1], now[2] = now[0] + 1, min(now[1], h), max(now[2], h)

        for batch, shapes in steps(batches, "shape"):
            for name, said, hashes, known in zip(batch.column("host").to_pylist(), shapes, batch.column("hashes").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                see((name, -1), 0)
                for i, k in plan(said, known):
                    see((name, k), hashes[i])
                if len(held) > 100_000:
                    yield out()
        if held:
            yield out()

    # A row for each host and article, so that neither a host with most pages nor an article with most copies lands in one task.
    folded = scratch.table(given.mapInArrow(fold, "host string, article binary, shape string, hashes array<long>").groupBy("host", "article").agg(F.min(F.struct("shape", "hashes")).alias("tree")).select("host", "tree.*"), "folded")
    shapes = scratch.table(folded.groupBy("host", "shape").agg(F.count("*").alias("n")), "shapes")
    seen = shapes.groupBy("host").agg(F.sum("n").alias("seen"))
    # A host keeps four times as many paths as its pages have on average, at most.
    enough = F.col("n") >= F.greatest(F.lit(LEAST_PAGES), F.lit(LEAST_SHARE) * F.col("seen"))
    kept = shapes.mapInArrow(walk, "host string, path long, n long").groupBy("host", "path").agg(F.sum("n").alias("n")).join(seen, "host").where(enough)
    kept = scratch.table(kept.groupBy("host").agg(F.collect_list("path").alias("paths")), "paths")
    trees = scratch.table(shapes.select("host", "shape").join(kept, "host").mapInArrow(prune, "host string, wrapper string").distinct(), "trees")
    while (most := trees.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        sizes = trees.groupBy("host").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
        grouped = trees.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("wrapper"), F.col("groups"))).groupBy("host", "part")
        trees = scratch.table(grouped.applyInArrow(join, "host string, wrapper string").distinct(), f"merged{most}")
    joined = folded.join(F.broadcast(trees) if _bytes(trees, "wrapper") <= BROADCAST_BYTES else trees, "host")
    counts = joined.mapInArrow(count, "host string, node long, n long, low long, high long").groupBy("host", "node").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    stat = F.when(F.col("node") >= 0, F.struct("node", "n", F.col("low").alias("h"), (F.col("low") == F.col("high")).alias("same")))
    rare = F.max((F.col("node") < -1) & (F.col("n") >= LEAST_PAGES) & (F.col("low") != F.col("high")))
    stats = counts.groupBy("host").agg(F.max(F.when(F.col("node") == -1, F.col("n"))).alias("seen"), F.to_json(F.collect_list(stat)).alias("stats"), rare.alias("rare"))
    return trees.join(stats, "host").select("host", "wrapper", "seen", "stats", "rare")


def _bytes(table: DataFrame, *columns: str) -> int:
    """The size of the columns of a table that was written before, with its hosts."""
    return table.agg(F.coalesce(F.sum(sum((F.length(c) for c in columns), F.length("host"))), F.lit(0))).first()[0]


def main_text(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), scratch: Scratch | None = None) -> DataFrame:
    """keep's columns with text and n_chars (code points), one row for every row."""
    scratch = scratch or Scratch(pages.sparkSession, "wrappers")
    small_batches(pages.sparkSession)
    known = scratch.table(wrappers(pages, url, html, scratch), "wrappers")
    kept = [c for c in keep if c.lower() not in ("text", "n_chars")]
    given = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(html).alias("html"), host(F.col(url)).alias("host"))
    joined = given.join(F.broadcast(known) if _bytes(known, "wrapper", "stats") <= BROADCAST_BYTES else known, "host", "left").drop("host")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrapper = functools.lru_cache(100)(lambda tree, *said: Wrapper(tree, *said) if tree else None)
        for batch, texts in steps(batches, "html"):
            held = map(wrapper, *(batch.column(c).to_pylist() for c in ("wrapper", "seen", "stats", "rare")))
            found = [extract(t, w) if t else "" for t, w in zip(texts, held, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["row", "text", "n_chars"])

    return joined.mapInArrow(run, f"row {joined.schema['row'].dataType.simpleString()}, text string, n_chars long").select("row.*", "text", "n_chars")


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
