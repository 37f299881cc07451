"""Main text of web pages by wrapper induction.

Pages of a host are made from one template, or one for each type of page. In
how many of its host's pages with distinct texts a node recurs, at the same
path and with the same subtree, is counted over all of them. Pages are also
aligned with reference pages of their host by simple tree matching, the
largest mapping of nodes that keeps parents and the order of siblings. Nodes
that recur, or whose text is the same in the references, are the template,
slots whose text varies are content. The main text is the varying slots that
are left when the template and the parts named as boilerplate are gone; where
an article is marked, those in the article. Inside articles template is what
alignment maps onto the same in a reference and half of a host's pages repeat:
less is shared text, such as that of copies, and what stands elsewhere than the
template's own place is quoted.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.llm.common import cut, slices, tidy

#: Elements that hold no content. Fixed values.
HIDDEN = frozenset("script style noscript template svg math head title iframe object canvas audio video map datalist "
                   "select option textarea button form nav header footer aside menu dialog".split())
#: Elements that stand inside a line. Fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not markup. Fixed values.
BLOCK_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form "
                           "h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: What an open element of a kind is closed by. Fixed values.
CLOSED_BY = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
             "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]),
             "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option", "optgroup"]), "p": BLOCK_CLOSES_P}
#: Words of class, id and role that name boilerplate. Fixed values.
NAMED = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie "
                  "cookies consent gdpr notice notices notification alert popup modal overlay sidebar menu nav navbar "
                  "navigation breadcrumb breadcrumbs pagination pager footer header masthead comment comments reply "
                  "replies disqus respond share sharing social related recommended newsletter subscribe signup login "
                  "search widget toolbar skip complementary contentinfo search".split())
#: Words that only say where or what a named part is. Fixed values.
PLACED = frozenset("site global top bottom left right primary secondary bar box list links".split())
#: Elements that stay whatever they are named. Fixed values.
ROOTS = frozenset("html body main".split())
#: Html of one host in a task.
PART_BYTES = 2_000_000
#: Constants of all hosts are broadcast up to this size, and joined by host beyond it.
BROADCAST_BYTES = 8 << 20
#: Pairs of siblings that are weighed against each other at most.
CELLS = 4096
_EQUAL_BITS = 40
_ONE = 1 << _EQUAL_BITS
_WORD = re.compile(r"[A-Za-z]+")
#: Start and end tags as most are written, which need no forgiving. Fixed values.
_START = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z]+(?:-[a-z]+)*="[^"&<>]*")*)>')
_ATTRIBUTE = re.compile(r' ([a-z-]+)="([^"]*)"')
_END = re.compile(r"</([a-z][a-z0-9]*)>")
#: Elements after whose start tag the parser may read in another way. Fixed values.
_RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp plaintext".split())


def one_line(text: str) -> str:
    """White space and zero-width spaces as single spaces, none at the ends."""
    return " ".join((text.replace("\u200b", " ") if "\u200b" in text else text).split())


def _spaced(text: str) -> str:
    """White space and zero-width spaces as single spaces."""
    line = one_line(text)
    if not line:
        return " " if text else ""
    first, last = text[0], text[-1]
    return (" " * (first.isspace() or first == "\u200b") + line + " " * (last.isspace() or last == "\u200b"))


@lru_cache(maxsize=4096)
def names_boilerplate(value: str) -> bool:
    """Whether a token of a class, id or role names boilerplate with all its words."""
    for token in value.split():
        words = {w.lower() for w in _WORD.findall(token)}
        if words - PLACED and words <= NAMED | PLACED:
            return True
    return False


class Node:
    __slots__ = ("tag", "named", "hidden", "kids", "text", "hash", "size", "plain")

    def __init__(self, tag: str, named: bool = False, hidden: bool = False):
        self.tag, self.named, self.hidden = tag, named, hidden
        self.kids, self.text, self.hash, self.size, self.plain = [], "", None, 1, True


class _Builder(HTMLParser):
    """A forgiving DOM builder: text is a child named #."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def updatepos(self, i, j):
        return j  # nobody asks for lines and columns

    def parse_starttag(self, i):
        found = _START.match(self.rawdata, i)
        if found is None or found[1] in _RAW:
            return super().parse_starttag(i)
        self.lasttag = found[1]
        self.handle_starttag(found[1], _ATTRIBUTE.findall(found[2]) if found[2] else ())
        return found.end()

    def parse_endtag(self, i):
        found = _END.match(self.rawdata, i) if self.cdata_elem is None else None
        if found is None:
            return super().parse_endtag(i)
        self.handle_endtag(found[1])
        return found.end()

    def handle_starttag(self, tag, attrs):
        for i in range(len(self.open) - 1, 0, -1):
            if tag in CLOSED_BY.get(self.open[i].tag, ()):
                del self.open[i:]
                break
            if self.open[i].tag not in INLINE and self.open[i].tag != "p":
                break
        named = hidden = False
        for k, v in attrs:
            if v and k in ("class", "id", "role"):
                named = named or tag not in ROOTS and names_boilerplate(v)
            elif k in ("hidden",) or k == "aria-hidden" and v == "true":
                hidden = True
        node = Node(tag, named, hidden)
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "section", "article"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in ("article", "body", "main") and tag in INLINE:
                return

    def handle_data(self, data):
        node = Node("#")
        node.text = data
        self.open[-1].kids.append(node)


def parse(html: str, marked: bool = True) -> Node:
    """The tree of a page; its nodes have hashes and sizes if it is to be aligned (``marked``)."""
    b = _Builder()
    b.feed(html)
    b.close()
    if marked:
        _mark(b.root)
    return b.root


def _mark(root: Node) -> None:
    """Gives every node a hash of its subtree's tags and text, and its size."""
    todo = [(root, False)]
    while todo:
        node, done = todo.pop()
        if done or not node.kids:
            node.hash = hash((node.tag, node.text, *[k.hash for k in node.kids]))
            _measure(node)
        else:
            todo.append((node, True))
            todo += [(k, False) for k in node.kids]


def _measure(node: Node) -> None:
    """Sets a node's size, and whether it is plain: holds one text at most."""
    if node.kids:
        node.size = 1 + sum(k.size for k in node.kids)
        node.plain = len(node.kids) == 1 and node.kids[0].tag == "#"


def align(a: Node, b: Node, memo: dict) -> int:
    """Simple tree matching of two roots of one tag: the size of the largest mapping.

    Of mappings of one size that with most nodes in equal subtrees is taken.
    ``memo`` gets the pairs of children that it maps, for each pair of nodes.
    """
    return _weight(a, b, memo) >> _EQUAL_BITS


def _weight(a: Node, b: Node, memo: dict) -> int:
    """The size of the largest mapping, and in the low bits its nodes in equal subtrees."""
    if a.hash == b.hash:
        return a.size << _EQUAL_BITS | a.size
    if a.plain and b.plain:
        return 1 + min(len(a.kids), len(b.kids)) << _EQUAL_BITS
    if (id(a), id(b)) in memo:
        return memo[id(a), id(b)][0]
    x, y, pairs, total = a.kids, b.kids, [], 1 << _EQUAL_BITS
    i, p, q = 0, len(x), len(y)
    while i < p and i < q and x[i].hash == y[i].hash:
        pairs.append((x[i], y[i]))
        i += 1
    while p > i and q > i and x[p - 1].hash == y[q - 1].hash:
        p, q = p - 1, q - 1
        pairs.append((x[p], y[q]))
    for u, v in pairs:
        total += _weight(u, v, memo)
    for u, v in _segments(x[i:p], y[i:q]):
        total += _middle(u, v, pairs, memo)
    memo[id(a), id(b)] = total, pairs
    return total


def _middle(x: list[Node], y: list[Node], pairs: list, memo: dict) -> int:
    """Maps two lists of siblings in order; the pairs go to ``pairs``, their size comes back.

    The heaviest order-keeping mapping of children of one tag, or the next
    child of the same tag in turn where the lists are too long for that.
    """
    if len(x) == len(y) == 1:
        if x[0].tag != y[0].tag:
            return 0
        pairs.append((x[0], y[0]))
        return _weight(x[0], y[0], memo)
    if len(x) * len(y) > CELLS:
        total = at = 0
        for u in x:
            j = next((j for j in range(at, min(len(y), at + CELLS // len(x) + 1)) if y[j].tag == u.tag), None)
            if j is not None:
                total += _weight(u, y[j], memo)
                pairs.append((u, y[j]))
                at = j + 1
        return total
    best = [[0] * (len(y) + 1)]
    for u in x:
        above, row, last = best[-1], [0], 0
        for j, v in enumerate(y):
            if above[j + 1] > last:
                last = above[j + 1]
            if u.tag == v.tag:
                if u.plain and v.plain and u.hash != v.hash:
                    w = above[j] + (u.size if u.size < v.size else v.size) * _ONE
                else:
                    w = above[j] + _weight(u, v, memo)
                if w > last:
                    last = w
            row.append(last)
        best.append(row)
    i, j = len(x), len(y)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((x[i], y[j]))
    return best[-1][-1]


def _segments(x: list[Node], y: list[Node]) -> Iterator[tuple[list[Node], list[Node]]]:
    """Lists of siblings cut, if they are long, at equal subtrees that stand once in each.

    Of these the longest run in the order of both is taken.
    """
    if len(x) * len(y) <= CELLS:
        if x and y:
            yield x, y
        return
    times = Counter(u.hash for u in x), Counter(v.hash for v in y)
    place = {v.hash: j for j, v in enumerate(y)}
    common = [(i, place[u.hash]) for i, u in enumerate(x) if times[0][u.hash] == times[1][u.hash] == 1]
    ends: list[int] = []           # patience sorting: least last place of a run of each length
    tops: list[int] = []           # and the pair that ends it
    before = [-1] * len(common)
    for n, (_, j) in enumerate(common):
        k = bisect_left(ends, j)
        before[n] = tops[k - 1] if k else -1
        ends[k:k + 1], tops[k:k + 1] = [j], [n]
    chain, n = [], tops[-1] if tops else -1
    while n >= 0:
        chain.append(common[n])
        n = before[n]
    i = j = 0
    for p, q in [*reversed(chain), (len(x), len(y))]:
        if i < p and j < q:
            yield x[i:p], y[j:q]
        if p < len(x):
            yield x[p:p + 1], y[q:q + 1]
        i, j = p + 1, q + 1


def constant(a: Node, b: Node) -> set[int]:
    """The nodes of ``a``, by identity, that the largest mapping onto ``b`` maps to equal subtrees."""
    memo: dict = {}
    # trees may be as deep as they have nodes
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * min(a.size, b.size) + 10_000))
    align(a, b, memo)
    same, todo = set(), [(a, b)]
    while todo:
        u, v = todo.pop()
        if u.hash == v.hash:
            inner = [u]
            while inner:
                node = inner.pop()
                same.add(id(node))
                inner += node.kids
        elif (id(u), id(v)) in memo:
            todo += memo[id(u), id(v)][1]
    return same


def _boiler(node: Node, named: bool = True) -> bool:
    return node.tag in HIDDEN or node.hidden or named and node.named


def articles(root: Node) -> list[Node]:
    """The outermost marked articles, or else main elements, that are not hidden.

    Names don't count on articles and what they stand in, unless articles
    without such a name (the post, beside its comments) hold half the text.
    """
    for tag in ("article", "main"):
        found, clean, todo = [], [], [(root, False)]
        while todo:
            node, named = todo.pop()
            named = named or node.named
            if node.tag == tag and not node.hidden:
                found.append(node)
                if not named:
                    clean.append(node)
            elif not _boiler(node, False):
                todo += [(k, named) for k in reversed(node.kids)]
        if len(clean) < len(found) and 2 * _length(clean) >= _length(found) > 0:
            return clean
        if found:
            return found
    return []


def _length(roots: list[Node]) -> int:
    return sum(map(len, blocks(roots, set())))


def blocks(roots: list[Node], template: set[int], named: bool = True) -> list[str]:
    """Texts of the blocks under some nodes, without boilerplate and template nodes.

    The nodes themselves count whatever they are named, and with ``named``
    false all do.
    """
    return [text for text, _ in placed_blocks(roots, template, named)]


def placed_blocks(roots: list[Node], template: set[int], named: bool = True) -> list[tuple[str, list[int]]]:
    """The texts of ``blocks``, each with the block elements it stands in, by identity."""
    out: list[tuple[str, list[int]]] = []
    line: list[str] = []
    inside: list[int] = []

    def flush() -> None:
        text = one_line("".join(line))
        line.clear()
        if text:
            out.append((text, inside[:]))

    first = {id(r) for r in roots}
    todo: list = list(reversed(roots))
    while todo:
        node = todo.pop()
        if node is None:
            flush()
            inside.pop()
        elif node.tag == "#":
            if id(node) not in template:
                line.append(node.text)
        elif node.tag == "br":
            line.append(" ")
        elif not (_boiler(node, named and id(node) not in first) or id(node) in template):
            inline = node.tag in INLINE
            if not inline:
                flush()
                inside.append(id(node))
                todo.append(None)
            todo += reversed(node.kids)
    flush()
    return out


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=8).digest()


@lru_cache(maxsize=4096)
def _path(above: bytes, tag: str) -> bytes:
    return _digest(above, tag.encode())


def aligned(root: Node) -> dict[int, int]:
    """The nodes that are aligned across pages: block elements with text, by identity.

    Their names are hashes of the tags from the root down to them, and of the
    tags and texts below them. Boilerplate by tag has no say.
    """
    out, kids_of, todo = {}, {}, [(root, b"", False)]
    while todo:
        node, above, done = todo.pop()
        if done:
            parts = [kids_of.pop(id(k), b"") for k in node.kids]
            if any(parts):
                kids_of[id(node)] = below = _digest(node.tag.encode(), b"\0", *parts)
                if node.tag not in INLINE:
                    out[id(node)] = int.from_bytes(_digest(_path(above, node.tag), below), "big", signed=True)
        elif node.tag == "#":
            text = one_line(node.text)
            if text:
                kids_of[id(node)] = _digest(text.encode("utf-8", "surrogatepass"))
        elif node.tag not in HIDDEN and not node.hidden:
            todo.append((node, above, True))
            path = _path(above, node.tag)
            todo += [(k, path, False) for k in node.kids]
    return out


def survey(html: str) -> tuple[int, list[int], list | None]:
    """What one parse of a page tells: a hash of its text, its aligned nodes, its marked trees.

    The first of the nodes is 0, which every page has. The trees are those of
    its article or main elements (``flat``); None if the page marks none.
    """
    root = parse(html, False)
    marked = articles(root)
    names = aligned(root)
    text = "\n".join(blocks(marked or [root], set()))
    return (int.from_bytes(_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True),
            [0, *sorted(set(names.values()))], flat(marked, names) if marked else None)


def flat(roots: list[Node], names: dict[int, int]) -> list:
    """Trees without their boilerplate: depth, tag and name (0: none) or text of each node, from the top down."""
    out: list = []
    todo = [(r, 0) for r in reversed(roots)]
    while todo:
        node, depth = todo.pop()
        if node.tag == "#":
            out += depth, "#", _spaced(node.text)
        elif not (depth and _boiler(node)):
            out += depth, node.tag, names.get(id(node), 0)
            todo += [(k, depth + 1) for k in reversed(node.kids)]
    return out


def extract(html: str, references: list[str], recurring: frozenset[int] = frozenset()) -> str:
    """The main text of a page, given reference pages and the recurring nodes of its host."""
    root = parse(html)
    marked = articles(root)
    if marked:
        return "\n".join(blocks(marked, set()))
    votes: list[set[int]] = []
    for r in map(_reference, references):
        if r.hash != root.hash:  # a copy of the page tells nothing
            votes.append(constant(root, r))
    template = set.intersection(*votes) if votes else set()
    if recurring:
        template |= {i for i, name in aligned(root).items() if name in recurring}
    varying = blocks([root], template)
    return "\n".join(varying or blocks([root], set()) or blocks([root], set(), False))


@lru_cache(maxsize=256)
def _reference(html: str) -> Node:
    return parse(html)


def host(url: str | Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def packed(trees: list) -> bytes:
    """Marked trees, compressed: pages are held once between their parse and their template."""
    return zlib.compress(json.dumps(trees, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"), 1)


class Marked:
    """The packed trees of a page under one root, with the names of their aligned nodes.

    An aligned node is equal to another if the two have one name, so blanks
    and elements without text count no more than in the names.
    """

    def __init__(self, held: bytes):
        self.root = Node("#root")
        self.names: dict[int, int] = {}
        above, nodes = [self.root], [self.root]
        flat_ = json.loads(zlib.decompress(held).decode("utf-8", "surrogatepass"))
        for depth, tag, value in zip(flat_[::3], flat_[1::3], flat_[2::3]):
            node = Node(tag)
            if tag == "#":
                node.text = value
            elif value:
                self.names[id(node)] = value
            del above[depth + 1:]
            above[depth].kids.append(node)
            above.append(node)
            nodes.append(node)
        for node in reversed(nodes):
            node.hash = self.names.get(id(node)) or hash((node.tag, node.text.strip(), *[
                k.hash for k in node.kids if k.tag != "#" or k.text.strip()]))
            _measure(node)
        self.held = frozenset(self.names.values())


@lru_cache(maxsize=512)
def _marked_reference(held: bytes) -> Marked:
    return Marked(held)


def slots(held: bytes, constants: frozenset[int], references: list[bytes]) -> str:
    """The text of packed trees that varies.

    Template are the nodes that the largest mapping onto a reference maps to
    equal ones, if they are among the host's constants; constants that no
    reference holds are template by their name. An article that is mostly
    found elsewhere is a copy, whose text is its own.
    """
    page = Marked(held)
    others = [r for r in map(_marked_reference, references) if r.root.hash != page.root.hash]
    same = set().union(*[constant(page.root, r.root) for r in others])
    known = frozenset().union(*[r.held for r in others])
    template = {i for i, name in page.names.items() if name in constants and (i in same or name not in known)}
    whole = placed_blocks(page.root.kids, set())
    kept = [t for t, inside in whole if template.isdisjoint(inside)]
    if 2 * sum(map(len, kept)) < sum(len(t) for t, _ in whole):
        kept = [t for t, _ in whole]
    return "\n".join(kept)


def surveyed(rows: DataFrame) -> DataFrame:
    """Each page parsed once: its say in its host's template, and its marked trees or else its html."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("key", "url", "h")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 3, 2_000_000):
            pages = b.column(3).to_pylist()
            found = [survey(h) for h in pages]
            marked = [None if m is None else packed(m) for _, _, m in found]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array([t for t, _, _ in found], pa.int64()),
                 pa.array([n for _, n, _ in found], pa.list_(pa.int64())), pa.array(marked, pa.binary()),
                 pa.array([h if m is None else None for h, m in zip(pages, marked)], pa.string())],
                names=["key", "url", "h", "text", "nodes", "marked", "html"])

    return cut(rows.select("key", "url", "h", "html").mapInArrow(
        run, f"key {kinds['key']}, url {kinds['url']}, h {kinds['h']}, text long, nodes array<long>, "
             "marked binary, html string"))


def templates(pages: DataFrame, spread: DataFrame) -> DataFrame:
    """(h, recurring, constants) of surveyed pages: the template nodes of a host, by its hash.

    Of pages with one text, one counts. Recurring nodes stand in a tenth of a
    host's pages, and in three (in both of two); constants in half of them, and
    in three. So a host has ten times a page's nodes at most.
    """
    counts = (pages.groupBy("h", "text").agg(F.min("nodes").alias("nodes")).select("h", F.explode("nodes").alias("node"))
              .groupBy("h", "node").agg(F.count("*").alias("n")).where("n > 1 or node = 0"))
    counts = cut(counts)
    share = F.coalesce("parts", F.lit(1))
    totals = counts.where("node = 0").join(F.broadcast(spread), "h", "left").select(
        "h", F.col("n").alias("pages"), F.explode(F.sequence(F.lit(0), share - 1)).alias("part"))
    nodes = counts.where("node <> 0").join(F.broadcast(spread), "h", "left").withColumn(
        "part", F.pmod(F.xxhash64("node"), share).cast("int")).drop("parts")
    kept = nodes.join(totals, ["h", "part"]).where("n >= greatest(least(3, pages), ceil(pages / 10))")
    constants = F.when((F.col("n") >= 3) & (2 * F.col("n") >= F.col("pages")), F.col("node"))
    return cut(kept.groupBy("h").agg(F.collect_list("node").alias("recurring"),
                                     F.collect_list(constants).alias("constants")))


def large_hosts(rows: DataFrame) -> DataFrame:
    """(h, parts) of the hosts whose pages are dealt over several tasks.

    A part has PART_BYTES of html, or a ten-thousandth of all of it where that
    is more, so there are at most ten thousand such hosts, whatever the input.
    """
    sizes = rows.groupBy("h").agg(F.sum(F.length("html")).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    unit = max(PART_BYTES, total // 10_000 + 1)
    hot = [(r["h"], r["parts"]) for r in sizes.where(F.col("n") > unit).select(
        "h", F.ceil(F.col("n") / F.lit(unit)).cast("int").alias("parts")).collect()]
    return rows.sparkSession.createDataFrame(hot, "h long, parts int")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row.

    All pages of a host have a say in its template (``templates``). Marked
    pages are aligned with references, their host's marked pages with the least
    and the largest hash of their text; a page's text is what its article holds
    outside the template (``slots``), unless this is more than half of it: then
    it is a copy and stays whole. Other pages are aligned with their host's
    unmarked pages with the least and the largest hash of their html. A null html has an empty text. Null
    keys and urls are carried through (rows without a host form one), repeated
    rows are alike, other columns are not read, and an empty table stays empty.
    A tree may be as deep as a page has elements; long lists of siblings are
    aligned at equal subtrees.
    """
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn("h", F.xxhash64(host("url")))
    spread = large_hosts(rows)
    rows = surveyed(rows)
    found = templates(rows, spread)
    tidy(rows.sparkSession)
    parts = F.coalesce("parts", F.lit(1))

    def dealt(hosts: DataFrame) -> DataFrame:
        return hosts.join(F.broadcast(spread), "h", "left").withColumn(
            "part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")

    own = rows.join(F.broadcast(spread), "h", "left").withColumn(
        "part", F.pmod(F.xxhash64("key", "url", "text"), parts).cast("int")).drop("parts", "nodes", "text")
    marked = own.where("marked is not null").select("key", "url", "h", "part", "marked")
    named = F.struct("text", "marked")
    wrappers = cut(rows.where("marked is not null").groupBy("h").agg(F.min(named).alias("a"), F.max(named).alias("b"))
                   .select("h", F.array(F.col("a.marked"), F.col("b.marked")).alias("refs"))
                   .join(found.select("h", "constants"), "h", "left"))
    size = wrappers.agg(F.sum(8 * F.size(F.coalesce("constants", F.array())) + 64 + F.length(F.col("refs")[0])
                              + F.length(F.col("refs")[1]))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        marked = marked.join(F.broadcast(wrappers), "h")
    else:
        marked = marked.join(dealt(wrappers), ["h", "part"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for b in batches:
            texts = []
            for i, h in enumerate(b.column(2).to_pylist()):
                if h not in known:
                    if len(known) >= 4096:
                        known.clear()
                    known[h] = frozenset(b.column(4)[i].as_py() or ()), list(dict.fromkeys(b.column(5)[i].as_py()))
                texts.append(slots(b.column(3)[i].as_py(), *known[h]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())],
                                             names=["key", "url", "text"])

    marked = marked.select("key", "url", "h", "marked", "constants", "refs").mapInArrow(
        read, f"key {kind}, url string, text string")

    other = own.where("marked is null").drop("marked")
    hashed = F.struct(F.xxhash64("html").alias("a"), "html")
    references = (rows.where("marked is null").groupBy("h").agg(F.min(hashed).alias("a"), F.max(hashed).alias("b"))
                  .select("h", F.col("a.html").alias("ref_a"), F.col("b.html").alias("ref_b"))
                  .join(found.select("h", "recurring"), "h", "left"))
    other = other.join(dealt(references), ["h", "part"]).select("key", "url", "html", "ref_a", "ref_b", "h", "recurring")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for b in batches:
            texts = []
            for i, h in enumerate(b.column(5).to_pylist()):
                if h not in known:
                    if len(known) >= 256:
                        known.clear()
                    known[h] = (list(dict.fromkeys([b.column(3)[i].as_py(), b.column(4)[i].as_py()])),
                                frozenset(b.column(6)[i].as_py() or ()))
                texts.append(extract(b.column(2)[i].as_py(), *known[h]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())],
                                             names=["key", "url", "text"])

    other = other.mapInArrow(run, f"key {kind}, url string, text string")
    return marked.unionByName(other).select(F.col("key").alias(key), F.col("url").alias(url), "text",
                                            F.length("text").cast("long").alias("n_chars"))
