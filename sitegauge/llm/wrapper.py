"""Main-text extraction by wrapper induction.

Method: pages of a host are made from a few templates. Every page is parsed into its DOM tree, whose blocks have a label (tag and
class), a path of labels and a text (that of their inline nodes with it). For every host, and for each of its layouts (pages with equal
upper paths), one page is the wrapper, and all other distinct pages are aligned with it by simple tree matching: the largest order-keeping
top-down alignment of equal labels. A block of the wrapper whose text is the same in ``SHARE`` of the pages that have a partner for it is
constant, so template; the others are slots. From the wrapper's top the block that holds ``HELD`` of the text of all slots below is entered, again and again, as long
as the slot that is the highest heading is not left behind: where that ends is the content root of the layout, whatever its tag. Every page is then read whole: the block at its
layout's content root (the host's, for a layout of few pages; in it the articles, if it has some), without the parts that are never content (menus, forms, notices and so on, by
tag, role, class, id and style, and readers' comments by their heading) and without the host's template blocks. Pages without a wrapper are read from their article or main
element, the one with the most text of its own, else from the body. Blocks that would take more than ``MOST`` of an article's characters are no template of it but what copies share, and stay.
"""

from __future__ import annotations

import html as _html
import re
import sys
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.runtime import cut

#: How many pages, and what share of the pages aligned with a block, must hold a text for it to be template.
LEAST_PAGES, SHARE = 3, 0.5
#: Share of an article's characters that template can be.
MOST = 0.5
#: Share of the slots' text that a block must hold to be entered on the way to the content root.
HELD = 0.7
#: Bytes of all hosts' wrappers up to which they are broadcast; beyond, they are joined by shuffles.
BROADCAST_BYTES = 4 << 20
#: Cells of an alignment's table that are held at once; larger ones are halved (Hirschberg, 1975).
_CELLS = 1 << 22

# Fixed values of HTML: elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset(
    "head script style noscript template nav header footer aside form iframe svg math canvas object audio video button select textarea dialog menu title xmp noembed noframes option input".split()
)
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices sidebar comment comments commentlist disqus "
    "menu nav navbar navigation breadcrumb breadcrumbs share sharing social related recommended newsletter subscribe subscription popup modal overlay footer masthead toolbar pagination pager".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Headings over readers' comments, in the languages of the corpus.
_COMMENTS = re.compile(
    r"(?:\d+ |no |reader |readers['’]? |user |latest |leave (?:a |your )?|post a |write a |add a |join the )?comments?(?: \(?\d+\)?)?:?|leave a reply|(?:\d+ |keine |leser)?kommentare?(?: \(?\d+\)?)?:?|(?:\d+ )?commentaires?(?: \(?\d+\)?)?:?|(?:\d+ )?comentarios?(?: \(?\d+\)?)?:?", re.I
)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)


#: Words that say no more than where a part stands or how it is laid out.
PLACES = frozenset(
    "area article articles blog bar block bottom box button buttons container content count desktop entry fixed floating global icon icons inner item items js large left link links list main media mobile module news outer page panel post posts primary reader readers right "
    "row secondary section side site slot small sticky story strip text thread title top trail user users zone unit widget wrap wrapper".split()
)


class Node:
    __slots__ = ("tag", "label", "path", "depth", "kids", "dropped")

    def __init__(self, tag: str, label: str, path: int, depth: int, dropped: bool):
        self.tag, self.label, self.path, self.depth, self.kids, self.dropped = tag, label, path, depth, [], dropped


def marked(value: str) -> bool:
    """Whether a name of a class or id list says no more than that its part is no content: ``ad-box``, not ``menu-of-the-day``."""
    for name in value.split():
        words = [w for w in re.split(r"[_-]+", name) if w and not w.isdigit()]
        if any(w in MARKS for w in words) and all(w in MARKS or w in PLACES for w in words):
            return True
    return False


def _dropped(tag: str, attrs: str) -> tuple[str, bool]:
    """The node's label and whether tag, role, class or id says that it is no content."""
    label, out = tag, tag in DROPPED
    if attrs and ("=" in attrs or "hidden" in attrs.lower()):
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "role":
                out |= value in ROLES
            elif name == "hidden":
                out = True
            elif name == "aria-hidden":
                out |= value == "true"
            elif name == "style":
                out |= bool(_UNSEEN.search(value))
            else:
                label += f".{value}" if name == "class" else ""
                out |= tag not in ("html", "body") and marked(value)
    return label, out


def parse(page: str) -> Node:
    """The DOM tree; kids are nodes and texts in order. Open elements end where HTML ends them. Linear in the page."""
    root = Node("", "", 0, 0, False)
    stack, at = [root], 0
    open_: dict[str, list[int]] = defaultdict(list)  # where elements of a tag are open
    blocks: list[int] = [0]  # where elements that are not inline are
    raw: str | None = None
    size = len(page)

    def end(k: int) -> None:
        while len(stack) > k:
            tag = stack.pop().tag
            open_[tag].pop()
            if blocks[-1] == len(stack):
                blocks.pop()

    while at < size:
        if raw is not None:  # the content of a script and the like, up to its end tag
            found = re.compile(rf"</{raw}(?=[\s/>])", re.I).search(page, at)
            stop = found.start() if found else size
            if raw in ("title", "textarea"):
                stack[-1].kids.append(page[at:stop])
            at, raw = stop, None
            continue
        m = _TOKEN.search(page, at)
        if not m:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            # an inline end tag ends nothing beyond its block
            if open_[tag] and not (tag in INLINE and blocks[-1] > open_[tag][-1]):
                end(open_[tag][-1])
            continue
        if tag in CLOSES_P:
            if open_["p"] and blocks[-1] == open_["p"][-1]:
                end(blocks[-1])
        elif tag in SIBLINGS:
            ends, within = SIBLINGS[tag]
            bound = max((open_[w][-1] for w in within if open_[w]), default=0)
            first = min((x[bisect_right(x, bound)] for x in (open_[e] for e in ends) if x and x[-1] > bound), default=0)
            if first:
                end(first)
        label, dropped = _dropped(tag, attrs)
        parent = stack[-1]
        node = Node(tag, label, zlib.crc32(label.encode(), parent.path), parent.depth + 1, dropped)
        parent.kids.append(node)
        if tag not in VOID and not attrs.endswith("/") or tag in RAW:
            open_[tag].append(len(stack))
            if tag not in INLINE:
                blocks.append(len(stack))
            stack.append(node)
            if tag in RAW:
                raw = tag
    return root


def _block(node: Node) -> tuple[str, list[Node]]:
    """The text of a block with its inline nodes, and the blocks in it, in order."""
    text, blocks, queue = [], [], node.kids[::-1]
    while queue:
        k = queue.pop()
        if isinstance(k, str):
            text.append(k)
        elif k.dropped or k.tag not in INLINE:
            blocks.append(k)
            text.append(" ")
        elif k.tag == "br":
            text.append(" ")
        else:
            queue += k.kids[::-1]
    return " ".join(_html.unescape("".join(text)).split()), blocks


class Tree:
    """A page's blocks in document order: label, path and text as hashes, how many blocks follow within each, the text's length, and its rank as a heading (0: none); as one array of 6 columns."""

    def __init__(self, rows: np.ndarray):
        self.label, self.path, self.text, self.size, self.chars, self.heading = rows.T.tolist()
        n = len(self.label)
        self.shape: list = [0] * n  # hash of a block's labels with all below it
        self.kids: list[list[int]] = [[] for _ in range(n)]
        for i in range(n - 1, -1, -1):
            k, last = i + 1, i + self.size[i]
            while k < last:
                self.kids[i].append(k)
                k += self.size[k]
            self.shape[i] = hash((self.label[i], *(self.shape[k] for k in self.kids[i])))


def layout_of(root: Node) -> int:
    """A page's layout: the hash of its upper paths."""
    upper: set[int] = set()
    stack = [root]
    while stack:
        n = stack.pop()
        if n.tag not in INLINE or not n.tag:
            upper.add(n.path)
        if n.depth < 4:
            stack += [k for k in n.kids if isinstance(k, Node) and (not k.dropped or k.tag == "header")]
    return zlib.crc32(",".join(map(str, sorted(upper))).encode())


def tree_rows(page: str) -> tuple[np.ndarray, int]:
    """The rows of a page's Tree, and its layout. Parts that are never content have no rows but those that can be headings."""
    rows: list[list[int]] = []
    root = parse(page)
    stack: list = [root]
    while stack:
        n = stack.pop()
        if isinstance(n, int):  # all below row n are there
            rows[n][3] = len(rows) - n
            continue
        text, blocks = _block(n)
        stack.append(len(rows))
        rows.append([zlib.crc32(n.label.encode()), n.path, zlib.crc32(text.encode()) if text else 0, 0, len(text), int(n.tag[1]) if n.tag in HEADINGS else 0])
        stack += [b for b in reversed(blocks) if not b.dropped or b.tag == "header"]
    return np.array(rows, np.int64), layout_of(root)


def content_root(wrapper: Tree, slots: dict[int, int]) -> int:
    """The path of the block that the slots' text (characters by block of the wrapper) is held by."""
    n = len(wrapper.label)
    below = [slots.get(i, 0) for i in range(n)]
    rank = [wrapper.heading[i] if wrapper.heading[i] and slots.get(i) else 7 for i in range(n)]
    for i in range(n - 1, -1, -1):
        below[i] += sum(below[k] for k in wrapper.kids[i])
        rank[i] = min(rank[i], *(rank[k] for k in wrapper.kids[i]), 7)
    at = 0
    while wrapper.kids[at] and below[at]:
        k = max(wrapper.kids[at], key=lambda k: below[k])
        if below[k] < HELD * below[at] or rank[k] > rank[at] or not wrapper.kids[k]:
            break
        at = k
    return wrapper.path[at]


class Matching:
    """Simple tree matching of the trees a and b: the largest order-keeping top-down alignment of equal labels."""

    def __init__(self, a: Tree, b: Tree):
        self.a, self.b = a, b
        self.known: dict[tuple, int] = {}
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * (len(a.label) + len(b.label)) + 1000))

    def weight(self, i: int, j: int) -> int:
        """The size of the alignment of the blocks i of a and j of b with all below them."""
        a, b = self.a, self.b
        if a.label[i] != b.label[j]:
            return 0
        if a.shape[i] == b.shape[j]:
            return a.size[i]
        key = a.shape[i], b.shape[j]
        if key not in self.known:
            x, y, same = self._middle(a.kids[i], b.kids[j])
            self.known[key] = 1 + sum(a.size[p] for p, _ in same) + (int(self._scores(x, y)[-1]) if x and y else 0)
        return self.known[key]

    def _middle(self, x: list[int], y: list[int]) -> tuple[list[int], list[int], list[tuple[int, int]]]:
        """The lists without what is alike at their begin and end, which some largest alignment pairs; at the end what is alike in text, too, goes first."""
        p, q, same = self.a.shape, self.b.shape, []
        n = min(len(x), len(y))
        e = 0
        while e < n and p[x[-1 - e]] == q[y[-1 - e]] and self.a.text[x[-1 - e]] == self.b.text[y[-1 - e]]:
            e += 1
        k = 0
        while k < n - e and p[x[k]] == q[y[k]]:
            k += 1
        while e < n - k and p[x[-1 - e]] == q[y[-1 - e]]:
            e += 1
        same = [*zip(x[:k], y[:k]), *zip(x[len(x) - e :], y[len(y) - e :])]
        return x[k : len(x) - e], y[k : len(y) - e], same

    def _weights(self, x: list[int], y: list[int]):
        """A row of weights against y for each of x; equal shapes are asked once."""
        q = [self.b.shape[j] for j in y]
        one = dict(zip(q, y))
        place = {h: k for k, h in enumerate(one)}
        spread = np.array([place[h] for h in q])
        rows: dict = {}
        for i in x:
            h = self.a.shape[i]
            if h not in rows:
                rows[h] = np.array([self.weight(i, j) for j in one.values()], np.int64)
            yield rows[h][spread]

    def _scores(self, x: list[int], y: list[int]) -> np.ndarray:
        """The last row of the alignment's table."""
        row = np.zeros(len(y) + 1, np.int64)
        for w in self._weights(x, y):
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(w > 0, row[:-1] + w, 0)))
        return row

    def _aligned(self, x: list[int], y: list[int]) -> list[tuple[int, int]]:
        if not x or not y:
            return []
        if len(x) * len(y) > _CELLS and len(x) > 1:
            half = len(x) // 2
            k = int((self._scores(x[:half], y) + self._scores(x[half:][::-1], y[::-1])[::-1]).argmax())
            return self._aligned(x[:half], y[:k]) + self._aligned(x[half:], y[k:])
        weights = list(self._weights(x, y))
        table = np.zeros((len(x) + 1, len(y) + 1), np.int64)
        for i, w in enumerate(weights):
            table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], np.where(w > 0, table[i, :-1] + w, 0)))
        out, i, j = [], len(x), len(y)
        while i and j:
            if table[i, j] == table[i - 1, j]:
                i -= 1
            elif table[i, j] == table[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((x[i], y[j]))
        return out

    def pairs(self) -> list[tuple[int, int]]:
        """The pairs of blocks of one largest alignment of the whole trees."""
        a, b, out, todo = self.a, self.b, [], [(0, 0)] if self.a.label[0] == self.b.label[0] else []
        while todo:
            i, j = todo.pop()
            if a.shape[i] == b.shape[j]:
                out += zip(range(i, i + a.size[i]), range(j, j + a.size[i]))
                continue
            out.append((i, j))
            x, y, same = self._middle(a.kids[i], b.kids[j])
            todo += same + self._aligned(x, y)
        return out


def _key(path: int, text: int) -> int:
    """The hash of the path above that of the text, as a signed number."""
    key = path << 32 | text
    return key - (key >> 63 << 64)


def block_key(node: Node, text: str) -> int:
    return _key(node.path, zlib.crc32(text.encode()))


def induce(pages: list[str]) -> tuple[list[int], dict[int, int]]:
    """The template and the content roots of all pages of one host: what wrappers() finds, in plain Python."""
    distinct = {}
    for rows, layout in map(tree_rows, pages):
        distinct[rows.astype("<i8").tobytes()] = layout
    out, roots = set(), {}
    for scope in {-1, *distinct.values()}:
        own = [x for x, layout in distinct.items() if scope in (-1, layout)]
        if len(own) < LEAST_PAGES:
            continue
        wrapper = Tree(_rows(min(own, key=lambda x: (zlib.crc32(x), x))))
        texts: dict[int, Counter] = defaultdict(Counter)
        chars: Counter = Counter()
        for x in own:
            page = Tree(_rows(x))
            for i, j in Matching(wrapper, page).pairs():
                texts[i][page.text[j]] += 1
                chars[i, page.text[j]] += page.chars[j]
        slots = {}
        for i, counts in texts.items():
            constant = {t for t, n in counts.items() if t and n >= LEAST_PAGES and n >= SHARE * counts.total()}
            out |= {_key(wrapper.path[i], t) for t in constant}
            if counts.total() >= LEAST_PAGES:
                slots[i] = sum(chars[i, t] for t in counts if t not in constant)
        roots[scope] = content_root(wrapper, slots)
    return sorted(out), roots


def _rows(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(-1, 6)


def _chars(top: Node, without: tuple[str, ...] = ()) -> int:
    """Characters of a part's text, without parts that are never content, or that are of the given tags."""
    total, queue = 0, [top]
    while queue:
        n = queue.pop()
        for k in n.kids:
            if isinstance(k, str):
                total += len(k.strip())
            elif not k.dropped and k.tag not in without:
                queue.append(k)
    return total


def _outermost(top: Node, tags: tuple[str, ...], path: int | None = None, hidden: bool = False) -> list[Node]:
    """The outermost nodes of the tags (or of the path) below ``top``, in order; ``hidden``: those that class and the like mark, too."""
    out, queue = [], [top]
    while queue:
        n = queue.pop()
        if (n.path == path if path is not None else n.tag in tags) and (hidden or not n.dropped):
            out.append(n)
        elif not n.dropped or n.tag in ("html", "") or hidden and n.tag in tags:
            queue += [k for k in reversed(n.kids) if isinstance(k, Node)]
    return out


def _tops(root: Node, path: int | None) -> list[Node]:
    """The nodes that hold the page's article: within its content root, if its wrapper has one, else anywhere."""
    within = max(_outermost(root, (), path), key=_chars, default=None) if path is not None else None
    if within is not None and within.tag in ("article", "main"):
        found = [within]
    else:
        found = _outermost(within or root, ("article", "main")) or (_outermost(root, ("article", "main"), hidden=True) if within is None else [])
    if len(found) > 1 and (within is None or any(n.tag == "main" for n in found)):
        found = [max(found, key=_chars)]  # several articles are one text only if the wrapper has them in one root
    if len(found) == 1 and found[0].tag == "main":
        inner = _outermost(found[0], ("article",))
        best = max(inner, key=_chars, default=None)
        if best is not None and _chars(best) >= _chars(found[0], ("article",)):
            found = [best]
    return found or ([within] if within is not None else _outermost(root, ("body",), hidden=True)[:1])


def main_text(page: str, template: frozenset[int] = frozenset(), roots: dict[int, int] | None = None) -> str:
    """The main text of a whole page; its blocks in order, joined by one blank.

    ``roots``: paths of content roots by layout, at -1 that of all layouts. Where template blocks would be over ``MOST`` of the text, as of a host
    whose pages are copies, it is read as if there were no template.
    """
    root = parse(page)
    path = roots.get(layout_of(root), roots.get(-1)) if roots else None
    tops = _tops(root, path)
    inside = bool(tops) and tops[0].tag in ("article", "main")
    silent: set[int] = set()  # what stands under a heading over comments

    def hush(n: Node) -> None:
        """Marks what follows such a heading within its part, up to the next heading of its rank."""
        rank = None
        for k in n.kids:
            if isinstance(k, Node) and k.tag in HEADINGS:
                if rank is not None and k.tag <= rank:
                    rank = None
                if rank is None and _COMMENTS.fullmatch(_block(k)[0]):
                    rank = k.tag
            if rank is not None and isinstance(k, Node):
                silent.add(id(k))

    blocks: list[tuple[str, bool]] = []  # text, and whether it is template
    words: list[str] = []
    constant: set[int] = set()  # of what blocks the own text is template

    def end_block(owner: Node) -> None:
        text = " ".join(_html.unescape("".join(words)).split())
        if text:
            blocks.append((text, id(owner) in constant))
        words.clear()

    for top in tops or [root]:
        queue: list = [(top, top)]
        while queue:
            n, owner = queue.pop()
            if n is None:
                end_block(owner)
            elif isinstance(n, str):
                words.append(n)
            elif n is not top and (id(n) in silent or n.dropped and not (inside and n.label == "header")):
                words.append(" ")
            elif n.tag == "br":
                words.append(" ")
            elif n.tag in INLINE:
                queue += [(k, owner) for k in reversed(n.kids)]
            else:
                end_block(owner)
                if template:
                    text, _ = _block(n)
                    if text and block_key(n, text) in template:
                        constant.add(id(n))
                if any(isinstance(k, Node) and k.tag in HEADINGS for k in n.kids):
                    hush(n)
                queue.append((None, n))
                queue += [(k, n) for k in reversed(n.kids)]
        end_block(top)
    lost = sum(len(t) for t, out in blocks if out)
    if lost > (MOST if inside else 1 - 1e-9) * sum(len(t) for t, _ in blocks):
        lost = 0
    return " ".join(t for t, out in blocks if not (out and lost))


def host_of(url):
    """Host column of a url column: after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, keys, roots): the template and the content roots by layout of every host of which enough pages are there. Pages with equal blocks count once; of pages of
    equal hash the one of least bytes is the wrapper.

    A page goes on as its tree, some numbers for each block. The wrapper pages are broadcast while their checked size is within
    ``BROADCAST_BYTES`` and joined by host and scope beyond that; what the pages' blocks hold is counted before any shuffle.
    """

    def trees(batches):
        for batch in batches:
            found = [tree_rows(h) for h in batch.column(1).to_pylist()]
            raw = [rows.astype("<i8").tobytes() for rows, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array([n for _, n in found], pa.int64())], names=["host", "tree", "layout"])

    def aligned(batches):
        for batch in batches:
            counts: Counter = Counter()
            chars: Counter = Counter()
            held: dict[bytes, Tree] = {}
            for host, scope, wrapper, tree in zip(*(c.to_pylist() for c in batch.columns)):
                if wrapper not in held:
                    held[wrapper] = Tree(_rows(wrapper))
                a, b = held[wrapper], Tree(_rows(tree))
                for i, j in Matching(a, b).pairs():
                    for text in (b.text[j], -1):  # -1: all pages that have a partner for the block
                        counts[host, scope, i, a.path[i], text] += 1
                        chars[host, scope, i, a.path[i], text] += b.chars[j]
            columns = [list(c) for c in zip(*counts)] or [[]] * 5
            kinds = (pa.string(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(list(counts.values()), pa.int64()), pa.array(list(chars.values()), pa.int64())], names=["host", "scope", "block", "path", "text", "n", "chars"])

    def entered(batches):
        for batch in batches:
            raw, blocks, slots = (batch.column(k).to_pylist() for k in (2, 3, 4))
            found = [content_root(Tree(_rows(w)), dict(zip(b, n, strict=True))) for w, b, n in zip(raw, blocks, slots, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["host", "scope", "root"])

    p = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where("html is not null and host <> ''")
    distinct = cut(p.mapInArrow(trees, "host string, tree binary, layout long").dropDuplicates(["host", "tree"]))
    both = distinct.select("host", F.explode(F.array(F.lit(-1).cast("long"), "layout")).alias("scope"), "tree")
    first = both.groupBy("host", "scope").agg(F.count("*").alias("n"), F.min(F.struct(F.crc32("tree").alias("h"), "tree")).alias("x"))
    chosen = cut(first.where(F.col("n") >= LEAST_PAGES).select("host", "scope", F.col("x.tree").alias("wrapper")))
    size = chosen.agg(F.sum(F.octet_length("wrapper") + F.length("host") + 16)).first()[0] or 0
    met = both.join(F.broadcast(chosen) if size <= BROADCAST_BYTES else chosen, ["host", "scope"]).select("host", "scope", "wrapper", "tree")
    rows = met.mapInArrow(aligned, "host string, scope long, block long, path long, text long, n long, chars long")
    often = cut(rows.groupBy("host", "scope", "block", "path", "text").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")).where(F.col("n") >= LEAST_PAGES))
    every = often.where("text = -1").select("host", "scope", "block", F.col("n").alias("all"), F.col("chars").alias("whole"))
    constant = often.where("text > 0").join(every, ["host", "scope", "block"]).where(F.col("n") >= SHARE * F.col("all"))
    keys = constant.groupBy("host").agg(F.sort_array(F.collect_set(F.expr("shiftleft(path, 32) | text"))).alias("keys"))
    fixed = constant.groupBy("host", "scope", "block").agg(F.sum("chars").alias("fixed"))
    slots = every.join(fixed, ["host", "scope", "block"], "left").select("host", "scope", "block", (F.col("whole") - F.coalesce("fixed", F.lit(0))).alias("slot"))
    slots = slots.groupBy("host", "scope").agg(F.collect_list(F.struct("block", "slot")).alias("s"))  # as long as the wrapper page has blocks
    root = chosen.join(slots, ["host", "scope"]).select("host", "scope", "wrapper", F.col("s.block").alias("blocks"), F.col("s.slot").alias("slots")).mapInArrow(entered, "host string, scope long, root long")
    roots = root.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("scope", "root"))).alias("roots"))
    return roots.join(keys, "host", "left").select("host", F.coalesce("keys", F.array().cast("array<bigint>")).alias("keys"), "roots")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text (empty if none), n_chars.

    A null or empty html has the empty text. Null ids and urls stay null (a page without url teaches no wrapper); repeated rows
    give a row each; other columns play no part. The wrappers are broadcast while their checked size is within
    ``BROADCAST_BYTES`` and joined by host beyond that.
    """
    found = cut(wrappers(pages, url_col, html_col))
    bytes_ = found.agg(F.sum(F.size("keys") * 8 + F.size("roots") * 16 + F.length("host") + 16)).first()[0] or 0
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    if bytes_ <= BROADCAST_BYTES:
        found = F.broadcast(found)
    rows = rows.join(found, "host", "left").select("id", "url", "html", "keys", "roots")

    def run(batches):
        for batch in batches:
            texts = [main_text(h, frozenset(k or ()), dict(r or ())) if h else "" for h, k, r in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, url string, text string, n_chars long")
