"""Main-text extraction by wrapper induction.

**Induction.** The trees of all pages of a host are aligned by simple tree matching (the largest
order-preserving matching of children, by dynamic programming) and folded into one template. Equal
neighbours (paragraphs, list items) are one repeated slot. Every template slot counts the pages it
occurs on and votes for its most frequent text. Each task folds the pages it reads; the partial
templates, which are small, are merged the same way per host, in two rounds so that no host's
partials meet in one task at once.

**Extraction.** A page is aligned with its host's template. Slots whose text is the same on nearly
all pages are template; slots inside navigation, notices and the like are, by their element or
the names that their author gave them, furniture; the other slots vary and are content. Where a page has an
article or main element, content is what lies inside it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import ROWS_AT_ONCE, map_arrow
from sheetwise.llm.html_tree import BLOCK, Node, parse

#: Elements, and words in class, id or role, that hold no main text.
FURNITURE_TAGS = frozenset(
    "head nav footer aside form script style noscript template iframe svg button select option input textarea "
    "menu dialog object embed canvas audio video math".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies disclaimer disqus footer gdpr hidden masthead menu modal nav navbar navigation "
    "newsletter notice notices pager pagination popup promo promotion related respond share sharing sidebar "
    "signup skip social sponsor sponsored subscribe tags toolbar widget".split())
FURNITURE_ROLES = frozenset(f"role={r}" for r in
                            "navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
CONTENT_MARKS = frozenset(("role=main", "articlebody", "article-body", "post-content", "entry-content"))

#: A text is template when about nine pages in ten of at least so many show it.
#: Hosts of fewer pages have no template: there only furniture is left out.
MIN_PAGES = 20
MIN_VOTE = 0.8
#: Hosts a task holds templates of before it hands them on.
MAX_HOSTS = 2000
#: Slots of one template (four times those of its largest page where that is more) before its rarest go.
MAX_SLOTS = 20_000
#: Templates together up to so many bytes are broadcast; more are joined with the pages by host.
MAX_BROADCAST_BYTES = 64 << 20

_WORD = re.compile(r"[a-z]+")


def is_furniture(node_tag: str, marks: Iterable[str], inside_article: bool) -> bool:
    """Whether an element holds no main text. A header inside an article is the article's own."""
    if node_tag in FURNITURE_TAGS or node_tag == "header" and not inside_article:
        return True
    for mark in marks:
        if mark in FURNITURE_ROLES:
            return True
        if not mark.startswith("role=") and node_tag not in ("html", "body", "article", "main") \
                and not FURNITURE_WORDS.isdisjoint(_WORD.findall(mark)):
            return True
    return node_tag == "article" and not {"comment", "comments"}.isdisjoint(marks)


class Slot:
    """A template node: ``key`` (tag and marks), pages seen on, vote for its text, child slots."""

    __slots__ = ("key", "pages", "text", "votes", "kids")

    def __init__(self, key: str, pages: int = 0, text: int = 0, votes: int = 0, kids: list | None = None):
        self.key, self.pages, self.text, self.votes = key, pages, text, votes
        self.kids: list[Slot] = kids if kids is not None else []

    def vote(self, text: int, n: int = 1) -> None:
        """Majority vote: after all votes, a text on more than half of the pages is ``text``."""
        if self.text == text:
            self.votes += n
        elif self.votes >= n:
            self.votes -= n
        else:
            self.text, self.votes = text, n - self.votes

    def pack(self) -> list:
        return [self.key, self.pages, self.text, self.votes, [k.pack() for k in self.kids]]

    @staticmethod
    def unpack(row: list) -> Slot:
        return Slot(row[0], row[1], row[2], row[3], [Slot.unpack(k) for k in row[4]])


def key_of(node: Node) -> str:
    return node.tag if not node.marks else f"{node.tag}.{'.'.join(node.marks)}"


def repeated(nodes: list[Node]) -> list[tuple[str, list[Node]]]:
    """Child elements of one slot's instances as (key, nodes): neighbours of one key are one; over
    several instances a key is one."""
    out: list[tuple[str, list[Node]]] = []
    if len(nodes) == 1:
        for kid in nodes[0].kids:
            if type(kid) is Node:
                key = key_of(kid)
                if out and out[-1][0] == key:
                    out[-1][1].append(kid)
                else:
                    out.append((key, [kid]))
        return out
    at: dict[str, int] = {}
    for node in nodes:
        for kid in node.kids:
            if type(kid) is Node:
                key = key_of(kid)
                if key in at:
                    out[at[key]][1].append(kid)
                else:
                    at[key] = len(out)
                    out.append((key, [kid]))
    return out


class Shape:
    """A page part as it is matched: key, child shapes, and the nodes it stands for."""

    __slots__ = ("key", "nodes", "kids")

    def __init__(self, key: str, nodes: list[Node]):
        self.key, self.nodes = key, nodes
        self.kids = [Shape(k, n) for k, n in repeated(nodes)]


def matching(a: list, b: list, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two child lists (slots or shapes): its size and the pairs."""
    m, n = len(a), len(b)
    if m == n and all(x.key == y.key for x, y in zip(a, b, strict=True)):
        return sum(_size(x, y, memo) for x, y in zip(a, b, strict=True)), [(i, i) for i in range(m)]
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m - 1, -1, -1):
        row, below, x = best[i], best[i + 1], a[i]
        for j in range(n - 1, -1, -1):
            top = below[j] if below[j] >= row[j + 1] else row[j + 1]
            if x.key == b[j].key:
                with_pair = below[j + 1] + _size(x, b[j], memo)
                top = max(top, with_pair)
            row[j] = top
    pairs, i, j = [], 0, 0
    while i < m and j < n:
        if a[i].key == b[j].key and best[i][j] == best[i + 1][j + 1] + _size(a[i], b[j], memo):
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return best[0][0], pairs


def _size(x, y, memo: dict) -> int:
    if not x.kids or not y.kids:
        return 1
    pair = (id(x), id(y))
    if pair not in memo:
        memo[pair] = 1 + matching(x.kids, y.kids, memo)[0]
    return memo[pair]


def fold(slot: Slot, other, memo: dict, added: list[int]) -> None:
    """Align ``other`` (a page's shape or another template's slot) with ``slot`` and add it.
    ``added`` counts the new slots."""
    if type(other) is Slot:
        slot.pages += other.pages
        if other.votes:
            slot.vote(other.text, other.votes)
    else:
        slot.pages += 1
        slot.vote(own_text(other.nodes))
    if not other.kids:
        return
    _, pairs = matching(slot.kids, other.kids, memo)
    of = {j: i for i, j in pairs}
    kids, done = [], 0
    for j, kid in enumerate(other.kids):
        if j in of:
            kids += slot.kids[done:of[j] + 1]
            done = of[j] + 1
            fold(kids[-1], kid, memo, added)
        else:
            added[0] += 1
            fresh = Slot(kid.key)
            fold(fresh, kid, memo, added)
            kids.append(fresh)
    slot.kids = kids + slot.kids[done:]


def own_text(nodes: list[Node]) -> int:
    """Hash of the slot's own text (all instances), without the text of child elements; 0 if none."""
    text = " ".join(" ".join([k for n in nodes for k in n.kids if type(k) is str]).split())
    return xxhash.xxh32_intdigest(text) if text else 0


def supports(root) -> list[int]:
    """The pages of every slot below ``root`` (1 for each of a page's shapes)."""
    out, stack = [], list(root.kids)
    while stack:
        node = stack.pop()
        out.append(node.pages if type(node) is Slot else 1)
        stack += node.kids
    return out


class Template:
    """The induced wrapper of one host.

    When it has more slots than its bound, those on the fewest pages go until half the bound is left,
    as in lossy counting: with ``s`` slots a page, a slot on more than ``2 * s / MAX_SLOTS`` of the
    pages seen so far stays (one page in a hundred of 100 slots each), and one that went is learnt
    anew when it comes again.
    """

    def __init__(self, root: Slot | None = None, widest: int = 0):
        self.root = root or Slot("#page")
        self._slots = [len(supports(self.root))]
        self._widest = widest

    def add_page(self, page: Node) -> None:
        shape = Shape("#page", [page])
        self._widest = max(self._widest, len(supports(shape)))
        fold(self.root, shape, {}, self._slots)
        self._prune()

    def add(self, other: Template) -> None:
        self._widest = max(self._widest, other._widest)
        fold(self.root, other.root, {}, self._slots)
        self._prune()

    def _prune(self) -> None:
        bound = max(MAX_SLOTS, 4 * self._widest)
        if self._slots[0] <= bound:
            return
        floor = sorted(supports(self.root), reverse=True)[bound // 2]
        stack = [self.root]
        while stack:  # no slot is on more pages than the one that holds it
            slot = stack.pop()
            slot.kids = [k for k in slot.kids if k.pages > floor]
            stack += slot.kids
        self._slots[0] = len(supports(self.root))

    def dumps(self) -> str:
        return json.dumps([self._widest, self.root.pack()], separators=(",", ":"))

    @staticmethod
    def loads(text: str) -> Template:
        widest, root = json.loads(text)
        return Template(Slot.unpack(root), widest)

    def main_text(self, page: Node) -> str:
        """The page's varying slots in page order, without template and furniture."""
        shape = Shape("#page", [page])
        self._place(self.root, shape, {})
        inside_only = _has_main(page)
        out: list[str] = []
        self._collect(page, out, False, inside_only, frozenset())
        text = " ".join("".join(out).split())
        if not text and (wrappers := mixed_wrappers(page)):
            self._collect(page, out := [], False, inside_only, wrappers)
            text = " ".join("".join(out).split())
        return text

    def _place(self, slot: Slot, shape: Shape, memo: dict) -> None:
        constant = slot.pages >= MIN_PAGES and slot.text and slot.votes >= MIN_VOTE * slot.pages
        if constant and own_text(shape.nodes) == slot.text:
            for node in shape.nodes:
                node.slot = slot
        if slot.kids and shape.kids:
            for i, j in matching(slot.kids, shape.kids, memo)[1]:
                self._place(slot.kids[i], shape.kids[j], memo)

    def _collect(self, node: Node, out: list[str], inside: bool, inside_only: bool, wrappers: frozenset[int]) -> None:
        inside = inside or is_main(node)
        if is_furniture(node.tag, node.marks, inside) and id(node) not in wrappers:
            return
        block = node.tag in BLOCK
        if block:
            out.append(" ")
        show = (inside or not inside_only) and node.slot is None
        for kid in node.kids:
            if type(kid) is Node:
                self._collect(kid, out, inside, inside_only, wrappers)
            elif show:
                out.append(kid)
        if block:
            out.append(" ")


def is_main(node) -> bool:
    return node.tag in ("article", "main") or not CONTENT_MARKS.isdisjoint(node.marks)


def mixed_wrappers(page: Node) -> frozenset[int]:
    """Elements (by identity) that hold at least half of the page's text and count as furniture only as a
    form around it or by a listed word beside others (``layout has-sidebar``, ``post tags-linux``). They are
    looked at where a page would have no text without them."""
    order, stack = [], [page]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in node.kids if type(k) is Node and (k.tag == "form" or k.tag not in FURNITURE_TAGS)]
    held: dict[int, int] = {}
    for node in reversed(order):
        held[id(node)] = sum(held.get(id(k), 0) if type(k) is Node else len("".join(k.split())) for k in node.kids)

    def mixed(node: Node) -> bool:
        if node.tag == "form":
            return True
        marks = [m for m in node.marks if not m.startswith("role=")]
        words = [w for m in marks for w in _WORD.findall(m)]
        return FURNITURE_ROLES.isdisjoint(node.marks) and not FURNITURE_WORDS.issuperset(words)

    return frozenset(id(n) for n in order if n is not page and 2 * held[id(n)] >= held[id(page)] > 0
                     and n.tag != "header" and is_furniture(n.tag, n.marks, True) and mixed(n))


def _has_main(page: Node) -> bool:
    stack = [page]
    while stack:
        node = stack.pop()
        if is_main(node) and not is_furniture(node.tag, node.marks, False):
            return True
        stack += [k for k in node.kids if type(k) is Node]
    return False


def host_of(url: Column) -> Column:
    """The host of a URL, lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")),
                                    r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, template): the wrapper of every host, learnt from all its pages."""
    rows = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("html"))

    def partial(batches):
        held: dict[str, Template] = {}
        for batch in batches:
            hosts = batch.column(0).to_pylist()
            for i, host in enumerate(hosts):
                if host not in held and len(held) >= MAX_HOSTS:
                    yield _templates(held)
                    held = {}
                held.setdefault(host, Template()).add_page(parse(batch.column(1)[i].as_py()))
        yield _templates(held)

    schema = "host string, template string"
    found = map_arrow(rows, partial, schema)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        first, *others = sorted(pdf["template"])
        out = Template.loads(first)
        for text in others:
            out.add(Template.loads(text))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "template": [out.dumps()]})

    width = max(2, int(rows.rdd.getNumPartitions() ** 0.5))
    found = found.withColumn("salt", F.pmod(F.xxhash64("template"), F.lit(width)))
    found = found.groupBy("host", "salt").applyInPandas(merged, schema)
    return found.groupBy("host").applyInPandas(merged, schema)


def _templates(held: dict[str, Template]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.string()), pa.array([t.dumps() for t in held.values()], pa.string())],
        names=["host", "template"])


def extract(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_col, url_col, text, n_chars) of every row: the page's main text, blocks joined by one
    space, and its length in code points.

    NULL, empty and textless pages give ''. Pages without a host share one template. Broken markup
    is read as far as it goes; repeated rows are each extracted; other columns are ignored.
    """
    templates = induce(pages, url_col, html_col).checkpoint()
    n_bytes = templates.agg(F.sum(F.octet_length("template"))).first()[0] or 0
    rows = pages.select(F.col(f"`{page_col}`").alias("page"), F.col(f"`{url_col}`").alias("url"),
                        F.col(f"`{html_col}`").alias("html"), host_of(F.col(f"`{url_col}`")).alias("host"))
    schema = (f"page {rows.schema['page'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, "
              "text string, n_chars long")
    if n_bytes <= MAX_BROADCAST_BYTES:
        known = pages.sparkSession.sparkContext.broadcast(dict(templates.toLocalIterator()))
        rows = rows.select("page", "url", "html", "host")
    else:
        known = None
        rows = rows.join(templates, "host").select("page", "url", "html", "host", "template")

    def run(batches):
        ready: dict[str, Template] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                texts = []
                for i, host in enumerate(batch.column(3).to_pylist()):
                    if host not in ready:
                        if len(ready) >= MAX_HOSTS:
                            ready.clear()
                        ready[host] = Template.loads(known.value[host] if known else batch.column(4)[i].as_py())
                    texts.append(ready[host].main_text(parse(batch.column(2)[i].as_py())))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["page", "url", "text", "n_chars"])

    return map_arrow(rows, run, schema).withColumnsRenamed({"page": page_col, "url": url_col})
