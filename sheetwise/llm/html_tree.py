"""A small HTML tree: tags, classes and text in page order, built tolerantly."""

from __future__ import annotations

import re
from html import unescape

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>?""")
_ATTRIBUTE = re.compile(r"""([^\s=/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|$)", re.IGNORECASE)
            for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section select summary table tbody td textarea tfoot th thead title tr ul".split())
#: A start tag (key) ends these open elements, as far up as the nearest of the stoppers.
_CLOSES = {
    **dict.fromkeys("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
                    "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split(), ("p",)),
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"), "body": ("head",)}
_STOPPERS = frozenset("ul ol dl table select button body html article aside section nav main div td th".split())
#: Elements nested deeper than this become part of the one that holds them.
MAX_DEPTH = 120


class Node:
    """An element: ``tag``, ``marks`` (class, id and role words; ``hidden``), ``kids`` (nodes and text)."""

    __slots__ = ("tag", "marks", "kids", "slot")

    def __init__(self, tag: str, marks: tuple[str, ...] = ()):
        self.tag, self.marks, self.kids, self.slot = tag, marks, [], None


def _marks(source: str) -> tuple[str, ...]:
    if not source or source.isspace():
        return ()
    out = []
    for name, value in _ATTRIBUTE.findall(source):
        name = name.lower()
        value = value.strip("\"'").lower()
        if name in ("class", "id"):
            out += value.split()
        elif name == "role":
            out.append("role=" + value)
        elif name == "hidden" or name == "aria-hidden" and value == "true" \
                or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            out.append("hidden")
    return tuple(out)


def parse(html: str | None) -> Node:
    """The tree of a page. Comments and declarations are left out; script-like elements hold their
    source as one text; character references in text are decoded."""
    root = Node("#page")
    stack, flat = [root], {}
    at, n = 0, len(html or "")
    while at < n:
        open_at = html.find("<", at)
        if open_at < 0:
            stack[-1].kids.append(unescape(html[at:]))
            break
        if open_at > at:
            stack[-1].kids.append(unescape(html[at:open_at]))
        if html.startswith("<!--", open_at):
            end = html.find("-->", open_at + 4)
            at = n if end < 0 else end + 3
            continue
        tag = _TAG.match(html, open_at)
        if tag is None:
            if html.startswith(("<!", "<?", "</"), open_at):
                end = html.find(">", open_at)
                at = n if end < 0 else end + 1
            else:
                stack[-1].kids.append("<")
                at = open_at + 1
            continue
        at = tag.end()
        name = tag[2].lower()
        if tag[1]:
            if flat.get(name):
                flat[name] -= 1
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
            continue
        closes = _CLOSES.get(name)
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    del stack[k:]
                    break
                if stack[k].tag in _STOPPERS:
                    break
        node = Node(name, _marks(tag[3]))
        if len(stack) >= MAX_DEPTH and name not in VOID and name not in _RAW_END:
            flat[name] = flat.get(name, 0) + 1
            if name in BLOCK:
                stack[-1].kids.append(" ")
            continue
        stack[-1].kids.append(node)
        if name in _RAW_END:
            end = _RAW_END[name].search(html, at)
            source = html[at:end.start() if end else n]
            node.kids.append(unescape(source) if name in ("title", "textarea") else source)
            at = n if end is None else (html.find(">", end.end()) + 1 or n)
        elif name not in VOID and not tag[3].endswith("/"):
            stack.append(node)
    return root
