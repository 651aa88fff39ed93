"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Every paragraph gives points for its length and its commas
to its ancestors, most to the nearest, and a container's points are discounted by the share
of its text that stands in links. The best container is kept, together with the siblings that
score alike or read like its paragraphs, without menus, headers, footers, sidebars, notices,
adverts, forms, comments and the like, which are known by their tag, role or class. Where a
page marks its article, the best container inside the mark grows to the whole of it.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from chartspan.llm.common import by_value, text_batches

by_value(__name__)

# Element names of the HTML standard by role here.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
        "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog",
          "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
          "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p",
          "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
DROPPED = {"head", "script", "style", "noscript", "template", "iframe", "object", "embed", "svg", "canvas",
           "math", "form", "button", "select", "option", "textarea", "input", "label", "fieldset", "nav",
           "menu", "header", "footer", "aside", "dialog", "audio", "video", "title", "xmp", "noembed", "noframes"}
PARAGRAPHS = {"p", "pre", "td", "th", "blockquote", "li", "dd", "figcaption"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MARKED = {"article", "main"}
#: Open elements that a new one of the first name closes.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
SCOPES = {"ul", "ol", "dl", "table", "select"}
SIDE_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb",
              "breadcrumbs", "comment", "comments", "commentlist", "cookie", "cookies", "consent", "disqus",
              "footer", "gdpr", "header", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation",
              "newsletter", "notice", "notices", "notification", "pager", "pagination", "popup", "promo",
              "promotion", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "social",
              "sponsor", "sponsored", "subscribe", "toolbar", "widget", "widgets"}
#: Of these, the ones that also tell on an element marked as an article, and those that stand for a title in one.
ARTICLE_SIDE_WORDS = {"ad", "ads", "advert", "comment", "comments", "promo", "related", "replies", "reply",
                      "sponsored"}
TITLE_WORDS = {"header", "masthead"}
SIDE_ROLES = {"navigation", "complementary", "banner", "contentinfo", "search", "alert", "dialog", "menu",
              "menubar", "toolbar", "form"}

# A tag up to its end, without "<" inside so that a failure costs no more than the way to the next one.
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/><]*)([^<>\"']*(?:(?:\"[^\"<>]*\"|'[^'<>]*')[^<>\"']*)*+)>")
_START = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_PART = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element; ``items`` holds child elements and decoded strings in page order."""

    __slots__ = ("tag", "parent", "items", "score", "drop", "marked", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.items, self.score = tag, parent, [], 0.0
        self.marked = parent is not None and (parent.marked or parent.tag in MARKED)
        self.drop = parent is not None and _aside(tag, attributes, self.marked)
        self.chars = self.linked = 0


def _aside(tag: str, attributes: str, marked: bool) -> bool:
    """Whether an element is none of the article, by its tag, role, class or id."""
    if tag in DROPPED:
        return not (tag == "header" and marked)
    if tag in ("html", "body", "main") or not attributes.strip():
        return False
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return True
    if found.get("role", "").lower() in SIDE_ROLES:
        return True
    names = {p.lower() for p in _PART.split(found.get("class", "") + " " + found.get("id", ""))} & SIDE_WORDS
    if tag == "article":
        return bool(names & ARTICLE_SIDE_WORDS)
    return bool(names - TITLE_WORDS if marked else names)


def parse(page: str) -> Node:
    """Tree of a page. Unclosed elements end where their parent does or the standard says so."""
    root = Node("#root", None)
    now, at, end = root, 0, len(page)
    open_tags: Counter = Counter()

    def up_to(node: Node) -> Node:
        """Close what is open below ``node``."""
        x = now
        while x is not node:
            open_tags[x.tag] -= 1
            x = x.parent
        return node

    last = {c: page.rfind(c) for c in ">\"'"}
    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        if start > at:
            now.items.append(html.unescape(page[at:start]))
        if start == end:
            break
        found = _TAG.match(page, start)
        if found:
            at, slash, name, attributes = found.end(), *found.groups()
        else:
            at, slash, name, attributes = _odd_tag(page, start, last)
            if not name:
                if at == start + 1:
                    now.items.append("<")
                continue
        tag = name.lower()
        if slash:
            if open_tags[tag] > 0:
                now = up_to(_closed(now, tag))
            continue
        now = up_to(_place(now, tag, open_tags))
        node = Node(tag, now, attributes)
        now.items.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
        elif tag not in VOID and not (attributes.endswith("/") and tag not in BLOCKS):
            now = node
            open_tags[tag] += 1
    _measure(root)
    return root


def _odd_tag(page: str, start: int, last: dict[str, int]) -> tuple[int, str, str, str]:
    """End, slash, name and attributes of what starts with ``<`` but is no plain tag.

    Comments and declarations have no name, a lone ``<`` is one character of text, and a tag
    that never ends takes the rest of the page. ``last`` has the last place of the characters
    that matter, so that nothing is looked for in vain.
    """
    if page.startswith("<!--", start):
        stop = page.find("-->", start + 4)
        return (len(page) if stop < 0 else stop + 3), "", "", ""
    head = _START.match(page, start)
    if head is None:
        if page[start + 1:start + 2] in ("!", "?", "/"):
            return (page.find(">", start) + 1 if start < last[">"] else len(page)), "", "", ""
        return start + 1, "", "", ""
    at = head.end()
    while at <= last[">"]:
        stop = _STOP.search(page, at)
        if stop[0] == ">":
            return stop.end(), head[1], head[2], page[head.end():stop.start()]
        close = page.find(stop[0], stop.end()) if stop.end() <= last[stop[0]] else -1
        at = stop.end() if close < 0 else close + 1
    return len(page), "", "", ""


def _closed(now: Node, tag: str) -> Node:
    """Parent of the nearest open ``tag``; the end of an inline element ends no article."""
    node = now
    while node.tag != tag:
        if node.tag in ("article", "main", "body") and tag not in BLOCKS:
            return now
        node = node.parent
    return node.parent


def _place(now: Node, tag: str, open_tags: Counter) -> Node:
    """Where a new element goes: a block ends an open paragraph, items end their like."""
    if tag in BLOCKS and (open_tags["p"] > 0 or tag in HEADINGS):
        node = now
        while node.parent is not None and node.tag not in BLOCKS:
            node = node.parent
        if node.tag == "p" or (node.tag in HEADINGS and tag in HEADINGS):
            now = node.parent
    if any(open_tags[t] > 0 for t in CLOSES.get(tag, ())):
        node = now
        while node.parent is not None and node.tag not in SCOPES:
            if node.tag in CLOSES[tag]:
                return node.parent
            node = node.parent
    return now


def _measure(root: Node) -> None:
    """Characters, and those in links, of every element that is not dropped."""
    order, todo = [], [(root, False)]
    while todo:
        node, in_link = todo.pop()
        in_link = in_link or node.tag == "a"
        order.append(node)
        for i in node.items:
            if isinstance(i, str):
                node.chars += len(i.strip())
            elif not i.drop:
                todo.append((i, in_link))
        node.linked = node.chars if in_link else 0
    for node in reversed(order):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked


def _text(node: Node) -> str:
    """Text of a subtree without dropped elements, one space for each white space run."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.drop or x is node:
            if x.tag in BLOCKS or x.tag == "br":
                out.append(" ")
            todo.extend(reversed(x.items))
    return _SPACE.sub(" ", "".join(out)).strip()


def _link_share(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _walk(root: Node):
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(i for i in reversed(node.items) if isinstance(i, Node) and not i.drop)


def _joined(parts) -> tuple[int, int, bool, bool]:
    """Length, commas, and white space before and after, of parts written one after the other.

    The length is that of the stripped text with one space for each run of white space.
    """
    n, commas, before, after = 0, 0, False, False
    for m, c, left, right in parts:
        if not n:
            n, commas, before, after = m, c, before or left, right if m else before or left
        elif m:
            n, commas, after = n + m + (after or left), commas + c, right
        else:
            after = after or left
    return n, commas, before, after


def _sizes(root: Node) -> dict[int, tuple[int, int, bool, bool]]:
    """``_joined`` of the text of every element that is not dropped, children before parents."""
    of: dict[int, tuple[int, int, bool, bool]] = {}
    for node in reversed(list(_walk(root))):
        parts = [(0, 0, True, True)] if node.tag in BLOCKS or node.tag == "br" else []
        for i in node.items:
            if isinstance(i, str):
                text = _SPACE.sub(" ", i)
                plain = text.strip()
                parts.append((len(plain), plain.count(","), text[:1].isspace(), text[-1:].isspace()))
            elif not i.drop:
                parts.append(of[id(i)])
        of[id(node)] = _joined(parts)
    return of


def _own_blocks(node: Node) -> bool:
    return any(isinstance(i, Node) and i.tag in BLOCKS for i in node.items)


def kept_parts(root: Node) -> list[Node]:
    """The best container with the siblings that belong to it, in page order."""
    candidates: dict[int, Node] = {}
    sizes = _sizes(root)
    for node in _walk(root):
        loose = node.tag in ("div", "section", "article", "main", "body") and any(
            isinstance(i, str) and i.strip() for i in node.items)
        if node.tag not in PARAGRAPHS and not loose:
            continue
        if node.tag in PARAGRAPHS and not _own_blocks(node):
            n, commas = sizes[id(node)][:2]
        else:
            text = _SPACE.sub(" ", " ".join(i if isinstance(i, str) else "" for i in node.items)).strip()
            n, commas = len(text), text.count(",")
        if not n:
            continue
        points = (1 if n >= 25 else 0.2) + commas + min(n / 100, 3)
        above, share = (node if loose else node.parent), 1.0
        for divisor in (1, 2, 6, 9, 12):
            if above is None:
                break
            above.score += points * share / divisor
            candidates[id(above)] = above
            above = above.parent
    if not candidates:
        return [root]
    scored = {k: n.score * (1 - _link_share(n)) for k, n in candidates.items() if n.tag != "#root" or len(candidates) == 1}
    best = candidates[max(scored, key=scored.get)]
    mark = best
    while mark is not None and mark.tag not in MARKED:
        mark = mark.parent
    if mark is not None:
        outer = mark.parent
        while outer is not None:  # an article around the article
            if outer.tag == "article":
                mark = outer
            outer = outer.parent
        best = mark
    if best.parent is None:
        return [best]
    floor = max(2.0, 0.2 * scored.get(id(best), 0.0))
    kept = []
    for item in best.parent.items:
        if not isinstance(item, Node) or item.drop:
            continue
        if item is best or scored.get(id(item), 0.0) >= floor:
            kept.append(item)
        elif item.tag == "p":
            text = _text(item)
            share = _link_share(item)
            if (len(text) > 80 and share < 0.25) or (text and share == 0 and re.search(r"[.!?](\s|$)", text)):
                kept.append(item)
        elif item.tag in HEADINGS and best.tag not in MARKED:
            kept.append(item)
    return kept


def blocks(parts: list[Node]) -> list[str]:
    """Texts of the blocks of some subtrees: white space runs are one space, empty blocks go."""
    out, run = [], []

    def flush():
        text = _SPACE.sub(" ", "".join(run)).strip()
        if text:
            out.append(text)
        run.clear()

    for part in parts:
        todo: list = [part]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                run.append(x)
            elif x.tag == "br":
                run.append(" ")
            elif not x.drop or x is part:
                if x.tag in BLOCKS:
                    flush()
                    todo.append(None)
                todo.extend(reversed(x.items))
        flush()
    return out


def main_text(page: str | None) -> str:
    """Main text of one page; empty for null, empty and textless pages."""
    return "\n".join(blocks(kept_parts(parse(page)))) if page else ""


def extract(page: Column) -> Column:
    """Main text of a column of whole pages."""

    text_batches()

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return text(page)
