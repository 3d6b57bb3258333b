"""Pages of HTML as Markdown: a small tree, rules of what isn't content, and converters by name."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markdown import deduplicated_blocks

# Tags, words in ids, classes, roles and labels, and whole ids or classes that aren't content; where content is.
SKIPPED_TAGS = frozenset("script style noscript iframe svg canvas form button input select textarea nav footer aside figure".split())
SKIPPED_WORDS = (
    "cookie", "banner", "advert", "ads", "subscribe", "newsletter", "popup", "modal", "breadcrumb", "social", "share", "sidebar", "related", "recommend", "comment",
    "menu", "navigation", "footer", "mw-editsection", "mw-jump-link", "printfooter", "catlinks", "noprint", "metadata", "sisterproject", "navbox", "ambox", "hatnote",
)
SKIPPED_NAMES = frozenset(("toc", "siteSub", "contentSub", "jump-to-nav"))
VISUAL_CLASSES = frozenset(("thumb", "image", "gallery", "mw-default-size", "mw-kartographer-map", "mapframe", "locmap", "infobox", "metadata", "noprint"))
TABLE_CLASSES = ("infobox", "metadata", "ambox", "navbox", "climate", "wikitable")
TABLE_TEXTS = ("climate chart", "imperial conversion", "average max. and min. temperatures")
CONTENT_IDS = ("mw-content-text",)
CONTENT_TAGS = ("main", "article")
CONTENT_NEXT = (("id", "content"), ("id", "main"), ("class", "content"), ("class", "main-content"), ("class", "article-content"), ("class", "post-content"), ("class", "entry-content"))
CONTENT_WORDS = (("id", re.compile("content|main|article|body", re.IGNORECASE)), ("class", re.compile("content|main|article|body|post|entry", re.IGNORECASE)))

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BREAKS = frozenset("p div section article main ul ol table tr blockquote header dl dt dd pre".split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def nodes(self) -> Iterator[Node]:
        """All below, in order, without recursion: pages can be nested very deep."""
        todo = [self]
        while todo:
            node = todo.pop()
            if node is not self:
                yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                todo += reversed(node.children)
        return " ".join(" ".join(out).split())

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def tree_of(page: str) -> Node:
    parser = _Tree()
    parser.feed(page)
    parser.close()
    return parser.root


def is_content(node: Node) -> bool:
    if node.tag in SKIPPED_TAGS or not VISUAL_CLASSES.isdisjoint(node.classes()):
        return False
    names = {node.attrs.get("id", ""), *node.classes()}
    if not SKIPPED_NAMES.isdisjoint(names):
        return False
    told = " ".join(node.attrs.get(k, "") for k in ("id", "class", "role", "aria-label")).lower()
    if told.strip() and any(w in told for w in SKIPPED_WORDS):
        return False
    if node.tag != "table":
        return True
    return not any(w in node.attrs.get("class", "").lower() for w in TABLE_CLASSES) and not any(w in node.text().lower() for w in TABLE_TEXTS)


def pruned(root: Node) -> Node:
    """The tree without what isn't content; in place."""
    todo = [root]
    while todo:
        node = todo.pop()
        node.children = [c for c in node.children if isinstance(c, str) or is_content(c)]
        todo += [c for c in node.children if isinstance(c, Node)]
    return root


def main_content(root: Node) -> Node:
    """Where a page's content is: the first rule that finds a node decides."""
    nodes = list(root.nodes())
    rules: list[Callable[[Node], bool]] = [lambda n, v=v: n.attrs.get("id") == v for v in CONTENT_IDS]
    rules += [lambda n, v=v: n.tag == v for v in CONTENT_TAGS] + [lambda n: n.attrs.get("role") == "main"]
    rules += [lambda n, k=k, v=v: n.attrs.get("id") == v if k == "id" else v in n.classes() for k, v in CONTENT_NEXT]
    rules += [lambda n, k=k, p=p: bool(p.search(n.attrs.get(k, ""))) for k, p in CONTENT_WORDS] + [lambda n: n.tag == "body"]
    for rule in rules:
        found = next((n for n in nodes if rule(n)), None)
        if found is not None:
            return found
    return root


def rendered(root: Node, base: str) -> str:
    """Markdown of a tree: headings, paragraphs, list items, absolute links and emphasis."""
    out: list[str] = []
    todo: list[Node | str | tuple[str]] = [root]
    while todo:
        item = todo.pop()
        if isinstance(item, tuple):
            out.append(item[0])
        elif isinstance(item, str):
            out.append(re.sub(r"\s+", " ", item))
        else:
            tag = item.tag
            before, after = "", ""
            if re.fullmatch("h[1-6]", tag):
                before, after = "\n\n" + "#" * int(tag[1]) + " ", "\n\n"
            elif tag == "li":
                before, after = "\n- ", "\n"
            elif tag == "br":
                before = "\n"
            elif tag in ("strong", "b"):
                before = after = "**"
            elif tag == "a" and item.attrs.get("href"):
                before, after = "[", f"]({urljoin(base, item.attrs['href'])})"
            elif tag in _BREAKS:
                before = after = "\n\n"
            todo += [(after,), *reversed(item.children), (before,)]
    lines = [" ".join(x.split()) for x in "".join(out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def by_rules(page: str, base: str) -> str:
    return rendered(main_content(pruned(tree_of(page))), base)


def whole_body(page: str, base: str) -> str:
    root = tree_of(page)
    for node in [root, *root.nodes()]:
        node.children = [c for c in node.children if isinstance(c, str) or c.tag not in ("script", "style", "head")]
    return rendered(root, base)


def longest_paragraphs(page: str, base: str) -> str:
    """Paragraphs of eighty characters and more, of which links are under a third."""
    kept = []
    for p in (n for n in pruned(tree_of(page)).nodes() if n.tag == "p"):
        text, linked = p.text(), sum(len(a.text()) for a in p.nodes() if a.tag == "a")
        if len(text) >= 80 and 3 * linked < len(text):
            kept.append(rendered(p, base))
    return "\n\n".join(kept)


#: Converters by name; others can be added. Each maps a page and its address to Markdown.
CONVERTERS: dict[str, Callable[[str, str], str]] = {"rules": by_rules, "body": whole_body, "paragraphs": longest_paragraphs}


def pages_to_markdown(pages: DataFrame, key: str, source: str, url: str | None = None, converter: str | Callable[[str, str], str] = "rules") -> DataFrame:
    """(key, markdown): pages by a converter, batch by batch, each block once. A null page is empty."""
    convert = CONVERTERS[converter] if isinstance(converter, str) else converter
    rows = pages.select(key, F.col(source).alias("page"), (F.col(url) if url else F.lit("")).alias("base"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "markdown": [convert(p or "", b or "") for p, b in zip(f["page"], f["base"], strict=True)]})

    made = rows.mapInPandas(work, f"`{key}` {pages.schema[key].dataType.simpleString()}, markdown string")
    return made.withColumn("markdown", deduplicated_blocks(F.col("markdown")))
