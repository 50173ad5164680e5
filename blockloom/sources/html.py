"""HTML files, by a tree without implied end tags: an end tag closes the nearest open element of its name."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from pathlib import PurePosixPath

from blockloom.sources.model import Item, Parsed, decoded, normalized

#: Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style nav header footer noscript".split())
TAKEN = frozenset("h1 h2 h3 h4 p li table img pre".split())


class Node:
    __slots__ = ("attrs", "name", "parent", "parts")

    def __init__(self, name: str, attrs: dict, parent: Node | None) -> None:
        self.name, self.attrs, self.parent, self.parts = name, attrs, parent, []

    def walk(self):
        """Elements below this one in document order; no recursion, so depth doesn't matter."""
        todo = [p for p in reversed(self.parts) if isinstance(p, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [p for p in reversed(node.parts) if isinstance(p, Node)]

    def text(self) -> str:
        """All strings below, each stripped, the empty ones left out, joined by a space."""
        out, todo = [], list(reversed(self.parts))
        while todo:
            part = todo.pop()
            if isinstance(part, Node):
                todo += reversed(part.parts)
            elif part.strip():
                out.append(part.strip())
        return " ".join(out)

    def inside(self, name: str) -> bool:
        node = self.parent
        while node is not None:
            if node.name == name:
                return True
            node = node.parent
        return False

    def locator(self) -> str:
        if self.attrs.get("id"):
            return f"{self.name}#{self.attrs['id']}"
        return ".".join([self.name, *(self.attrs.get("class") or "").split()])


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v for k, v in attrs}, self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.parts.append(Node(tag, {k: v for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def tree(text: str) -> Node:
    builder = _Builder()
    builder.feed(text)
    builder.close()
    todo = [builder.root]
    while todo:
        node = todo.pop()
        node.parts = [p for p in node.parts if not (isinstance(p, Node) and p.name in DROPPED)]
        todo += [p for p in node.parts if isinstance(p, Node)]
    return builder.root


def _size(value: str | None) -> float | None:
    try:
        return float(re.sub(r"px$", "", (value or "").strip()))
    except ValueError:
        return None


def parse(path: str, content: bytes) -> Parsed:
    """Headings, paragraphs, list items, code, tables and pictures of the article, main or body, in document order."""
    root = tree(decoded(content))
    first = {}
    for node in root.walk():
        first.setdefault(node.name, node)
    title = normalized(first["title"].text()) if "title" in first else PurePosixPath(path).stem
    top = first.get("article") or first.get("main") or first.get("body") or root
    items: list[Item] = []
    for index, node in enumerate(n for n in top.walk() if n.name in TAKEN):
        made = {"raw_index": index, "locator": node.locator()}
        if node.name != "table" and node.inside("table"):
            continue
        if node.name == "table":
            rows = [[c.text() for c in tr.walk() if c.name in ("th", "td")] for tr in node.walk() if tr.name == "tr"]
            if any(normalized(c) for row in rows for c in row):
                items.append(Item("html_tbl", "table", rows=rows, raw_type="html_table", **made))
        elif node.name == "img":
            alt, src = normalized(node.attrs.get("alt")), node.attrs.get("src")
            image = {"caption": alt, "image_path": src, "width": _size(node.attrs.get("width")), "height": _size(node.attrs.get("height"))}
            items.append(Item("html_img", "image", alt or None, image=image, code="HTML_CONTENT_IMAGE" if src else None, raw_type="html_image", **made))
        elif text := normalized(node.text()):
            kind = {"li": "list_item", "pre": "code", "p": "paragraph"}.get(node.name, "heading")
            items.append(Item("html_txt", kind, text, int(node.name[1]) if kind == "heading" else None, raw_type="html_element", **made))
    return Parsed(title, items, raw_counts(top))


def raw_counts(top: Node) -> dict:
    """What the part that is read holds, before any of it is taken."""
    names = [n.name for n in top.walk() if n is not top]
    kinds = {"heading": ("h1", "h2", "h3", "h4"), "paragraph": ("p",), "table": ("table",), "image": ("img",)}
    return {"root_tag": top.name} | {f"raw_{k}_count": sum(n in of for n in names) for k, of in kinds.items()}
