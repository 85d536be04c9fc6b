"""The elements of a page that hold its content, in tree order, from a tree built with a stack."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

# Elements without an end, without content of their own, and those that are looked into.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("script style noscript template head".split())
CONTAINERS = frozenset("div section article main span".split())
INLINE = frozenset("span a b i em strong u small sub sup code".split())
#: What an opening tag ends if it is still open: list items, cells and rows end each other, blocks end a paragraph.
ENDS = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
ENDS |= dict.fromkeys("p div section article main ul ol table blockquote pre h1 h2 h3 h4 h5 h6 figure form header footer nav aside hr dl".split(), {"p"})
#: What an implied end doesn't reach beyond.
WALLS = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "dt": {"dl"}, "dd": {"dl"}}


class Node:
    __slots__ = ("tag", "attrs", "inside")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.inside = tag, attrs, []

    def children(self) -> list[Node]:
        return [x for x in self.inside if isinstance(x, Node)]

    def walk(self) -> Iterator[Node | str]:
        """Elements and texts below, in order; no recursion, so a page may be nested as deep as it likes."""
        todo = self.inside[::-1]
        while todo:
            x = todo.pop()
            yield x
            if isinstance(x, Node):
                todo += x.inside[::-1]

    def text(self) -> str:
        return "".join(x for x in self.walk() if isinstance(x, str))

    def first(self, holds) -> Node | None:
        return next((x for x in self.walk() if isinstance(x, Node) and holds(x)), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open, self.hidden = [self.root], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in UNSEEN:
            self.hidden += 1
        if self.hidden:
            return
        ends, walls = ENDS.get(tag, ()), WALLS.get(tag, ())
        cut = len(self.open)
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in ends:
                cut = k
            elif self.open[k].tag in walls or (not walls and self.open[k].tag not in INLINE):
                break
        del self.open[cut:]
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].inside.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if tag in UNSEEN and self.hidden:
            self.hidden -= 1
        elif not self.hidden:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == tag:
                    del self.open[k:]
                    return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.open[-1].inside.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def content_root(root: Node) -> Node:
    """The wrapper that a reader or a site puts round the content, the most specific first, else the body, else all."""
    marks = (("id", "readability-page-1"), ("data-journey-hook", "client-content"), ("data-testid", "BodyWrapper"))
    for name, value in marks:
        if (found := root.first(lambda x: x.attrs.get(name) == value)) is not None:  # noqa: B023
            return found
    return root.first(lambda x: x.tag == "body") or root.first(lambda x: x.tag == "html") or root


def elements(html: str | None) -> list[tuple[str, str, str]]:
    """(tag, text, caption) of the content's elements in tree order, white space collapsed.

    Containers are looked into, and give the longer texts that stand directly in them as ``#direct`` after what is in them.  A
    figure has its alternative text and caption as caption, a table its own.  Last comes ``#all``, the whole text as it is.
    """
    flat = lambda s: re.sub(r"\s+", " ", s).strip()
    root, out = content_root(tree(html or "")), []
    todo: list[Node | tuple[str, str, str]] = root.children()[::-1]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            out.append(x)
        elif x.tag in CONTAINERS and x.children():
            direct = " ".join(t for t in (s.strip() for s in x.inside if isinstance(s, str)) if len(t) > 50)
            todo += ([("#direct", direct, "")] if direct else []) + x.children()[::-1]
        elif x.tag in ("figure", "img"):
            alt = x.attrs.get("alt") or x.attrs.get("title") or "Image"
            out.append((x.tag, flat(x.text()), alt))
            if (c := x.first(lambda n: n.tag == "figcaption")) is not None and c.text().strip():
                out.append(("figcaption", c.text().strip(), ""))
        elif x.tag == "table":
            c = x.first(lambda n: n.tag == "caption")
            out.append(("table", flat(x.text()), (c.text().strip() if c else "") or x.attrs.get("title") or "Table"))
        else:
            out.append((x.tag, flat(x.text()), ""))
    return [*out, ("#all", root.text().strip(), "")]
