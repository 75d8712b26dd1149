"""A small tolerant HTML tree on the standard library's parser: parse, walk, change, write."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

# Elements of HTML that have no content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    """An element with its children; text is a child that is a str. The root's name is empty."""

    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name: str = "", attrs: dict[str, str | None] | None = None):
        self.name, self.attrs = name, attrs or {}
        self.children: list[Node | str] = []
        self.parent: Node | None = None

    def append(self, child: Node | str) -> None:
        if isinstance(child, Node):
            child.parent = self
        self.children.append(child)

    def elements(self) -> Iterator[Node]:
        """All elements below, in document order. The tree may change between steps below the current one only."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find(self, *names: str) -> Node | None:
        return next((n for n in self.elements() if n.name in names), None)

    def find_all(self, *names: str) -> list[Node]:
        return [n for n in self.elements() if n.name in names]

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def inside(self, name: str) -> bool:
        return any(a.name == name for a in self.ancestors())

    def texts(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, Node):
                yield from c.texts()
            else:
                yield c

    def text(self) -> str:
        """Text below, every piece trimmed, empty ones left out."""
        return "".join(t for t in map(str.strip, self.texts()) if t)

    def index(self) -> int:
        return next(i for i, c in enumerate(self.parent.children) if c is self)

    def attached(self) -> bool:
        return self.parent is not None

    def remove(self) -> None:
        if self.parent is not None:
            del self.parent.children[self.index()]
            self.parent = None

    def replace(self, *others: Node | str) -> None:
        """Puts others in the place of this node."""
        parent, at = self.parent, self.index()
        for o in others:
            if isinstance(o, Node):
                o.parent = parent
        parent.children[at : at + 1] = others
        self.parent = None

    def unwrap(self) -> None:
        """Puts the children in the place of this node."""
        self.replace(*self.children)

    def as_element(self, name: str) -> Node:
        """A bare element of another name with this one's children."""
        other = Node(name)
        for child in self.children:
            other.append(child)
        return other

    def __str__(self) -> str:
        return write(self)


class Builder(HTMLParser):
    """Builds the tree; end tags close the innermost open element of their name, stray ones are dropped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node()
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(reversed(attrs)))
        self.open[-1].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].append(Node(tag, dict(reversed(attrs))))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].append(data)

    def handle_comment(self, data):
        self.open[-1].append(Node("!--", {"": data}))

    def handle_decl(self, decl):
        self.open[-1].append(Node("!", {"": decl}))

    def handle_pi(self, data):
        self.open[-1].append(Node("?", {"": data}))


RAW = ("script", "style")


def write(node: Node | str) -> str:
    """HTML of a node."""
    out: list[str] = []
    stack: list[Node | str | tuple[str]] = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, tuple):
            out.append(n[0])
        elif isinstance(n, str):
            out.append(escape(n, quote=False))
        elif n.name == "!--":
            out.append(f"<!--{n.attrs['']}-->")
        elif n.name in ("!", "?"):
            out.append(f"<{n.name}{n.attrs['']}>")
        else:
            if n.name:
                attrs = "".join(f' {k}="{escape(v or "", quote=True)}"' for k, v in reversed(n.attrs.items()))
                out.append(f"<{n.name}{attrs}>")
                if n.name in VOID:
                    continue
                stack.append((f"</{n.name}>",))
            stack.extend((c,) if isinstance(c, str) and n.name in RAW else c for c in reversed(n.children))
    return "".join(out)


def parse(html: str) -> Node:
    builder = Builder()
    builder.feed(html)
    builder.close()
    return builder.root
