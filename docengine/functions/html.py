"""HTML in Python workers: page to nodes, and chosen nodes to Markdown.

These two helpers work on one page at a time over Arrow batches. A page's nodes
come back as one array in document order, text nodes included. Every node holds
the id of the last node of its subtree, so "inside" is a range test and a
subtree is a slice; the selecting and shaping all happens in Spark.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from itertools import accumulate
from operator import attrgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.functions.folding import ascii_text, compat_fold
from docengine.functions.parts import part_udf
from docengine.functions.text import WS_CHARS

# Elements without content, elements whose text is not shown.
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
HIDDEN = frozenset(["script", "style", "template"])

# sib_idx and tag_ord count element siblings (from 0) and those of the same tag
# (from 1); child_ord also counts text and comments.
_INTS = ["node_id", "last_id", "parent_id", "prev_id", "next_id", "sib_idx", "tag_ord", "child_ord", "depth"]
NODE = T.StructType(
    [T.StructField(name, T.IntegerType()) for name in _INTS]
    + [
        T.StructField("tag", T.StringType()),
        T.StructField("dom_id", T.StringType()),
        T.StructField("classes", T.ArrayType(T.StringType())),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("data", T.StringType()),
    ]
)
PAGE = T.StructType([T.StructField("nodes", T.ArrayType(NODE)), T.StructField("error", T.StringType())])


class Node:
    __slots__ = (*_INTS, "tag", "attrs", "data", "children", "elements", "last_element", "tags")

    def __init__(self, node_id: int, parent: "Node | None", order: int, tag: str, attrs=None, data=None) -> None:
        self.node_id = self.last_id = node_id
        self.parent_id = parent.node_id if parent else -1
        self.depth = parent.depth + 1 if parent else 0
        self.prev_id = self.next_id = self.sib_idx = self.tag_ord = self.last_element = -1
        self.child_ord = order
        self.tag, self.attrs, self.data = tag, attrs, data
        self.children = self.elements = 0
        self.tags: dict[str, int] = {}


class PageTree(HTMLParser):
    """Lenient tree: void elements never nest, an end tag closes the nearest open
    element of that name and all inside it, nothing else closes an element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self._open: list[Node] = [Node(-1, None, 0, "#page")]
        self._open[0].depth = -1
        self._names: dict[str, int] = {}
        self._text: list[str] = []

    def _child(self, tag: str, attrs=None, data=None) -> Node:
        parent = self._open[-1]
        node = Node(len(self.nodes), parent, parent.children, tag, attrs, data)
        parent.children += 1
        self.nodes.append(node)
        return node

    def _flush(self) -> None:
        if self._text:
            tag = "#data" if self._open[-1].tag in HIDDEN else "#text"
            self._child(tag, data="".join(self._text))
            self._text.clear()

    def handle_data(self, data: str) -> None:
        self._text.append(data)

    def _skip(self, _data: str) -> None:
        self._flush()
        self._open[-1].children += 1

    handle_comment = handle_decl = handle_pi = unknown_decl = _skip

    def handle_starttag(self, tag: str, attrs) -> None:
        self._flush()
        parent = self._open[-1]
        node = self._child(tag, {k: v or "" for k, v in attrs})
        node.sib_idx = parent.elements
        parent.elements += 1
        node.tag_ord = parent.tags[tag] = parent.tags.get(tag, 0) + 1
        if parent.last_element >= 0:
            node.prev_id = parent.last_element
            self.nodes[parent.last_element].next_id = node.node_id
        parent.last_element = node.node_id
        if tag not in VOID:
            self._open.append(node)
            self._names[tag] = self._names.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close()

    def _close(self) -> Node:
        node = self._open.pop()
        node.last_id = len(self.nodes) - 1
        self._names[node.tag] -= 1
        return node

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if self._names.get(tag):
            while self._close().tag != tag:
                pass

    def finish(self) -> list[Node]:
        self._flush()
        while len(self._open) > 1:
            self._close()
        self._own_texts()
        return self.nodes

    def _own_texts(self) -> None:
        """An element's data is its own visible text: its text nodes, each stripped."""
        own: dict[int, list[str]] = {}
        for node in self.nodes:
            if node.tag == "#text" and node.parent_id >= 0:
                own.setdefault(node.parent_id, []).append(node.data.strip(WS_CHARS))
        for node_id, parts in own.items():
            self.nodes[node_id].data = "".join(parts)


def parse_page(html: str) -> tuple[list[Node], str | None]:
    """Nodes of one page; on a parser failure, those read so far and the reason."""
    tree, error = PageTree(), None
    try:
        tree.feed(html)
        tree.close()
    except Exception as exc:  # one bad page must not fail the job
        error = f"{type(exc).__name__}: {exc}"
    return tree.finish(), error


def _list_of(offsets: list[int], values: pa.Array, empty: list[bool] | None = None) -> pa.Array:
    mask = pa.array(empty, pa.bool_()) if empty else None
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=mask)


def _node_columns(nodes: list[Node]) -> list[pa.Array]:
    """The columns of ``NODE`` for the nodes of many pages, one after another."""
    columns = [pa.array(list(map(attrgetter(name), nodes)), pa.int32()) for name in _INTS]
    attrs = [n.attrs or {} for n in nodes]
    classes = [a["class"].split() if "class" in a else () for a in attrs]
    keys, values = [k for a in attrs for k in a], [v for a in attrs for v in a.values()]
    return columns + [
        pa.array([n.tag for n in nodes], pa.string()),
        pa.array([a.get("id") for a in attrs], pa.string()),
        _list_of([0, *accumulate(map(len, classes))], pa.array([c for own in classes for c in own], pa.string())),
        pa.MapArray.from_arrays(
            pa.array([0, *accumulate(map(len, attrs))], pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string())
        ),
        pa.array([n.data for n in nodes], pa.string()),
    ]


def _parsed(html: pa.Array) -> tuple[list[Node], list[list[Node]], list[bool], list[str | None]]:
    """All nodes, the nodes of each page, which pages are missing, and what went wrong."""
    pages = [parse_page(page) if page else ([], None) for page in html.to_pylist()]
    each = [nodes for nodes, _ in pages]
    missing = (pc.fill_null(pc.utf8_length(html), 0).to_numpy(zero_copy_only=False) == 0).tolist()
    return [n for nodes in each for n in nodes], each, missing, [error for _, error in pages]


@part_udf(PAGE)
def parse_html(html: pa.Array) -> pa.Array:
    """Page text to ``{nodes, error}``; null or empty text gives null nodes."""
    nodes, each, missing, errors = _parsed(html)
    listed = _list_of([0, *accumulate(map(len, each))], pa.StructArray.from_arrays(_node_columns(nodes), NODE.names), missing)
    return pa.StructArray.from_arrays([listed, pa.array(errors, pa.string())], PAGE.names)


# Marked as non-deterministic so that the optimizer neither repeats nor merges the
# call: a page is parsed once however often its nodes are used.
parse_html = parse_html.asNondeterministic()


# --- Markdown -----------------------------------------------------------------
#
# The dialect: hash headings on one line; paragraphs and other block elements set
# off by blank lines; `**` and `*` emphasis, dropped around block content; inline
# and fenced code; `[text](href)`, `![alt](src)`; `* ` and `1. ` lists, nested by
# indent; pipe tables with a rule below the first row; `---` for hr; two blanks
# and a newline for br, dropped before a block; script and style left out.

BLOCK = frozenset("address article aside body dd div dl dt fieldset figure footer form head header html main nav p section title".split())
LAYOUT = frozenset(["table", "thead", "tbody", "tfoot", "tr", "ul", "ol"])
STRONG = {"b": "**", "strong": "**", "i": "*", "em": "*"}


class _Frame:
    __slots__ = ("node", "parts", "items", "raw")

    def __init__(self, node: Node | None, raw: bool) -> None:
        self.node, self.parts, self.items, self.raw = node, [], 0, raw

    def add(self, piece: str) -> None:
        parts = self.parts
        if piece.startswith("\n\n"):
            if parts and parts[-1].endswith("\n\n"):
                piece = piece[2:]
            elif parts:
                parts[-1] = parts[-1].rstrip(" \n")
        elif not self.raw and parts and parts[-1].endswith("\n"):
            piece = piece.lstrip(" ")
        if piece:
            parts.append(piece)


def _single_string(nodes: list[Node], node: Node) -> bool:
    """One chain of only children that ends in a text node."""
    while node.children == 1 and node.last_id > node.node_id:
        node = nodes[node.node_id + 1]
        if node.tag == "#text":
            return True
    return False


def shown_text(nodes: list[Node], node: Node) -> str:
    inside = nodes[node.node_id : node.last_id + 1]
    return "".join(n.data.strip() for n in inside if n.tag == "#text")


def _close_frame(frame: _Frame, stack: list[_Frame]) -> str:
    node, inner = frame.node, "".join(frame.parts)
    tag = node.tag
    if tag in STRONG:
        body = inner.strip()
        if not body or "\n\n" in inner or frame.raw:
            return inner
        lead, tail = (" " if inner[0].isspace() else ""), (" " if inner[-1].isspace() else "")
        return lead + STRONG[tag] + body + STRONG[tag] + tail
    if tag in BLOCK or tag == "blockquote":
        body = inner.strip()
        if tag == "blockquote":
            body = "\n".join(f"> {line}".rstrip() for line in body.split("\n")) if body else ""
        return f"\n\n{body}\n\n" if body else ""
    if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
        body = " ".join(inner.split())
        return f"\n\n{'#' * int(tag[1])} {body}\n\n" if body else ""
    if tag == "a":
        href = node.attrs.get("href")
        return f"[{inner.strip()}]({href})" if href and inner.strip() and "\n\n" not in inner else inner
    if tag == "code":
        return f"`{inner.strip()}`" if inner.strip() and not frame.raw else inner
    if tag == "pre":
        return "\n\n```\n" + inner.strip("\n") + "\n```\n\n"
    if tag == "li":
        outer = stack[-1]
        outer.items += 1
        home = outer.node.tag if outer.node is not None else ""
        mark = f"{outer.items}. " if home == "ol" else "* "
        body = inner.strip().split("\n")
        lead = "\n" if home == "li" and outer.parts and not outer.parts[-1].endswith("\n") else ""
        return lead + mark + ("\n" + " " * len(mark)).join(body) + "\n"
    if tag in ("ul", "ol"):
        body = inner.strip("\n")
        nested = any(f.node is not None and f.node.tag == "li" for f in stack)
        return (f"\n{body}\n" if nested else f"\n\n{body}\n\n") if body else ""
    if tag in ("td", "th"):
        stack[-1].items += 1
        return "| " + " ".join(inner.split()).replace("|", "\\|") + " "
    if tag == "tr":
        table = next((f for f in reversed(stack) if f.node is not None and f.node.tag == "table"), stack[0])
        table.items += 1
        rule = "| --- " * frame.items + "|\n" if table.items == 1 else ""
        return inner.strip() + " |\n" + rule if frame.items else ""
    if tag == "table":
        return f"\n\n{inner.strip()}\n\n" if inner.strip() else ""
    return inner


def _in_table(nodes: list[Node], node: Node) -> bool:
    while node.parent_id >= 0:
        node = nodes[node.parent_id]
        if node.tag == "table":
            return True
    return False


def _droppable_row(nodes: list[Node], row: Node) -> bool:
    cells = [n for n in nodes[row.node_id + 1 : row.last_id + 1] if n.tag in ("td", "th")]
    return all(not shown_text(nodes, cell) for cell in cells)


def node_markdown(nodes: list[Node], first: int, last: int, clean_tables: bool = False) -> str:
    """Markdown of the nodes ``first`` to ``last``, a subtree or a whole page."""
    stack = [_Frame(None, False)]
    i = first
    while i <= last or len(stack) > 1:
        while len(stack) > 1 and (i > last or stack[-1].node.last_id < i):
            frame = stack.pop()
            stack[-1].add(_close_frame(frame, stack))
        if i > last:
            break
        node, top = nodes[i], stack[-1]
        i += 1
        if node.tag == "#text":
            if top.raw:
                top.add(node.data)
            elif not (top.node is not None and top.node.tag in LAYOUT and not node.data.strip()):
                top.add(re.sub(r"\s+", " ", node.data))
        elif node.tag == "br":
            top.add("\n" if top.raw else "  \n")
        elif node.tag == "hr":
            top.add("\n\n---\n\n")
        elif node.tag == "img":
            top.add(f"![{node.attrs.get('alt', '')}]({node.attrs.get('src', '')})")
        elif node.tag in HIDDEN or (clean_tables and node.tag == "tr" and _in_table(nodes, node) and _droppable_row(nodes, node)):
            i = node.last_id + 1
        elif node.tag != "#data":
            stack.append(_Frame(node, top.raw or node.tag == "pre"))
            if clean_tables and node.tag in ("td", "th") and _single_string(nodes, node):
                stack[-1].add(shown_text(nodes, node))
                i = node.last_id + 1
    return "".join(stack[0].parts).strip()


CONTENT_NODE = T.StructType([*NODE.fields, T.StructField("markdown", T.StringType())])
CONTENT_PAGE = T.StructType([T.StructField("nodes", T.ArrayType(CONTENT_NODE)), *PAGE.fields[1:], T.StructField("whole", T.StringType())])


def content_parser(asked):
    """A function from page text to nodes that carry their Markdown where it is asked for; the page is parsed once.

    ``asked`` gets the nodes of a page and returns node id -> whether to clean tables (rows without content go, one-text cells
    are plain) for the nodes to convert; the id -1 stands for the whole page, whose Markdown is ``whole``.
    """

    @part_udf(CONTENT_PAGE)
    def parse(html: pa.Array) -> pa.Array:
        nodes, each, missing, errors = _parsed(html)
        texts, wholes = [], []
        for page in each:
            found = asked(page)
            own = [None] * len(page)
            for i, clean in found.items():
                if i >= 0:
                    own[i] = node_markdown(page, i, page[i].last_id, clean)
            texts += own
            wholes.append(node_markdown(page, 0, len(page) - 1, found[-1]) if -1 in found else None)
        columns = [*_node_columns(nodes), pa.array(texts, pa.string())]
        listed = _list_of([0, *accumulate(map(len, each))], pa.StructArray.from_arrays(columns, CONTENT_NODE.names), missing)
        return pa.StructArray.from_arrays([listed, pa.array(errors, pa.string()), pa.array(wholes, pa.string())], CONTENT_PAGE.names)

    return parse.asNondeterministic()


def _whole(html: pa.Array, clean_tables: bool) -> pa.Array:
    out = []
    for page in html.to_pylist():
        nodes = parse_page(page)[0] if page else []
        out.append(node_markdown(nodes, 0, len(nodes) - 1, clean_tables) if page else None)
    return pa.array(out, pa.string())


@part_udf(T.StringType())
def html_to_markdown(html: pa.Array) -> pa.Array:
    return _whole(html, False)


@part_udf(T.StringType())
def html_to_clean_markdown(html: pa.Array) -> pa.Array:
    return _whole(html, True)


ELEMENTS = T.StructType([*NODE.fields[:-1], T.StructField("own_text", T.StringType())])


@F.udtf(returnType=ELEMENTS, useArrow=True)
class HtmlElements:
    """The elements of a page as rows, in document order; none for null or empty text."""

    def eval(self, html: str):
        for n in parse_page(html)[0] if html else ():
            if not n.tag.startswith("#"):
                attrs = n.attrs or {}
                numbers = [getattr(n, name) for name in _INTS]
                yield (*numbers, n.tag, attrs.get("id"), attrs.get("class", "").split(), attrs, n.data or "")


def register(spark) -> None:
    """Make the page functions callable from SQL: ``html_elements`` as a table function, as in
    ``SELECT p.page_id, e.tag FROM pages p, LATERAL html_elements(p.html) e``, ``html_nodes`` as a function, as in
    ``SELECT page_id, inline(html_nodes(html).nodes) FROM pages``, and the text functions."""
    spark.udtf.register("html_elements", HtmlElements)
    spark.udf.register("html_nodes", parse_html)
    spark.udf.register("html_to_markdown", html_to_markdown)
    spark.udf.register("compat_fold", compat_fold)
    spark.udf.register("ascii_fold", ascii_text)
