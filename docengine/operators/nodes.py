"""Page nodes: parsing, named selections and what is read off single elements.

A parsed page is one row with its nodes as an array in document order, where the
position in the array equals ``node_id``. All selections below stay inside that
row: children and parents are looked up by position, descendants are a slice.
Nothing is shuffled until thin result rows are wanted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions.html import parse_html
from docengine.functions.selectors import Compiled
from docengine.functions.text import clean_text, let, strip


@dataclass(frozen=True)
class Profile:
    """Names the page layout uses; pass another one for another site.

    ``selectors`` holds (name, selector text) pairs that replace or add to the named selections. ``menu_classes`` are the
    classes of which a list entry needs one to count as a menu around an item.
    """

    wrapper: str = "filter-api-sidebar-wrapper"
    sidebar: str = "app-api-doc-sidebar"
    entry: str = "app-api-doc-item"
    divider: str = "toc-item-divider"
    highlight: str = "toc-item-highlight"
    clickable: str = "clickable"
    closed_icon: str = "dds__icon--chevron-right"
    opened_icon: str = "dds__icon--chevron-down"
    text_suffix: str = "-sp"
    menu_text: tuple[str, ...] = ("align-middle", "dds__text-truncate", "dds__position-relative")
    link: str = "toc-link"
    loader_id: str = "loaderActive"
    content_id: str = "documentation"
    menu_classes: tuple[str, ...] = ("toc-item", "toc-item-highlight")
    selectors: tuple[tuple[str, str], ...] = ()


DEFAULT = Profile()


def with_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``nodes`` and ``parse_error``; pages without HTML drop out."""
    parsed = pages.filter(F.length(html) > 0).withColumn("_page", parse_html(F.col(html)))
    return parsed.withColumn("nodes", F.col("_page.nodes")).withColumn("parse_error", F.col("_page.error")).drop("_page")


# --- helpers over one page's node array ---------------------------------------


def first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def has_class(node: Column, *names: str) -> Column:
    found = F.lit(True)
    for name in names:
        found = found & F.array_contains(node["classes"], name)
    return found


def is_tag(node: Column, *tags: str) -> Column:
    return node["tag"].isin(*tags) if len(tags) > 1 else node["tag"] == tags[0]


def parent_of(nodes: Column, node: Column) -> Column:
    return F.get(nodes, node["parent_id"])


def inside(nodes: Column, node: Column) -> Column:
    """Descendants of ``node`` in document order."""
    return F.slice(nodes, node["node_id"] + 2, node["last_id"] - node["node_id"])


def contains(outer: Column, inner: Column) -> Column:
    """``inner`` lies strictly inside ``outer``."""
    return (outer["node_id"] < inner["node_id"]) & (inner["node_id"] <= outer["last_id"])


def shown_text(nodes: Column, node: Column) -> Column:
    """Visible text: every text node stripped, then joined without a separator."""
    pieces = F.filter(inside(nodes, node), lambda n: is_tag(n, "#text"))
    return F.array_join(F.transform(pieces, lambda n: strip(n["data"])), "")


def text_content(nodes: Column, node: Column) -> Column:
    """Text as written, white space squeezed and trimmed."""
    pieces = F.filter(inside(nodes, node), lambda n: is_tag(n, "#text", "#data"))
    return clean_text(F.array_join(F.transform(pieces, lambda n: n["data"]), ""))


def rows_of(df: DataFrame, array: Column, keys: tuple[str, ...], present: str = "node_id") -> DataFrame:
    """One row per struct of an array that is costly to compute.

    The outer form is used because for the plain one the optimizer adds a test that
    the array is not empty, which computes it again; ``present`` names a field that
    is never null.
    """
    return df.select(*keys, F.inline_outer(array)).filter(F.col(present).isNotNull())


def numbered_rows_of(df: DataFrame, array: Column, keys: tuple[str, ...], pos: str, value: str) -> DataFrame:
    """The same with positions, for arrays of any element type."""
    return df.select(*keys, F.posexplode_outer(array).alias(pos, value)).filter(F.col(pos).isNotNull())


# --- named selections -----------------------------------------------------------


def _highlight(n: Column, p: Profile) -> Column:
    return is_tag(n, "li") & has_class(n, p.highlight)


def _root(nodes: Column, n: Column, p: Profile) -> Column:
    def wrapper(x: Column) -> Column:
        return F.coalesce(is_tag(x, "div") & has_class(x, p.wrapper), F.lit(False))

    def direct(parent: Column) -> Column:
        through = is_tag(parent, p.sidebar) & wrapper(parent_of(nodes, parent))
        return wrapper(parent) | F.coalesce(through, F.lit(False))

    return is_tag(n, "ul") & let(parent_of(nodes, n), direct)


def root_of(nodes: Column, p: Profile = DEFAULT) -> Column:
    """The navigation list, or null."""
    return first(F.filter(nodes, lambda n: F.coalesce(_root(nodes, n, p), F.lit(False))))


def selectors(p: Profile = DEFAULT) -> dict[str, str]:
    """Named selections of a page layout, as selector text."""
    return {
        "sidebar_container": f"div.{p.wrapper}",
        "sidebar_root": f"div.{p.wrapper} > {p.sidebar} > ul, div.{p.wrapper} > ul",
        "entry": p.entry,
        "header_li": f"li.{p.divider}",
        "highlight_li": f"li.{p.highlight}",
        "highlight_li_with_id": f"li.{p.highlight}[id]",
        "highlight_li_without_id": f"li.{p.highlight}:not([id])",
        "clickable_li": f"li.{p.highlight}.{p.clickable}",
        "anchor": "a",
        "item_text_span": f"span[id$='{p.text_suffix}']",
        "menu_text_div": "div" + "".join(f".{c}" for c in p.menu_text),
        "closed_icon": f"i.{p.closed_icon}",
        "opened_icon": f"i.{p.opened_icon}",
        "highlight_closed_icon": f"li.{p.highlight} i.{p.closed_icon}",
        "item_link": f"a.{p.link}",
        "loader": f"#{p.loader_id}",
        "content_pane": f"#{p.content_id}",
        "active_tab_panel": "div[role='tabpanel'][aria-hidden='false']",
        **dict(p.selectors),
    }


def select_nodes(parsed: DataFrame, selector, keys: tuple[str, ...] = ("page_id",), profile: Profile = DEFAULT) -> DataFrame:
    """One row per node that a named selection, a selector text or a predicate over (all nodes, node) picks."""
    nodes = F.col("nodes")
    if callable(selector):
        return rows_of(parsed, F.filter(nodes, lambda n: F.coalesce(selector(nodes, n), F.lit(False))), keys)
    marked = parsed.withColumn("_picked", Compiled({"": selectors(profile).get(selector, selector)}).selected(nodes))
    picked = F.filter(F.zip_with(nodes, "_picked", lambda n, b: F.struct(n.alias("node"), b.alias("bits"))), lambda x: x["bits"] != 0)
    return rows_of(marked, F.transform(picked, lambda x: x["node"]), keys)


def select_all(parsed: DataFrame, keys: tuple[str, ...] = ("page_id",), profile: Profile = DEFAULT, named: dict[str, str] | None = None) -> DataFrame:
    """One row per selection and node it picks, with the node's id and the first text inside, else beside it.

    ``named`` gives selector texts by name; by default all of the profile's. Each node is visited once for all of them.
    """
    nodes, compiled = F.col("nodes"), Compiled(named or selectors(profile))

    def first_text(n: Column) -> Column:
        texts = F.transform(F.filter(inside(nodes, n), lambda x: is_tag(x, "#text")), lambda x: clean_text(x["data"]))
        return first(F.filter(texts, lambda t: t != ""))

    def row(n: Column, name: Column) -> Column:
        text = F.coalesce(first_text(n), first_text(parent_of(nodes, n)))
        return F.struct(name.alias("selector"), n["node_id"].alias("node_id"), n["dom_id"].alias("dom_id"), text.alias("text"))

    def rows(x: Column) -> Column:
        own = F.filter(F.lit(compiled.names), lambda _, k: F.getbit(x["bits"], k) == 1)
        return F.transform(own, lambda name: row(x["node"], name))

    marked = parsed.withColumn("_picked", compiled.selected(nodes))
    picked = F.filter(F.zip_with(nodes, "_picked", lambda n, b: F.struct(n.alias("node"), b.alias("bits"))), lambda x: x["bits"] != 0)
    return rows_of(marked, F.flatten(F.transform(picked, rows)), keys)


def html_nodes(parsed: DataFrame, keys: tuple[str, ...] = ("page_id",), whole_text: bool = False) -> DataFrame:
    """One row per element, with its own visible text.

    ``whole_text`` adds the text of its subtree. Elements that are never closed nest, so these texts can be quadratic
    in the page; better ask for them on the few elements that ``select_nodes`` picks.
    """
    nodes = F.col("nodes")

    def row(n: Column) -> Column:
        named = n.withField("own_text", F.coalesce(n["data"], F.lit(""))).dropFields("data")
        return named.withField("text", shown_text(nodes, n)) if whole_text else named

    elements = F.filter(nodes, lambda n: ~n["tag"].startswith("#"))
    return rows_of(parsed, F.transform(elements, row), keys)


def find_root(parsed: DataFrame, keys: tuple[str, ...] = ("page_id",), profile: Profile = DEFAULT) -> DataFrame:
    """The navigation list of each page; pages without one drop out."""
    return rows_of(parsed, F.array(root_of(F.col("nodes"), profile)), keys)


def link_href(parsed: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """All link targets of each page, in order; links without a target drop out."""
    links = F.filter(F.col("nodes"), lambda n: is_tag(n, "a") & F.map_contains_key(n["attrs"], "href"))
    hrefs = F.transform(links, lambda n: n["attrs"]["href"])
    return numbered_rows_of(parsed, hrefs, keys, "link_pos", "href")


def first_href(nodes: Column, node: Column) -> Column:
    """Target of the first link under an element, else null."""
    return first(F.filter(inside(nodes, node), lambda n: is_tag(n, "a")))["attrs"]["href"]


def first_tag_text(parsed: DataFrame, tags: list[str], keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Visible text of the first element of each given tag, one column per tag."""
    nodes = F.col("nodes")

    def text(tag: str) -> Column:
        found = first(F.filter(nodes, lambda n: is_tag(n, tag)))
        return let(found, lambda n: F.when(n.isNotNull(), shown_text(nodes, n)))

    return parsed.select(*keys, *[text(tag).alias(tag) for tag in tags])


def structure_counts(parsed: DataFrame, keys: tuple[str, ...] = ("page_id",), profile: Profile = DEFAULT) -> DataFrame:
    """Counts both structure rules and the expansion test rest on."""
    p, nodes = profile, F.col("nodes")

    def icons(name: str, li) -> Column:
        """Icons of the class inside some list entry ``li`` accepts."""
        return let(
            F.filter(nodes, li),
            lambda lis: F.size(
                F.filter(nodes, lambda n: is_tag(n, "i") & has_class(n, name) & F.exists(lis, lambda o: contains(o, n)))
            ),
        )

    def count(predicate) -> Column:
        return F.size(F.filter(nodes, predicate))

    def leaf(n: Column) -> Column:
        icon = F.exists(inside(nodes, n), lambda c: is_tag(c, "i") & (has_class(c, p.closed_icon) | has_class(c, p.opened_icon)))
        return _highlight(n, p) & n["dom_id"].isNotNull() & ~icon

    return parsed.select(
        *keys,
        count(lambda n: is_tag(n, "li") & has_class(n, p.divider)).alias("headers"),
        count(lambda n: _highlight(n, p) & n["dom_id"].isNotNull()).alias("with_id"),
        count(lambda n: _highlight(n, p) & n["dom_id"].isNull()).alias("without_id"),
        icons(p.closed_icon, lambda n: _highlight(n, p)).alias("expanders"),
        count(leaf).alias("leaf_items"),
        icons(p.closed_icon, lambda n: _highlight(n, p) & n["dom_id"].isNull()).alias("closed_menus"),
    )


FLAT, HIERARCHICAL, MIXED = "flat_with_trailing_header", "hierarchical_with_leading_header", "mixed"


def structure_type(headers: Column, with_id: Column, without_id: Column) -> Column:
    """Two-way rule over the counts of a stored page."""
    return F.when((without_id > with_id) & (headers > 0), F.lit(FLAT)).otherwise(F.lit(HIERARCHICAL))


def structure_type_live(headers: Column, with_id: Column, without_id: Column, expanders: Column) -> Column:
    """Three-way rule, as used on a rendered page."""
    return (
        F.when((without_id > with_id) & (expanders > 0), F.lit(FLAT))
        .when((headers > 0) & (with_id > without_id), F.lit(HIERARCHICAL))
        .otherwise(F.lit(MIXED))
    )


def needs_expansion(leaf_items: Column, closed_menus: Column) -> Column:
    return (leaf_items > 5) | (closed_menus > 3)
