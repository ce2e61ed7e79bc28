"""From page nodes to navigation entries, and from entries to nested and flat items.

Everything about one page is derived inside that page's row, by slices and
lookups over its node array, so building the tree shuffles nothing. The table
forms below it (header attachment, nesting, flattening) take any item table.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.functions.page_index import tree_order
from docengine.functions.text import clean_text, let, synthetic_id
from docengine.operators import rules
from docengine.operators.nodes import (
    DEFAULT,
    FLAT,
    Profile,
    contains,
    first,
    has_class,
    inside,
    is_tag,
    numbered_rows_of,
    root_of,
    shown_text,
    structure_counts,
    structure_type,
    with_nodes,
)
from docengine.operators.ordered import nearest, null_safe_join, running_row_number

DEFAULT_HEADER = "API Documentation"


# --- facts about single elements ------------------------------------------------


def header_text(nodes: Column, divider: Column) -> Column:
    anchor = first(F.filter(inside(nodes, divider), lambda n: is_tag(n, "a")))
    return let(
        anchor,
        lambda a: F.when(a.isNull(), F.lit("Unknown Header")).otherwise(clean_text(shown_text(nodes, a))),
    )


def is_expandable(nodes: Column, li: Column, p: Profile = DEFAULT) -> Column:
    return F.exists(
        inside(nodes, li), lambda n: is_tag(n, "i") & (has_class(n, p.closed_icon) | has_class(n, p.opened_icon))
    )


def element_texts(nodes: Column, found: Column) -> Column:
    """Cleaned visible text of each element of an array; null where it is missing or empty."""
    return F.transform(
        found, lambda n: F.when(n.isNotNull(), clean_text(F.nullif(shown_text(nodes, n), F.lit(""))))
    )


def _text_sources(nodes: Column, li: Column, p: Profile) -> Column:
    """First hit of each text selector, broad menu selectors first."""
    wide = p.menu_text
    tests = [
        lambda n: is_tag(n, "div") & has_class(n, *wide),
        lambda n: is_tag(n, "div") & has_class(n, *wide[:2]),
        lambda n: is_tag(n, "div") & has_class(n, *wide[:1]),
        lambda n: is_tag(n, "span") & n["dom_id"].endswith(p.text_suffix),
        lambda n: is_tag(n, "span"),
        lambda n: is_tag(n, "a"),
        lambda n: is_tag(n, "div"),
    ]
    hits = let(inside(nodes, li), lambda sub: F.array(*[first(F.filter(sub, t)) for t in tests], li))
    return element_texts(nodes, hits)


# Which of the sources above a menu and an item try, in order.
MENU_SOURCES, ITEM_SOURCES = [0, 1, 2, 4, 6], [3, 4, 5, 6]
SPAN_SOURCE, WHOLE_SOURCE = 3, 7


def _choose(texts: Column, is_menu: Column) -> Column:
    """First source with more than one character, else the last hit, else the whole entry."""

    def pick(sources: list[int]) -> Column:
        return F.array(*[texts[i] for i in sources])

    def settle(tries: Column) -> Column:
        found = F.coalesce(first(F.filter(tries, lambda t: F.length(t) > 1)), F.try_element_at(tries, F.lit(-1)))
        return let(found, fall_back)

    def fall_back(text: Column) -> Column:
        whole = texts[WHOLE_SOURCE]
        unknown = F.coalesce(text.isin("", "Unknown Item", "Unknown Menu"), F.lit(True))
        usable = F.coalesce(F.length(whole) > 1, F.lit(False))
        nameless = F.when(is_menu & text.isNotNull(), F.lit("Unknown Menu")).otherwise(F.lit("Unknown Item"))
        return (
            F.when(~unknown, text)
            .when(usable, F.substring(whole, 1, 100))
            .otherwise(F.coalesce(F.nullif(text, F.lit("")), nameless))
        )

    found = F.when(is_menu, pick(MENU_SOURCES)).otherwise(pick(ITEM_SOURCES))
    return let(F.filter(found, lambda t: t.isNotNull()), settle)


def li_texts(nodes: Column, li: Column, is_menu: Column, p: Profile = DEFAULT) -> Column:
    """``{text, child_text}`` of a list entry: as an entry, and as the child of a menu,
    where the text span goes first and it always counts as an item."""

    def both(sources: Column) -> Column:
        pair = F.transform(F.array(is_menu, F.lit(False)), lambda m: _choose(sources, m))
        return let(
            pair,
            lambda t: F.struct(
                t[0].alias("text"), F.coalesce(sources[SPAN_SOURCE], t[1]).alias("child_text")
            ),
        )

    return let(_text_sources(nodes, li, p), both)


def nested_lis(nodes: Column, li: Column, p: Profile = DEFAULT) -> Column:
    """List entries with an id anywhere below ``li``."""
    return F.filter(
        inside(nodes, li), lambda n: is_tag(n, "li") & has_class(n, p.highlight) & rules.filled(n["dom_id"])
    )


# --- entries of a page ------------------------------------------------------------


def _entry(nodes: Column, e: Column, p: Profile) -> Column:
    def texts(li: Column, is_menu: Column) -> Column:
        """Texts of the entry itself, then of the entries nested in it."""
        all_lis = F.when(is_menu, F.concat(F.array(li), nested_lis(nodes, li, p))).otherwise(F.array(li))

        def one(n: Column, i: Column) -> Column:
            return F.struct(
                n["node_id"].alias("node_id"),
                n["dom_id"].alias("id"),
                li_texts(nodes, n, is_menu & (i == 0), p).alias("t"),
            )

        return F.when(li.isNotNull(), F.transform(all_lis, one))

    def describe(li: Column, divider: Column, is_menu: Column) -> Column:
        def build(ul: Column, own: Column) -> Column:
            nested = F.transform(
                F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))),
                lambda n: F.struct(n["node_id"].alias("node_id"), n["id"].alias("id"), n["t"]["child_text"].alias("text")),
            )
            return F.struct(
                *[e[c].alias(c) for c in ("node_id", "last_id", "parent_id", "sib_idx", "child_ord", "depth")],
                divider.isNotNull().alias("has_divider"),
                F.when(divider.isNotNull(), header_text(nodes, divider)).alias("divider_text"),
                li.isNotNull().alias("has_li"),
                li["node_id"].alias("li_node"),
                li["dom_id"].alias("id"),
                is_menu.alias("is_menu"),
                own[0]["t"]["text"].alias("text"),
                own[0]["t"]["child_text"].alias("child_text"),
                F.coalesce(ul["node_id"], F.lit(-1)).alias("ul"),
                F.coalesce(ul["last_id"], F.lit(-1)).alias("ul_last"),
                nested.alias("nested"),
            )

        sibling = F.filter(F.array(F.get(nodes, e["next_id"])), lambda s: is_tag(s, "ul"))
        return let(first(sibling), lambda ul: let(texts(li, is_menu), lambda own: build(ul, own)))

    def with_sub(sub: Column) -> Column:
        li = first(F.filter(sub, lambda n: is_tag(n, "li") & has_class(n, p.highlight)))
        divider = first(F.filter(sub, lambda n: is_tag(n, "li") & has_class(n, p.divider)))
        flag = lambda l: F.coalesce(is_expandable(nodes, l, p), F.lit(False))
        return let(li, lambda l: let(divider, lambda d: let(flag(l), lambda m: describe(l, d, m))))

    return let(inside(nodes, e), with_sub)


def _placed(entries: Column, root: Column) -> Column:
    """Add to each entry its level below the root, its parent menu and its headers."""

    def place(menus: Column, headers: Column) -> Column:
        def one(e: Column) -> Column:
            def with_outer(outer: Column) -> Column:
                parent = first(F.filter(outer, lambda m: m["ul"] == e["parent_id"]))
                level = F.size(outer)
                reached = (
                    root.isNotNull()
                    & F.coalesce(contains(root, e), F.lit(False))
                    & (e["depth"] == root["depth"] + 1 + level)
                )
                earlier = F.filter(headers, lambda h: h["node_id"] < e["node_id"])
                later = F.filter(headers, lambda h: h["node_id"] > e["node_id"])
                leading = F.try_element_at(earlier, F.lit(-1))
                trailing = F.coalesce(first(later), F.try_element_at(headers, F.lit(-1)))
                return F.struct(
                    e.alias("e"),
                    F.when(reached, level).otherwise(F.lit(-1)).alias("level"),
                    parent.alias("parent"),
                    F.transform(outer, lambda m: m["node_id"]).alias("outer"),
                    leading.alias("leading"),
                    trailing.alias("trailing"),
                )

            inner = F.filter(menus, lambda m: (m["ul"] < e["node_id"]) & (e["node_id"] <= m["ul_last"]))
            return let(inner, with_outer)

        return F.transform(entries, one)

    menus = F.filter(entries, lambda e: e["is_menu"] & (e["ul"] >= 0))
    thin = F.transform(
        menus, lambda m: F.struct(*[m[c].alias(c) for c in ("node_id", "ul", "ul_last", "id", "text", "has_li")])
    )
    tops = F.filter(entries, lambda e: e["has_divider"] & (e["parent_id"] == root["node_id"]))
    headers = F.transform(tops, lambda h: F.struct(h["node_id"].alias("node_id"), h["divider_text"].alias("text")))
    return let(thin, lambda m: let(headers, lambda h: place(m, h)))


@lru_cache(maxsize=16)
def page_entries(p: Profile, _session: SparkSession) -> Column:
    """Entries of a page, from its ``nodes`` column, in document order as an array of structs."""
    # The expression is large; building it once per session and layout is enough.
    nodes = F.col("nodes")
    root = root_of(nodes, p)
    entries = F.transform(F.filter(nodes, lambda n: is_tag(n, p.entry)), lambda e: _entry(nodes, e, p))
    return let(root, lambda r: let(entries, lambda es: _placed(es, r)))


def with_entries(parsed: DataFrame, profile: Profile = DEFAULT, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Pages with their ``entries`` and two-way ``structure``; nodes are dropped here."""
    counts = ["headers", "with_id", "without_id"]
    counted = structure_counts(parsed.withColumn("_entries", page_entries(profile, parsed.sparkSession)), (*keep, "_entries"), profile)
    kind = structure_type(*[F.col(c) for c in counts])
    return counted.select(*keep, F.col("_entries").alias("entries"), kind.alias("structure"))


def entry_rows(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "structure")) -> DataFrame:
    """One row per entry."""
    placed = pages.select(*keys, F.inline_outer("entries")).filter(F.col("e").isNotNull())
    return placed.select(
        *keys, "e.*", "level", "outer", F.col("parent.node_id").alias("parent_entry"),
        F.col("parent.text").alias("parent_text"), F.col("leading.text").alias("leading_header"),
        F.col("trailing.text").alias("trailing_header"),
    )


# --- accepted items of a page -------------------------------------------------------


def resolved_id(item_id: Column, text: Column, is_menu: Column) -> Column:
    """Id of an entry; items without one get a stand-in if they look like an endpoint."""
    stand_in = F.when(rules.looks_like_endpoint(text), synthetic_id(text))
    return F.when(is_menu | rules.filled(item_id), item_id).otherwise(F.coalesce(stand_in, item_id))


def _kind(is_menu: Column) -> Column:
    return F.when(is_menu, F.lit("menu")).otherwise(F.lit("item"))


def _item(node_id, item_id, text, kind, header, menu, level) -> Column:
    return F.struct(
        node_id.alias("node_id"), item_id.alias("id"), text.alias("text"), kind.alias("type"), header.alias("header"),
        menu.alias("menu"), menu.alias("parent_menu_text"), level.alias("level"),
    )


def hierarchical_items(entries: Column) -> Column:
    """Leading headers: top entries below a header, and one level of children of accepted menus."""

    def top_ok(e: Column) -> Column:
        return e["has_li"] & ~e["has_divider"] & rules.add_entry(e["id"], e["text"], _kind(e["is_menu"]))

    def child_ok(e: Column) -> Column:
        return e["has_li"] & ~rules.skip_item(e["child_text"]) & rules.filled(e["id"])

    def rows(menus: Column) -> Column:
        def keep(x: Column) -> Column:
            child = child_ok(x["e"]) & F.array_contains(menus, x["parent"]["node_id"])
            return F.when(x["level"] == 0, top_ok(x["e"])).when(x["level"] == 1, child).otherwise(F.lit(False)) & x["leading"].isNotNull()

        def one(x: Column) -> Column:
            e, top = x["e"], x["level"] == 0
            return _item(
                e["node_id"], e["id"], F.when(top, e["text"]).otherwise(e["child_text"]),
                F.when(top, _kind(e["is_menu"])).otherwise(F.lit("item")), x["leading"]["text"],
                F.when(~top, x["parent"]["text"]), x["level"],
            )

        return F.transform(F.filter(entries, lambda x: F.coalesce(keep(x), F.lit(False))), one)

    tops = F.filter(entries, lambda x: (x["level"] == 0) & x["leading"].isNotNull() & x["e"]["is_menu"] & top_ok(x["e"]))
    return let(F.transform(tops, lambda x: x["e"]["node_id"]), rows)


def flat_items(entries: Column) -> Column:
    """Trailing headers: entries at any depth below accepted menus; a menu without
    accepted children takes the list entries inside it instead."""

    def ok(x: Column) -> Column:
        e = x["e"]
        valid = rules.entry_valid(resolved_id(e["id"], e["text"], e["is_menu"]), e["text"], _kind(e["is_menu"]))
        top_header = (x["level"] == 0) & e["has_divider"]
        return F.coalesce((x["level"] >= 0) & ~top_header & e["has_li"] & ~rules.skip_item(e["text"]) & valid, F.lit(False))

    def rows(accepted: Column) -> Column:
        ids = F.transform(accepted, lambda x: x["e"]["node_id"])
        parents = F.transform(F.filter(accepted, lambda x: x["parent"].isNotNull()), lambda x: x["parent"]["node_id"])

        def one(x: Column, parent_ids: Column) -> Column:
            e = x["e"]
            header = F.coalesce(x["trailing"]["text"], F.lit(DEFAULT_HEADER))
            me = _item(
                e["node_id"], resolved_id(e["id"], e["text"], e["is_menu"]), e["text"], _kind(e["is_menu"]), header,
                x["parent"]["text"], x["level"],
            )
            inner = F.filter(e["nested"], lambda n: ~rules.skip_item(n["text"]))
            below = F.transform(
                inner,
                lambda n: _item(n["node_id"], n["id"], n["text"], F.lit("item"), header, e["text"], x["level"] + 1),
            )
            fallback = e["is_menu"] & ~F.array_contains(parent_ids, e["node_id"])
            return F.when(fallback, F.concat(F.array(me), below)).otherwise(F.array(me))

        def reachable(known: Column) -> Column:
            kept = F.filter(accepted, lambda x: F.size(F.array_except(x["outer"], known)) == 0)
            return let(parents, lambda ps: F.flatten(F.transform(kept, lambda x: one(x, ps))))

        return let(ids, reachable)

    return let(F.filter(entries, ok), rows)


def _kind_column(structure: str | None) -> Column:
    return F.lit(structure) if structure else F.col("structure")


@lru_cache(maxsize=16)
def _items(structure: str | None, _session: SparkSession) -> Column:
    entries = F.col("entries")
    if structure:
        return flat_items(entries) if structure == FLAT else hierarchical_items(entries)
    return F.when(F.col("structure") == FLAT, flat_items(entries)).otherwise(hierarchical_items(entries))


def _fine_items(structure: str | None, session: SparkSession) -> Column:
    return F.filter(_items(structure, session), lambda i: rules.item_fault(i["text"], i["type"], i["level"]).isNull())


def page_items(pages: DataFrame, structure: str | None = None, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The flat item list of each page, with ``pos``; the item model drops bad rows.

    ``structure`` forces one of the two readings.
    """
    return numbered_rows_of(pages, _fine_items(structure, pages.sparkSession), keys, "pos", "i").select(
        *keys, "pos", "i.id", clean_text(F.col("i.text")).alias("text"), "i.type", "i.header", "i.menu",
        "i.parent_menu_text", "i.level",
    )


def parse_structure(pages: DataFrame, profile: Profile = DEFAULT, structure: str | None = None, keys: tuple[str, ...] = ("page_id",),
                    depth: int | None = None) -> DataFrame:
    """Raw pages to one row each: the nested form, the flat items and their counts.

    ``structured_data`` is that of ``page_groups``, ``items`` the rows of ``page_items`` as an array; ``valid_items`` are items
    with an id. A page without a navigation list has empty lists and counts of zero.
    """
    placed = with_entries(with_nodes(pages), profile, keys)
    groups = page_groups(placed.withColumn("_entries_", F.col("entries")), structure, (*keys, "_entries_", "structure"), depth)
    names = ("id", "text", "type", "header", "menu", "parent_menu_text", "level")
    flat = F.transform(
        _fine_items(structure, pages.sparkSession),
        lambda i: F.struct(*[(clean_text(i[c]) if c == "text" else i[c]).alias(c) for c in names]),
    )
    both = groups.withColumnRenamed("_entries_", "entries").withColumn("items", F.coalesce(flat, F.slice(flat, 1, 0)))

    def number(test) -> Column:
        return F.size(F.filter("items", test)).cast("long")

    return both.select(
        *keys, "structured_data", "items", F.size("items").cast("long").alias("total_items"),
        number(lambda i: i["id"].isNotNull() & (i["type"] == "item")).alias("valid_items"),
        number(lambda i: i["type"] == "menu").alias("menu_items"), number(lambda i: i["type"] == "item").alias("content_items"),
    )


def parse_sidebar(pages: DataFrame, profile: Profile = DEFAULT, structure: str | None = None) -> DataFrame:
    """Raw pages to flat items."""
    return page_items(with_entries(with_nodes(pages), profile), structure)


def page_groups(pages: DataFrame, structure: str | None = None, keys: tuple[str, ...] = ("page_id",), depth: int | None = None) -> DataFrame:
    """The nested form of each page: header groups, their items, and the items of menus to any depth.

    ``depth`` is the deepest level; where it is not given, a query over the levels finds it.
    """
    if depth is None:
        levels = F.array_max(F.transform(_items(structure, pages.sparkSession), lambda i: i["level"]))
        depth = pages.agg(F.max(levels)).first()[0]
    groups = _groups_column(structure, max(1, depth or 0), pages.sparkSession)
    return pages.select(*keys, groups.alias("structured_data"))


@lru_cache(maxsize=16)
def _groups_column(structure: str | None, depth: int, _session) -> Column:
    entries = F.col("entries")
    flat = _kind_column(structure) == FLAT
    items = _items(structure, _session)
    tops = F.filter(entries, lambda x: x["e"]["has_divider"] & (x["level"] == 0))
    heads = F.transform(tops, lambda x: F.struct(x["e"]["node_id"].alias("node_id"), x["e"]["divider_text"].alias("text"), header_position(entries, x).alias("position")))
    default = F.struct(F.lit(2**31 - 1).alias("node_id"), F.lit(DEFAULT_HEADER).alias("text"), F.lit(None).cast("int").alias("position"))
    heads = F.when(flat & (F.size(tops) == 0), F.array(default)).otherwise(heads)

    def leaf(i: Column) -> Column:
        return F.struct(i["text"].alias("text"), i["id"].alias("id"), i["type"].alias("type"), (i["type"] == "menu").alias("is_expandable"))

    def group(all_items: Column, all_heads: Column, h: Column, n: Column) -> Column:
        before = F.coalesce(F.get(all_heads, n - 1)["node_id"], F.lit(-1))
        after = F.coalesce(F.get(all_heads, n + 1)["node_id"], F.lit(2**31 - 1))
        last = n == F.size(all_heads) - 1

        def mine(i: Column) -> Column:
            trailing = (i["node_id"] > before) & ((i["node_id"] < h["node_id"]) | last)
            leading = (i["node_id"] > h["node_id"]) & (i["node_id"] < after)
            return F.when(flat, trailing).otherwise(leading)

        def children(scope: Column, level: int = 0) -> Column:
            here = F.filter(scope, lambda i: i["level"] == level)
            if level == depth:
                return F.transform(here, leaf)

            def below(i: Column, k: Column) -> Column:
                end = F.coalesce(F.get(here, k + 1)["node_id"], F.lit(2**31 - 1))
                inside = F.filter(scope, lambda c: (c["level"] > level) & (c["node_id"] > i["node_id"]) & (c["node_id"] < end))
                return children(inside, level + 1)

            return F.transform(here, lambda i, k: leaf(i).withField("children", F.when(i["type"] == "menu", below(i, k))))

        return let(
            F.filter(all_items, mine),
            lambda own: F.struct(h["text"].alias("header_text"), F.when(flat, h["position"]).alias("position"), children(own).alias("children")),
        )

    return let(items, lambda its: let(heads, lambda hs: F.transform(hs, lambda h, n: group(its, hs, h, n))))


def header_position(entries: Column, header: Column) -> Column:
    """Children of the list before a header, text counted, other headers not."""
    e = header["e"]
    earlier = F.filter(
        entries,
        lambda x: x["e"]["has_divider"] & (x["e"]["parent_id"] == e["parent_id"]) & (x["e"]["node_id"] < e["node_id"]),
    )
    return e["child_ord"] - F.size(earlier)


# --- table forms ------------------------------------------------------------------


def attach_leading_header(rows: DataFrame, keys: list[str], pos: str, is_header: Column, text: Column) -> DataFrame:
    """Give each non-header row the nearest header before it; rows before any header drop out."""
    marked = rows.withColumn("_is_header", is_header)
    found = nearest(marked, keys, pos, F.when(F.col("_is_header"), F.struct(text.alias("text"))), "_header")
    kept = found.filter(~F.col("_is_header") & F.col("_header").isNotNull())
    return kept.withColumn("header", F.col("_header.text")).drop("_is_header", "_header")


def attach_trailing_header(rows: DataFrame, keys: list[str], pos: str, is_header: Column, text: Column) -> DataFrame:
    """Give each non-header row the next header, else the last one, else the default."""
    marked = rows.withColumn("_is_header", is_header)
    found = nearest(marked, keys, pos, F.when(F.col("_is_header"), F.struct(text.alias("text"))), "_header", forward=True)
    kept = found.filter(~F.col("_is_header"))
    header = (
        F.when(F.col("_header").isNotNull(), F.col("_header.text"))
        .when(F.col("_header_last").isNotNull(), F.col("_header_last.text"))
        .otherwise(F.lit(DEFAULT_HEADER))
    )
    return kept.withColumn("header", header).drop("_is_header", "_header", "_header_last")


def document_order(rows: DataFrame, keys: list[str], pos: str, is_header: Column, out: str = "position") -> DataFrame:
    """0-based position among the siblings, headers not counted."""
    return running_row_number(rows, keys, pos, out, counted=~is_header)


def nest(items: DataFrame, keys: list[str], depth: int | None = None) -> DataFrame:
    """Header groups with items and their children to any depth, per page.

    ``items``: keys, header_pos, header (one row per group even if empty), then
    pos, id, text, type, is_expandable, menu_pos (position of the parent menu or
    null); pos is null for an empty group. The keys must name one page each: a
    page's items came from one row, so its groups fit one row again. Null keys and
    header positions are values like others. ``depth`` is the deepest level; where it is not
    given, one query finds it.
    """
    leaf = ["pos", "text", "id", "type", "is_expandable"]
    trees = _ordered_rows(items, keys, F.col("_rows.pos"))
    if depth is None:
        depth = trees.agg(F.max(F.array_max(F.transform("_tree.entries", lambda e: e["level"])))).first()[0]
    deepest = max(1, depth or 0)

    def children(first: Column, size: Column, level: int = 0) -> Column:
        here = F.filter(F.slice(F.col("_entries"), first + 1, size), lambda e: e["level"] == level)

        def entry(e: Column) -> Column:
            me = F.struct(*[e["item"][c].alias(c) for c in leaf])
            if level == deepest:
                return me
            return me.withField("children", F.when(e["item"]["type"] == "menu", children(e["at"] + 1, e["last"] - e["at"], level + 1)))

        return F.transform(here, entry)

    def group(g: Column) -> Column:
        row = F.get("_rows", g["row"])
        return F.struct(row["header_pos"].alias("header_pos"), row["header"].alias("header_text"), children(g["first"], g["size"]).alias("children"))

    entries = F.transform(
        "_tree.entries", lambda e, at: F.struct(F.get("_rows", e["row"]).alias("item"), e["level"].alias("level"), e["last"].alias("last"), at.alias("at"))
    )
    nested = trees.withColumn("_entries", entries).withColumn("structured_data", F.transform("_tree.groups", group))
    return nested.select(*keys, "structured_data")


def _ordered_rows(items: DataFrame, keys: list[str], places: Column) -> DataFrame:
    """One row a page: its items as ``_rows`` by header and position, and their pre-order as ``_tree``, see ``preorder``."""
    row = F.struct("header_pos", "pos", "text", "id", "type", "is_expandable", "header", "menu_pos")
    pages = items.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    of = [F.col("_rows.header_pos"), places, F.col("_rows.menu_pos")]
    return pages.withColumn("_tree", tree_order(*[c.cast("array<long>") for c in of]))


def flatten_items(items: DataFrame, keys: list[str]) -> DataFrame:
    """``flatten(nest(items))`` without the nested form: a page's items in pre-order, at any depth, from one ordering of the page.

    ``items`` as for ``nest``, with positions of zero or more. A bad row takes what is below it with it; below rows that are
    not open menus nothing is listed.
    """

    def place(r: Column) -> Column:
        is_open = (r["type"] == "menu") & r["is_expandable"]
        # A row without a place is left out; one that nothing refers to has no children.
        return F.when(rules.entry_valid(r["id"], r["text"], r["type"]), F.when(is_open, r["pos"]).otherwise(-1 - r["pos"]))

    trees = _ordered_rows(items, keys, F.transform("_rows", place))

    def row(e: Column) -> Column:
        i, up = F.get("_rows", e["row"]), F.get("_rows", F.get("_tree.entries", F.when(e["up"] >= 0, e["up"]))["row"])
        return F.struct(
            i["id"].alias("id"), clean_text(i["text"]).alias("text"), i["type"].alias("type"),
            F.coalesce(i["header"], F.lit("Unknown Header")).alias("header"), up["text"].alias("menu"),
            up["text"].alias("parent_menu_text"), e["level"].alias("level"),
        )

    return numbered_rows_of(trees, F.transform("_tree.entries", row), tuple(keys), "pos", "_i").select(*keys, "pos", "_i.*")


def item_paths(items: DataFrame, key: str, parent: str, text: str, levels: int = 1000) -> DataFrame:
    """The way to every row of an adjacency table: key, text, ``keys`` and ``texts`` of its ancestors, outermost first, and level.

    Rows whose parent is null are level 0. Rows that none of those leads to (a missing parent, a ring) have no path and drop
    out. ``levels`` bounds the recursion; deeper trees raise an error.
    """
    spark = items.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    rows = items.select(F.col(key).alias("key"), F.col(parent).alias("parent"), F.col(text).alias("text"))
    return spark.sql(
        f"""WITH RECURSIVE walk(key, text, keys, texts, level) MAX RECURSION LEVEL {int(levels)} AS (
  SELECT key, text, slice(array(key), 1, 0), slice(array(text), 1, 0), 0 FROM {{rows}} WHERE parent IS NULL
  UNION ALL
  SELECT r.key, r.text, array_append(w.keys, w.key), array_append(w.texts, w.text), w.level + 1
  FROM walk w JOIN {{rows}} r ON r.parent = w.key WHERE r.key <> w.key AND NOT array_contains(w.keys, r.key)
) SELECT * FROM walk""",
        rows=rows,
    )


def flat_children(paths: DataFrame) -> DataFrame:
    """Menu and item for every item of ``item_paths`` below a menu at any depth: menu, key, text, level (1 for direct children)."""
    each = paths.select(F.posexplode("keys").alias("at", "menu"), "key", "text", "level")
    return each.select("menu", "key", "text", (F.col("level") - F.col("at")).alias("level"))


def flatten(nested: DataFrame, keys: list[str]) -> DataFrame:
    """Nested groups of any depth back to a pre-order item list; a bad row takes its children with it."""

    def fine(i: Column) -> Column:
        return rules.entry_valid(i["id"], i["text"], i["type"])

    def row(i: Column, header: Column, menu: Column, level: int) -> Column:
        return F.struct(
            i["id"].alias("id"), clean_text(i["text"]).alias("text"), i["type"].alias("type"), header.alias("header"),
            menu.alias("menu"), menu.alias("parent_menu_text"), F.lit(level).alias("level"),
        )

    def branch(i: Column, header: Column, menu: Column, level: int, kind: T.StructType) -> Column:
        me = F.array(row(i, header, menu, level))
        if "children" not in kind.names:
            return me
        below = kind["children"].dataType.elementType
        open_menu = (i["type"] == "menu") & i["is_expandable"] & i["children"].isNotNull()
        kids = F.transform(F.filter(i["children"], fine), lambda c: branch(c, header, i["text"], level + 1, below))
        return F.when(open_menu, F.concat(me, F.flatten(kids))).otherwise(me)

    def group(g: Column) -> Column:
        header = F.coalesce(g["header_text"], F.lit("Unknown Header"))
        none = F.lit(None).cast("string")
        return F.flatten(F.transform(F.filter(g["children"], fine), lambda i: branch(i, header, none, 0, entries)))

    entries = nested.schema["structured_data"].dataType.elementType["children"].dataType.elementType
    items = F.flatten(F.transform(F.col("structured_data"), group))
    return numbered_rows_of(nested, items, tuple(keys), "pos", "_i").select(*keys, "pos", "_i.*")


def standard_item(items: DataFrame) -> DataFrame:
    """Five standard columns and the whole original record."""
    kind = F.coalesce(F.col("type"), F.lit("unknown")) if "type" in items.columns else F.lit("unknown")
    return items.select("id", "text", kind.alias("type"), "menu", "header", F.struct("*").alias("original_item"))
