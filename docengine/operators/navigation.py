"""Questions about the navigation of a page: menus, their ancestors, standalone pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions.page_index import locate, ranges_around
from docengine.functions.text import WS, let, strip
from docengine.operators.nodes import (
    DEFAULT,
    Profile,
    contains,
    first,
    has_class,
    inside,
    is_tag,
    numbered_rows_of,
    rows_of,
    text_content,
)
from docengine.operators.rules import contains_any

# Topics of standalone pages, and words of a page still loading.
STANDALONE_TOPICS = [
    "introduction", "getting started", "overview", "responses", "authentication", "authorization", "error codes",
    "examples", "volume management", "storage", "host", "protection", "replication", "system", "user management",
    "monitoring", "configuration", "api reference", "reference", "guide", "tutorial",
]
LOADING_WORDS = ["loading", "please wait", "processing", "fetching", "retrieving"]


def is_standalone(text: Column) -> Column:
    return F.coalesce(contains_any(text, STANDALONE_TOPICS), F.lit(False))


def _highlight(p: Profile):
    return lambda n: is_tag(n, "li") & has_class(n, p.highlight)


def _ranges(nodes: Column) -> tuple[Column, Column]:
    """First and last node of each range, for ``ranges_around``."""
    return F.transform(nodes, lambda n: n["node_id"]), F.transform(nodes, lambda n: n["last_id"])


def standalone_containers(parsed: DataFrame, keys: tuple[str, ...] = ("page_id",), profile: Profile = DEFAULT) -> DataFrame:
    """Distinct list entries that hold an element on one of the topics; of nested entries, the innermost."""
    nodes, lis = F.col("nodes"), F.col("_lis")
    labels = F.filter(nodes, lambda n: is_tag(n, "div", "span"))
    hits = F.transform(F.filter(labels, lambda n: is_standalone(text_content(nodes, n))), lambda n: n["node_id"])
    found = parsed.withColumn("_lis", F.filter(nodes, _highlight(profile)))
    found = found.withColumn("_around", ranges_around(*_ranges(lis), hits))
    owners = F.array_distinct(F.transform(F.filter("_around", lambda r: F.size(r) > 0), lambda r: F.element_at(r, -1)))
    containers = F.transform(
        owners, lambda k: let(F.get(lis, k), lambda li: F.struct(li["node_id"].alias("li"), text_content(nodes, li).alias("text")))
    )
    return rows_of(found, containers, keys, "li")


def collapsed_menus(parsed: DataFrame, keys: tuple[str, ...] = ("page_id",), profile: Profile = DEFAULT) -> DataFrame:
    """Closed icons in list entries without an id, with menu text and 0-based index."""
    p, nodes = profile, F.col("nodes")

    def label(li: Column) -> Column:
        tests = F.filter(
            inside(nodes, li), lambda n: is_tag(n, "span", "div")
        )
        texts = F.transform(tests, lambda n: text_content(nodes, n))
        return F.coalesce(first(F.filter(texts, lambda t: F.length(t) > 1)), F.lit("Unknown Menu"))

    def menus(lis: Column) -> Column:
        icons = F.filter(
            nodes,
            lambda n: is_tag(n, "i")
            & has_class(n, p.closed_icon)
            & F.exists(lis, lambda o: contains(o, n) & o["dom_id"].isNull()),
        )
        return F.transform(icons, lambda n: label(F.element_at(F.filter(lis, lambda o: contains(o, n)), -1)))

    return numbered_rows_of(parsed, let(F.filter(nodes, _highlight(p)), menus), keys, "index", "menu_text")


def menu_by_text(parsed: DataFrame, text: str | list[str], keys: tuple[str, ...] = ("page_id",), profile: Profile = DEFAULT) -> DataFrame:
    """List entries with a div of exactly this text (or one of these), and whether they are open or closed.

    Quotes of either kind in the wanted text count as double quotes.
    """
    p, nodes = profile, F.col("nodes")
    wanted = [t.replace("'", '"') for t in ([text] if isinstance(text, str) else text)]

    def names(li: Column) -> Column:
        """The wanted texts that the divs of an entry have."""
        divs = F.filter(inside(nodes, li), lambda n: is_tag(n, "div"))
        return F.array_distinct(F.filter(F.transform(divs, lambda n: text_content(nodes, n)), lambda t: t.isin(*wanted)))

    def icon(li: Column, name: str) -> Column:
        return F.exists(inside(nodes, li), lambda n: is_tag(n, "i") & has_class(n, name))

    def row(name: Column, li: Column) -> Column:
        opened, closed = icon(li, p.opened_icon), icon(li, p.closed_icon)
        return F.struct(
            name.alias("menu_text"), li["node_id"].alias("node_id"), opened.alias("is_expanded"), (~opened & closed).alias("is_collapsed")
        )

    entries = F.filter(nodes, lambda n: F.coalesce(is_tag(n, "li") & n["attrs"]["class"].contains("toc-item"), F.lit(False)))
    found = F.flatten(F.transform(entries, lambda li: F.transform(names(li), lambda name: row(name, li))))
    return rows_of(parsed, found, keys)


def _target(nodes: Column, item_id: Column, text: Column) -> Column:
    """The element with the id, else the first list entry whose text holds ``text``."""
    by_id = first(F.filter(nodes, lambda n: n["dom_id"] == item_id))

    def named(n: Column) -> Column:
        return is_tag(n, "li") & F.coalesce(text_content(nodes, n).contains(text), F.lit(False))

    return let(by_id, lambda t: F.when(t.isNotNull(), t).otherwise(first(F.filter(nodes, named))))


def _labelled_menus(nodes: Column, p: Profile) -> Column:
    """Menus of a page with their labels, outermost first; found once, however many targets there are."""

    def is_menu(n: Column) -> Column:
        icon = F.exists(inside(nodes, n), lambda c: is_tag(c, "i") & c["attrs"]["class"].contains("chevron"))
        return is_tag(n, "li") & F.exists(n["classes"], lambda c: c.isin(*p.menu_classes)) & icon

    def labelled(menu: Column) -> Column:
        label = first(F.filter(inside(nodes, menu), lambda n: is_tag(n, "div") & (n["sib_idx"] == 0)))
        return F.struct(menu["node_id"].alias("node_id"), menu["last_id"].alias("last_id"), text_content(nodes, label).alias("label"))

    menus = F.filter(nodes, lambda n: F.coalesce(is_menu(n), F.lit(False)))
    return F.filter(F.transform(menus, labelled), lambda m: F.coalesce(m["label"] != "", F.lit(False)))


def _ancestor_texts(menus: Column, target: Column) -> Column:
    return F.transform(F.filter(menus, lambda m: contains(m, target)), lambda m: m["label"])


def ancestor_menus(parsed: DataFrame, item_id: Column, text: Column, out: str = "ancestors", profile: Profile = DEFAULT) -> DataFrame:
    """Texts of the menus around a target, outermost first; empty if it is not found."""
    nodes = F.col("nodes")
    target = _target(nodes, item_id, text)
    texts = let(target, lambda t: F.when(t.isNotNull(), _ancestor_texts(_labelled_menus(nodes, profile), t)))
    return parsed.withColumn(out, F.coalesce(texts, F.array().cast("array<string>")))


def all_ancestor_menus(parsed: DataFrame, keys: tuple[str, ...] = ("page_id",), profile: Profile = DEFAULT) -> DataFrame:
    """The same for every list entry with an id."""
    nodes = F.col("nodes")
    targets = F.filter(nodes, lambda n: _highlight(profile)(n) & n["dom_id"].isNotNull())
    rows = let(
        _labelled_menus(nodes, profile),
        lambda menus: F.transform(
            targets, lambda t: F.struct(t["dom_id"].alias("item_id"), _ancestor_texts(menus, t).alias("ancestors"))
        ),
    )
    return rows_of(parsed, rows, keys, "item_id")


def _with_closed_menus(parsed: DataFrame, p: Profile) -> DataFrame:
    """``_menus``: closed menus without an id, in document order, with their label and the XPath of their icon."""
    nodes = F.col("nodes")

    def icon(menu: Column) -> Column:
        return first(F.filter(inside(nodes, menu), lambda n: is_tag(n, "i") & has_class(n, p.closed_icon)))

    def label(menu: Column) -> Column:
        found = first(F.filter(inside(nodes, menu), lambda n: is_tag(n, "div") & has_class(n, *p.menu_text[:2])))
        return let(found, lambda d: F.when(d.isNull(), F.lit("Unknown Menu")).otherwise(text_content(nodes, d)))

    def menu(n: Column) -> Column:
        return F.struct(n["node_id"].alias("node_id"), n["last_id"].alias("last_id"), icon(n)["node_id"].alias("icon"), label(n).alias("menu_text"))

    entries = F.filter(nodes, lambda n: _highlight(p)(n) & n["dom_id"].isNull())
    menus = F.filter(F.transform(entries, menu), lambda m: m["icon"].isNotNull())
    elements = F.filter(nodes, lambda n: ~n["tag"].startswith("#"))
    marked = parsed.withColumn("_menus", menus).withColumn("_elements", elements)
    icons = F.transform("_menus", lambda m: m["icon"])
    marked = marked.withColumn("_above", ranges_around(*_ranges(F.col("_elements")), icons))

    def step(n: Column) -> Column:
        return F.concat(F.lit("/"), n["tag"], F.lit("["), n["tag_ord"].cast("string"), F.lit("]"))

    def xpath(m: Column, above: Column) -> Column:
        outer = F.array_join(F.transform(above, lambda k: step(F.get("_elements", k))), "")
        return F.concat(outer, step(F.get(nodes, m["icon"])))

    placed = F.zip_with("_menus", "_above", lambda m, a: F.struct(*[m[c].alias(c) for c in ("node_id", "last_id", "menu_text")], xpath(m, a).alias("xpath")))
    return marked.withColumn("_menus", placed).drop("_elements", "_above")


def _with_paths(parsed: DataFrame, targets: Column, p: Profile) -> DataFrame:
    """``_paths``: (item_id, found, expansions) of each target, an array of (item_id, text)."""
    nodes = F.col("nodes")
    named = F.filter(nodes, lambda n: _highlight(p)(n) & n["dom_id"].isNotNull())
    entries = F.transform(named, lambda n: F.struct(n["node_id"].alias("node_id"), text_content(nodes, n).alias("text")))
    wanted = F.transform(targets, lambda t: F.struct(t["item_id"].alias("id"), t["text"].alias("text")))
    rows = _with_closed_menus(parsed, p).withColumn("_entries", entries).withColumn("_targets", wanted)
    ids, texts = F.transform(nodes, lambda n: n["dom_id"]), F.transform("_entries", lambda e: e["text"])
    rows = rows.withColumn("_places", locate(ids, texts, F.col("_targets")))
    at = F.transform("_places", lambda x: F.coalesce(x["by_id"], F.get("_entries", x["by_text"])["node_id"]))
    rows = rows.withColumn("_at", at).withColumn("_around", ranges_around(*_ranges(F.col("_menus")), F.col("_at")))

    def path(t: Column, around: Column) -> Column:
        steps = F.transform(F.transform(around, lambda k: F.get("_menus", k)), lambda m: F.struct(m["menu_text"].alias("menu_text"), m["xpath"].alias("xpath")))
        return F.struct(t["id"].alias("item_id"), around.isNotNull().alias("found"), steps.alias("expansions"))

    return rows.withColumn("_paths", F.zip_with("_targets", "_around", path)).drop("_menus", "_entries", "_targets", "_places", "_at", "_around")


def expansion_path(
    parsed: DataFrame, item_id: Column, text: Column, out: str = "path", profile: Profile = DEFAULT, each: str | None = None
) -> DataFrame:
    """Closed menus without an id around a target, outermost first, with icon XPaths.

    The target is the first element with the id, else the first list entry with an id whose text holds ``text``.
    ``each`` names an array column with the targets of a page, of which ``item_id`` and ``text`` are then arrays; each of its
    elements becomes a row, without the nodes. So a page is parsed and swept once, and never copied for its targets.
    """
    if each is None:
        one = F.array(F.struct(item_id.cast("string").alias("item_id"), text.cast("string").alias("text")))
        found = _with_paths(parsed, one, profile)
        return found.withColumn(out, let(F.get("_paths", F.lit(0)), _path_of)).drop("_paths")
    pairs = F.zip_with(item_id, text, lambda i, t: F.struct(i.cast("string").alias("item_id"), t.cast("string").alias("text")))
    found = _with_paths(parsed, pairs, profile)
    rows = F.zip_with(each, "_paths", lambda target, path: F.struct(target.alias("target"), _path_of(path).alias("path")))
    kept = [c for c in parsed.columns if c not in (each, "nodes")]
    # Outer, as in ``rows_of``; a page without targets has no rows.
    placed = found.select(*kept, F.inline_outer(rows).alias(each, out))
    return placed.filter(F.col(out).isNotNull())


def _path_of(found: Column) -> Column:
    return F.struct(found["found"].alias("found"), found["expansions"].alias("expansions"))


def expansion_paths(parsed: DataFrame, targets: Column, keys: tuple[str, ...] = ("page_id",), profile: Profile = DEFAULT) -> DataFrame:
    """The same for many targets of a page, an array of (item_id, text): one row each.

    Ids are looked up in a map, menus around all targets come from one sweep over the page.
    """
    return rows_of(_with_paths(parsed, targets, profile), F.col("_paths"), keys, "found")


def visible_text(html: Column) -> Column:
    """Text of raw HTML without a parser: comments, scripts, styles and tags out, white space squeezed."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<[^>]*>", " ")
    return strip(F.regexp_replace(bare, f"[{WS}]+", " "))


def content_ready(html: Column) -> Column:
    """Enough HTML, enough text, and no sign of loading."""
    ready = let(
        visible_text(html), lambda t: (F.length(t) >= 50) & ~contains_any(t, LOADING_WORDS)
    )
    return F.coalesce((F.length(strip(html)) >= 100) & ready, F.lit(False))
