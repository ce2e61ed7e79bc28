"""Registered queries over pages: nodes, entries, navigation, content, publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from docengine.functions import html as H
from docengine.functions import text as X
from docengine.operators import content, navigation, nodes, resume, rules, tree
from docengine.plans import bindings as B
from docengine.plans import sql_parts as S
from docengine.plans.queries_text import sanitized_ctes
from docengine.plans.registry import query
from docengine.session import work_dir
from docengine.sources import readers, writers

col = F.col
_PLACED = f"WITH {B.PLACED_SQL}"
TITLE_SQL = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"


def pages(spark, d, *columns):
    return readers.scan_pages(spark, f"{d}/pages.parquet", columns=columns or ("page_id", "html"))


def stored_nodes(spark, d):
    return nodes.with_nodes(pages(spark, d))


def sidebar_nodes(spark, d):
    return nodes.with_nodes(B.sidebar_pages(spark, d))


def sidebar_entries(spark, d):
    return tree.with_entries(sidebar_nodes(spark, d))


def entry_rows(spark, d):
    return tree.entry_rows(sidebar_entries(spark, d))


# --- the flagship: a publish manifest -------------------------------------------------

_HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"


@query(
    "publish_manifest",
    f"""WITH r AS (SELECT page_id, {_HOST} AS host, {S.clean(TITLE_SQL)} AS title, html FROM pages WHERE length(html) > 0),
p AS (SELECT page_id, host, title, {S.path('host', 'NULL::VARCHAR', 'title')} AS output_path, length(html)::INTEGER AS content_length, sha256(html) AS sha256 FROM r)
SELECT * FROM p WHERE NOT (contains(output_path, '..') OR contains(output_path, '~') OR contains(output_path, '//'))""",
)
def publish_manifest(spark, d):
    """Where each stored page would be published, under which checksum; unsafe paths left out."""
    read = readers.scan_pages(spark, f"{d}/pages.parquet", columns=("page_id", "url", "html"))
    named = read.select(
        "page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
        X.clean_text(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title"), "html",
    )
    manifest = named.select(
        "page_id", "host", "title",
        X.output_path(col("host"), F.lit(None).cast("string"), col("title")).alias("output_path"),
        X.content_length(col("html")).alias("content_length"), X.checksum(col("html")).alias("sha256"),
    )
    return manifest.filter(rules.path_safe(col("output_path")))


@query("s1_scan_pages", "SELECT page_id, url, sha256(html) AS sha256 FROM pages WHERE length(html) > 0")
def s1(spark, d):
    return pages(spark, d, "page_id", "url", "html").select("page_id", "url", X.checksum(col("html")).alias("sha256"))


# --- nodes of the stored pages -----------------------------------------------------------


@query(
    "h1_html_nodes",
    """SELECT page_id, lower(t) AS tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS t FROM pages)
GROUP BY ALL""",
)
def h1(spark, d):
    return nodes.html_nodes(stored_nodes(spark, d)).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "h9_link_href",
    """SELECT page_id, (i - 1)::INTEGER AS link_pos, hrefs[i] AS href FROM (
 SELECT page_id, hrefs, unnest(generate_series(1, length(hrefs))) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages))""",
)
def h9(spark, d):
    return nodes.link_href(stored_nodes(spark, d))


# The entities the stored pages use.
ENTITIES = [("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", "\xa0"), ("amp", "&")]


def _decoded(text: str) -> str:
    """Entities to characters; titles are cut, and HTML reads these without their semicolon too."""
    for entity, char in ENTITIES:
        text = S.sub(text, f"&{entity};?", char)
    return text


def _tag_text(tag: str) -> str:
    return S.strip(_decoded(f"regexp_extract(html, '(?s)<{tag}>(.*?)</{tag}>', 1)"))


@query(
    "h1_html_elements",
    """SELECT page_id, tag, ascii_text AS text, count(*) AS n FROM (
 SELECT page_id, tag, regexp_replace(strip_accents(replace(text, chr(160), ' ')), '[^\\x{0}-\\x{7f}]', '', 'g') AS ascii_text FROM (
  SELECT page_id, tag, """
    + S.strip(_decoded("raw"))
    + """ AS text FROM (
   SELECT page_id, 'title' AS tag, unnest(regexp_extract_all(html, '(?s)<title>(.*?)</title>', 1)) AS raw FROM pages
   UNION ALL SELECT page_id, 'h1', unnest(regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1)) FROM pages))) GROUP BY ALL""",
)
def h1_elements(spark, d):
    """The table function and the folding function, from SQL."""
    H.register(spark)
    return spark.sql(
        """SELECT p.page_id, e.tag, ascii_fold(e.own_text) AS text, count(*) AS n
 FROM {pages} p, LATERAL html_elements(p.html) e WHERE e.tag IN ('title', 'h1') GROUP BY ALL""",
        pages=pages(spark, d),
    )


@query("c15_text_content", f"SELECT page_id, {_tag_text('title')} AS title, {_tag_text('h1')} AS h1 FROM pages")
def c15(spark, d):
    return nodes.first_tag_text(stored_nodes(spark, d), ["title", "h1"])


# --- selections on navigation pages ----------------------------------------------------------


# Selections given as text, over the pages of all shapes.
_H2_TEXTS = {
    "highlight_li_with_id": "li.toc-item-highlight[id]",
    "item_text_span": "span[id$='-sp']",
    "highlight_closed_icon": "li.toc-item-highlight i.dds__icon--chevron-right",
    "direct": "div.filter-api-sidebar-wrapper > ul > app-api-doc-item > li[id^='cust-']",
    "listed_without_id": "ul ul app-api-doc-item li:not([id])",
    "inner": "li li[id], ul ul li[id]",
    "icons": "li:not(.toc-item-divider) > div > i[class*=chevron]:not(.dds__icon--chevron-down)",
}


@query(
    "h2_select_nodes",
    _PLACED
    + """, menus AS (SELECT DISTINCT page_id, n_nationkey, n_name FROM placed)
SELECT page_id, s AS selector, 'cust-' || c_custkey AS name FROM placed, (VALUES ('highlight_li_with_id')) v(s) WHERE has_id
UNION ALL SELECT page_id, 'item_text_span', 'cust-' || c_custkey || '-sp' FROM placed WHERE has_id
UNION ALL SELECT page_id, s, n_name FROM menus, (VALUES ('highlight_closed_icon'), ('icons')) v(s) WHERE n_nationkey % 5 <> 0
UNION ALL SELECT page_id, 'direct', 'cust-' || c_custkey FROM placed WHERE has_id AND shape = 1
UNION ALL SELECT page_id, 'listed_without_id', label FROM placed WHERE NOT has_id AND shape IN (0, 3)
UNION ALL SELECT page_id, 'inner', 'cust-' || c_custkey FROM placed WHERE has_id AND shape <> 1""",
)
def h2(spark, d):
    found = nodes.select_all(sidebar_nodes(spark, d), named=_H2_TEXTS)
    return found.select("page_id", "selector", F.coalesce("dom_id", "text").alias("name"))


# The rows of every named selection. No navigation page holds links, a loader, a content pane or tab panels.
_PLAIN = "CASE WHEN has_id THEN 'cust-' || c_custkey ELSE label END"
_H2_ALL = (
    _PLACED
    + f""", menus AS (SELECT DISTINCT page_id, shape, n_nationkey, n_name FROM placed), heads AS (SELECT DISTINCT page_id, r_name FROM placed),
tops AS (SELECT page_id, CASE WHEN shape = 1 THEN (array_agg(label ORDER BY r_regionkey, c_custkey))[1]
  ELSE (array_agg(r_name ORDER BY r_regionkey))[1] END AS name FROM placed WHERE shape <> 3 GROUP BY page_id, shape),
lis AS (SELECT page_id, has_id, {_PLAIN} AS name FROM placed UNION ALL SELECT page_id, false, n_name FROM menus),
icons AS (SELECT page_id, n_nationkey % 5 = 0 AS opened, n_name AS name FROM menus)
SELECT page_id, 'sidebar_container' AS selector, name FROM tops UNION ALL SELECT page_id, 'sidebar_root', name FROM tops
UNION ALL SELECT page_id, 'entry', r_name FROM heads UNION ALL SELECT page_id, 'entry', n_name FROM menus
UNION ALL SELECT page_id, 'entry', label FROM placed WHERE shape <> 2
UNION ALL SELECT page_id, s, r_name FROM heads, (VALUES ('header_li'), ('anchor')) v(s)
UNION ALL SELECT page_id, s, name FROM lis, (VALUES ('highlight_li'), ('clickable_li')) v(s)
UNION ALL SELECT page_id, CASE WHEN has_id THEN 'highlight_li_with_id' ELSE 'highlight_li_without_id' END, name FROM lis
UNION ALL SELECT page_id, 'item_text_span', 'cust-' || c_custkey || '-sp' FROM placed WHERE has_id
UNION ALL SELECT page_id, 'menu_text_div', n_name FROM menus
UNION ALL SELECT page_id, s, name FROM icons, (VALUES ('closed_icon'), ('highlight_closed_icon')) v(s) WHERE NOT opened
UNION ALL SELECT page_id, 'opened_icon', name FROM icons WHERE opened"""
)


@query("h2_select_nodes_all", _H2_ALL)
def h2_all(spark, d):
    found = nodes.select_all(sidebar_nodes(spark, d))
    return found.select("page_id", "selector", F.coalesce("dom_id", "text").alias("name"))


@query("h3_find_root", _PLACED + " SELECT DISTINCT page_id, 'ul' AS tag, 1 AS depth FROM placed WHERE shape <> 3")
def h3(spark, d):
    return nodes.find_root(sidebar_nodes(spark, d)).select("page_id", "tag", "depth")


@query("h4_header_info", _PLACED + " SELECT DISTINCT page_id, r_name AS header_text FROM placed")
def h4(spark, d):
    return entry_rows(spark, d).filter("has_divider").select("page_id", col("divider_text").alias("header_text"))


_ENTRIES = _PLACED + """, e AS (SELECT page_id, label AS text, CASE WHEN has_id THEN 'cust-' || c_custkey END AS id, false AS is_expandable, shape FROM placed WHERE shape <> 2
UNION ALL SELECT DISTINCT page_id, n_name, NULL, true, shape FROM placed)"""


@query("h5_is_expandable", _ENTRIES + " SELECT page_id, text, is_expandable FROM e")
def h5(spark, d):
    return entry_rows(spark, d).filter("has_li").select("page_id", "text", col("is_menu").alias("is_expandable"))


@query("h6_item_id", _ENTRIES + " SELECT page_id, text, coalesce(id, 'none') AS id FROM e")
def h6(spark, d):
    return entry_rows(spark, d).filter("has_li").select("page_id", "text", F.coalesce("id", F.lit("none")).alias("id"))


@query("h7_item_text", _ENTRIES + " SELECT page_id, CASE WHEN is_expandable THEN 'menu' ELSE 'item' END AS type, text FROM e")
def h7(spark, d):
    kind = F.when(col("is_menu"), F.lit("menu")).otherwise(F.lit("item"))
    return entry_rows(spark, d).filter("has_li").select("page_id", kind.alias("type"), "text")


@query("h8_child_text", _ENTRIES + " SELECT page_id, id, text AS child_text FROM e WHERE id IS NOT NULL")
def h8(spark, d):
    return entry_rows(spark, d).filter("has_li AND id IS NOT NULL").select("page_id", "id", "child_text")


_PAGE_COUNTS = """, c AS (SELECT page_id, count(DISTINCT r_regionkey) AS headers, count(*) FILTER (has_id) AS with_id,
 count(*) FILTER (NOT has_id) + count(DISTINCT n_nationkey) AS without_id, count(DISTINCT n_nationkey) FILTER (n_nationkey % 5 <> 0) AS closed_menus
 FROM placed GROUP BY page_id)"""


@query(
    "h10_structure_type",
    _PLACED
    + _PAGE_COUNTS
    + """ SELECT page_id, headers::INTEGER AS headers, with_id::INTEGER AS with_id, without_id::INTEGER AS without_id, closed_menus::INTEGER AS closed_menus,
 CASE WHEN without_id > with_id AND headers > 0 THEN 'flat_with_trailing_header' ELSE 'hierarchical_with_leading_header' END AS structure FROM c""",
)
def h10(spark, d):
    counts = nodes.structure_counts(sidebar_nodes(spark, d))
    kind = nodes.structure_type(col("headers"), col("with_id"), col("without_id"))
    return counts.select("page_id", "headers", "with_id", "without_id", "closed_menus", kind.alias("structure"))


@query(
    "h11_structure_type_live",
    _PLACED
    + _PAGE_COUNTS
    + """ SELECT page_id, closed_menus::INTEGER AS expanders, CASE WHEN without_id > with_id AND closed_menus > 0 THEN 'flat_with_trailing_header'
 WHEN headers > 0 AND with_id > without_id THEN 'hierarchical_with_leading_header' ELSE 'mixed' END AS structure FROM c""",
)
def h11(spark, d):
    counts = nodes.structure_counts(sidebar_nodes(spark, d))
    kind = nodes.structure_type_live(*[col(c) for c in ("headers", "with_id", "without_id", "expanders")])
    return counts.select("page_id", "expanders", kind.alias("structure"))


@query(
    "h12_needs_expansion",
    _PLACED + _PAGE_COUNTS + " SELECT page_id, with_id::INTEGER AS leaf_items, with_id > 5 OR closed_menus > 3 AS needed FROM c",
)
def h12(spark, d):
    counts = nodes.structure_counts(sidebar_nodes(spark, d))
    needed = nodes.needs_expansion(col("leaf_items"), col("closed_menus"))
    return counts.select("page_id", "leaf_items", needed.alias("needed"))


@query(
    "h13_collapsed_menus",
    _PLACED
    + """, m AS (SELECT DISTINCT page_id, r_regionkey, n_nationkey, n_name FROM placed WHERE n_nationkey % 5 <> 0)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY r_regionkey, n_nationkey) - 1)::INTEGER AS index, n_name AS menu_text FROM m""",
)
def h13(spark, d):
    return navigation.collapsed_menus(sidebar_nodes(spark, d))


@query(
    "h14_nested_items",
    _PLACED + " SELECT page_id, n_name AS menu, 'cust-' || c_custkey AS id, label AS text FROM placed WHERE shape = 2 AND has_id",
)
def h14(spark, d):
    rows = entry_rows(spark, d).filter("is_menu")
    return rows.select("page_id", col("text").alias("menu"), F.explode("nested").alias("n")).select(
        "page_id", "menu", "n.id", "n.text"
    )


# --- the tree ---------------------------------------------------------------------------------


@query(
    "t3_menu_children",
    _PLACED
    + """ SELECT page_id, n_name AS menu, label AS text, coalesce(CASE WHEN has_id THEN 'cust-' || c_custkey END, 'none') AS id FROM placed WHERE shape IN (0, 3)""",
)
def t3(spark, d):
    rows = entry_rows(spark, d).filter(col("parent_entry").isNotNull())
    return rows.select("page_id", col("parent_text").alias("menu"), "text", F.coalesce("id", F.lit("none")).alias("id"))


@query(
    "t4_children_hier",
    _PLACED + " SELECT page_id, n_name AS menu, 'cust-' || c_custkey AS id, label AS text, 'item' AS type FROM placed WHERE shape = 0 AND has_id AND label <> 'Overview'",
)
def t4(spark, d):
    items = tree.page_items(sidebar_entries(spark, d), nodes.HIERARCHICAL)
    return items.filter(col("menu").isNotNull()).select("page_id", "menu", "id", "text", "type")


@query(
    "t5_children_flat",
    _PLACED + " SELECT page_id, n_name AS menu, 'cust-' || c_custkey AS id, label AS text, 1 AS level FROM placed WHERE shape IN (0, 2) AND has_id AND label <> 'Overview'",
)
def t5(spark, d):
    items = tree.page_items(sidebar_entries(spark, d), nodes.FLAT)
    return items.filter(col("menu").isNotNull()).select("page_id", "menu", "id", "text", "level")


@query(
    "t7_parse_entry_hier",
    _PLACED
    + """, r AS (SELECT *, dense_rank() OVER (PARTITION BY page_id ORDER BY r_regionkey) AS k FROM placed WHERE shape <> 3),
h AS (SELECT DISTINCT page_id, r_regionkey, r_name, k FROM r),
e AS (SELECT DISTINCT page_id, shape, k, n_name AS text, NULL AS id, 'menu' AS type FROM r
  UNION ALL SELECT page_id, shape, k, label, 'cust-' || c_custkey, 'item' FROM r WHERE shape = 1 AND has_id AND label <> 'Overview')
SELECT e.page_id, text, coalesce(id, 'none') AS id, type, h.r_name AS header FROM e JOIN h
  ON e.page_id = h.page_id AND h.k = CASE WHEN e.shape = 1 THEN e.k - 1 ELSE e.k END""",
)
def t7(spark, d):
    items = tree.page_items(sidebar_entries(spark, d), nodes.HIERARCHICAL).filter("level = 0")
    return items.select("page_id", "text", F.coalesce("id", F.lit("none")).alias("id"), "type", "header")


_SYNTH = "'synthetic-get-customer' || lpad(c_custkey::VARCHAR, 9, '0')"
_T10 = (
    _PLACED
    + f"""
, rows AS (
  SELECT page_id, r_regionkey, n_nationkey, -1 AS k, NULL::VARCHAR AS id, n_name AS text, 'menu' AS type, r_name AS header, NULL::VARCHAR AS menu, 0 AS level
  FROM placed WHERE shape IN (0, 2) GROUP BY ALL
  UNION ALL
  SELECT page_id, r_regionkey, n_nationkey, c_custkey, 'cust-' || c_custkey, label, 'item', r_name, n_name, 1 FROM placed
  WHERE shape = 0 AND has_id AND label <> 'Overview'
  UNION ALL
  SELECT page_id, r_regionkey, -1, c_custkey, CASE WHEN has_id THEN 'cust-' || c_custkey ELSE {_SYNTH} END, label, 'item', r_name, NULL, 0 FROM placed
  WHERE shape = 1 AND label <> 'Overview' AND (has_id OR starts_with(label, 'Get '))
  UNION ALL
  SELECT DISTINCT page_id, r_regionkey, n_nationkey, -1, NULL, n_name, 'menu', r_name, NULL, 0 FROM placed WHERE shape = 1
)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY r_regionkey, n_nationkey, k) - 1)::INTEGER AS pos,
  id, text, type, header, menu, menu AS parent_menu_text, level FROM rows"""
)


@query("t10_parse_pipeline", _T10)
def t10(spark, d):
    return tree.parse_sidebar(B.sidebar_pages(spark, d))


@query(
    "u1_distinct_containers",
    _PLACED + " SELECT page_id, label AS text FROM placed WHERE label = 'Overview'",
)
def u1(spark, d):
    return navigation.standalone_containers(sidebar_nodes(spark, d)).select("page_id", "text")


# --- navigation -------------------------------------------------------------------------------------


@query(
    "n1_menu_by_text",
    _PLACED
    + """ SELECT DISTINCT page_id, n_name AS menu_text, n_nationkey % 5 = 0 AS is_expanded, n_nationkey % 5 <> 0 AS is_collapsed
FROM placed WHERE n_name IN ('NATION_3', 'NATION_5')""",
)
def n1(spark, d):
    return navigation.menu_by_text(sidebar_nodes(spark, d), ["NATION_3", "NATION_5"]).drop("node_id")


@query(
    "n4_ancestor_menus",
    _PLACED + " SELECT page_id, 'cust-' || c_custkey AS item_id, CASE WHEN shape = 2 THEN n_name ELSE '' END AS path FROM placed WHERE has_id",
)
def n4(spark, d):
    found = navigation.all_ancestor_menus(sidebar_nodes(spark, d))
    return found.select("page_id", "item_id", F.array_join("ancestors", " > ").alias("path"))


_N5 = """, places AS (SELECT DISTINCT page_id, r_regionkey, n_nationkey FROM placed),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY r_regionkey, n_nationkey) + dense_rank() OVER (PARTITION BY page_id ORDER BY r_regionkey) AS entry FROM places),
s AS (SELECT p.*, k.entry, p.shape = 2 AND p.n_nationkey % 5 <> 0 AND p.has_id AS closed FROM placed p JOIN k USING (page_id, r_regionkey, n_nationkey))"""


@query(
    "n5_expansion_path",
    _PLACED
    + _N5
    + """ SELECT page_id, c_custkey, has_id AS found, CASE WHEN closed THEN n_name ELSE '' END AS menus,
  CASE WHEN closed THEN '/div[1]/ul[1]/app-api-doc-item[' || entry || ']/li[1]/div[1]/i[1]' ELSE '' END AS xpaths FROM s""",
)
def n5(spark, d):
    """One target a row: every item with the page that holds it."""
    target = F.struct("c_custkey", "c_name")
    targets = B.placed_customers(spark, d).groupBy("page_id").agg(F.collect_list(target).alias("target"))
    ids = F.transform("target", lambda t: F.concat(F.lit("cust-"), t["c_custkey"].cast("string")))
    parsed = nodes.with_nodes(B.sidebar_pages(spark, d).join(targets, "page_id"))
    found = navigation.expansion_path(parsed, ids, F.transform("target", lambda t: t["c_name"]), each="target")
    steps = F.coalesce(col("path.expansions"), F.array().cast("array<struct<menu_text:string,xpath:string>>"))
    return found.select(
        "page_id", "target.c_custkey", col("path.found").alias("found"), F.array_join(F.transform(steps, lambda s: s["menu_text"]), " > ").alias("menus"),
        F.array_join(F.transform(steps, lambda s: s["xpath"]), " > ").alias("xpaths"),
    )


@query(
    "n5_expansion_path_all",
    _PLACED
    + _N5
    + """ SELECT page_id, 'cust-' || c_custkey AS item_id, has_id AS found, CASE WHEN closed THEN n_name ELSE '' END AS menus,
  CASE WHEN closed THEN '/div[1]/ul[1]/app-api-doc-item[' || entry || ']/li[1]/div[1]/i[1]' ELSE '' END AS xpaths FROM s""",
)
def n5_all(spark, d):
    """The path of every item of a page, those without an id included."""
    item = F.struct(F.concat(F.lit("cust-"), col("c_custkey").cast("string")).alias("item_id"), col("c_name").alias("text"))
    targets = B.placed_customers(spark, d).groupBy("page_id").agg(F.collect_list(item).alias("targets"))
    found = navigation.expansion_paths(nodes.with_nodes(B.sidebar_pages(spark, d).join(targets, "page_id")), col("targets"))
    steps = F.coalesce(col("expansions"), F.array().cast("array<struct<menu_text:string,xpath:string>>"))
    return found.select(
        "page_id", "item_id", "found", F.array_join(F.transform(steps, lambda s: s["menu_text"]), " > ").alias("menus"),
        F.array_join(F.transform(steps, lambda s: s["xpath"]), " > ").alias("xpaths"),
    )


# --- content ------------------------------------------------------------------------------------------


def endpoint_nodes(spark, d):
    return nodes.with_nodes(B.endpoint_pages(spark, d))


def endpoint_content(spark, d):
    return content.with_content(B.endpoint_pages(spark, d))


_SHAPED = f"WITH shaped AS (SELECT *, p_partkey AS page_id, {B.SHAPE_EXPR} AS shape FROM part)"
_EP = f"{_SHAPED}, ep AS (SELECT * FROM shaped WHERE shape = 'endpoint')"


@query(
    "c1_content_strategy",
    f"{_SHAPED} SELECT 'part' AS kind, page_id, shape AS strategy FROM shaped UNION ALL SELECT 'stored', page_id, 'fallback' FROM pages",
)
def c1(spark, d):
    parts = content.with_strategy(endpoint_nodes(spark, d)).select(F.lit("part").alias("kind"), "page_id", "strategy")
    stored = content.with_strategy(stored_nodes(spark, d)).select(F.lit("stored").alias("kind"), "page_id", "strategy")
    return parts.unionByName(stored)


_C2 = "'### ' || CASE WHEN p_size % 4 = 0 THEN '' ELSE 'GET ' END || p_name || CASE WHEN p_size % 3 = 0 THEN ' Try It' ELSE '' END"
_C3 = "'```' || chr(10) || '/parts/' || p_partkey || chr(10) || '```'"
_C4 = "CASE p_size % 7 WHEN 0 THEN NULL WHEN 1 THEN '/parts/' || p_partkey WHEN 2 THEN '/parts/' || p_partkey ELSE 'Part of type' || p_type || '.' END"
_C5 = "'## Security' || chr(10) || chr(10) || 'Key of *' || p_brand || '*'"
_C6 = "'https://' || p_type || '.example'"
_C7 = "'#### Path **id**' || chr(10) || chr(10) || '* id' || chr(10) || '* size ' || p_size || chr(10) || chr(10) || 'page  ' || chr(10) || 'limit'"
_C8 = "'```' || chr(10) || '{\"size\": ' || p_size || '}' || chr(10) || '```'"
_C9 = (
    "CASE WHEN p_size % 5 = 0 THEN 'plain' ELSE '### Response 200' || chr(10) || chr(10) || '| name | size |' || chr(10) || '| --- | --- |' || chr(10)"
    " || '| ' || p_name || ' | ' || p_size || ' |' || chr(10) || chr(10) || '### Response 404' || chr(10) || chr(10) || 'No part ' || p_partkey END"
)
_C10 = f"concat_ws(chr(10) || chr(10), {', '.join([_C2, _C3, _C4, _C5, _C6, _C7, _C9, _C8])})"
_C11_MODEL = "'## ' || p_name || chr(10) || chr(10) || 'A [type](/types/' || p_type || ')'"
_C11_MARKDOWN = "'# ' || p_name || chr(10) || chr(10) || 'size **' || p_size || '**'"
_C12 = "p_name || ' is a part of some type with a long enough text, ' || p_type"
CONTENT_SQL = f"CASE shape WHEN 'endpoint' THEN {_C10} WHEN 'model' THEN {_C11_MODEL} WHEN 'markdown' THEN {_C11_MARKDOWN} ELSE {_C12} END"


def endpoint_query(name: str, out: str, sql_expr: str, *kinds: str):
    """One part of every endpoint page: a text column, or the converted pieces of some kinds."""

    @query(name, f"{_EP} SELECT page_id, {sql_expr} AS {out} FROM ep")
    def run(spark, d):
        parts = content.endpoint_parts(endpoint_content(spark, d))
        value = F.array_join(content.pieces_of(col("pieces"), *kinds), "\n\n") if kinds else col(out)
        return parts.select("page_id", value.alias(out))

    return run


endpoint_query("c2_endpoint_header", "header", _C2)
endpoint_query("c3_endpoint_path", "path", _C3)
endpoint_query("c4_endpoint_description", "description", _C4)
endpoint_query("c5_endpoint_security", "security", _C5, "security")
endpoint_query("c6_endpoint_server", "server", _C6, "server")
endpoint_query("c7_endpoint_parameters", "parameters", _C7, "parameters")
endpoint_query("c8_endpoint_request_body", "request_body", _C8, "request_body")
endpoint_query("c9_endpoint_responses", "responses", _C9, "tab", "response")


def content_query(name: str, shapes: tuple[str, ...], sql: str):
    @query(name, f"{_SHAPED} {sql}")
    def run(spark, d):
        found = content.page_content(endpoint_content(spark, d))
        return found.filter(col("strategy").isin(*shapes)).select("page_id", "strategy", "markdown")

    return run


content_query("c10_endpoint_page", ("endpoint",), f"SELECT page_id, shape AS strategy, {_C10} AS markdown FROM shaped WHERE shape = 'endpoint'")
content_query(
    "c11_model_page",
    ("model", "markdown"),
    f"""SELECT page_id, shape AS strategy, CASE shape WHEN 'model' THEN {_C11_MODEL} ELSE {_C11_MARKDOWN} END AS markdown
 FROM shaped WHERE shape IN ('model', 'markdown')""",
)
content_query(
    "c12_fallback_page",
    ("fallback",),
    f"SELECT page_id, shape AS strategy, {_C12} AS markdown FROM shaped WHERE shape = 'fallback'",
)

_TABLE = """'<table><tr><th>name</th><th>size</th></tr><tr><td> </td><td></td></tr><tr></tr><tr><td> <b>' || p_name || '</b> </td><td>' || p_size || ' <i>cm</i></td></tr></table>'"""


@query(
    "c13_clean_tables",
    """SELECT p_partkey, '| name | size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || '**' || p_name || '** | ' || p_size || ' *cm* |' AS markdown FROM part""",
)
def c13(spark, d):
    parts = readers.spread_scan(B.table(spark, d, "part")).select("p_partkey", F.expr(_TABLE).alias("html"))
    return parts.select("p_partkey", H.html_to_clean_markdown("html").alias("markdown"))


def _stored_markdown() -> str:
    """The stored pages use few elements, in a fixed frame; so text rules give their Markdown."""
    text = S.sub("html", r"(?s)<!DOCTYPE[^>]*>|<!--.*?-->|<style>.*?</style>|<script>.*?</script>", "")
    text = S.sub(text, f"{S.W}+", " ")
    text = S.sub(text, '<li><a href="([^"]*)"> *(.*?) *</a></li>', "* [\\2](\\1)\n")
    text = S.sub(text, r"<p><b> *([^<]*[^< ]) *<br></article>", "<p>**\\1**</article>")
    text = S.sub(text, "<b>|<br>", "")
    text = S.sub(text, "<h1> *(.*?) *</h1>", "\n\n# \\1\n\n")
    text = S.sub(text, "<[^>]*>", "\n\n")
    text = _decoded(text)
    return S.strip(S.sub(text, "[ \n]*\n\n[ \n]*", "\n\n"))


@query("c14_html_to_markdown", f"SELECT page_id, {_stored_markdown()} AS markdown FROM pages")
def c14(spark, d):
    return pages(spark, d).select("page_id", H.html_to_markdown("html").alias("markdown"))


# --- stored structures and published content ------------------------------------------------------------


# Pages of all shapes; a page without the wrapper has no groups.
_ITEMS = f"items AS ({_T10.replace('SELECT page_id, (row_number()', 'SELECT r_regionkey, n_nationkey, k, page_id, (row_number()')})"
_KIDS = "kids AS (SELECT page_id, r_regionkey, n_nationkey, string_agg({}, ',' ORDER BY k) AS kids FROM items WHERE level = 1 GROUP BY ALL)"
_OUTLINES = """SELECT i.page_id, header AS header_text, i.r_regionkey, string_agg({} || '[' || coalesce(kids, '') || ']', ';' ORDER BY i.n_nationkey, i.k) AS outline
FROM items i LEFT JOIN kids c ON i.type = 'menu' AND i.page_id = c.page_id AND i.r_regionkey = c.r_regionkey AND i.n_nationkey = c.n_nationkey
WHERE level = 0 GROUP BY i.page_id, i.r_regionkey, header"""
_NAMED = "type || ':' || text || '#' || coalesce(id, 'none')"


def saved_and_loaded(spark, d):
    folder = work_dir(spark, "structure")
    writers.save_structure(tree.page_groups(sidebar_entries(spark, d)), folder)
    return readers.load_structure(spark, folder, "page_id bigint, group_pos int")


@query("s2_load_structure", f"WITH {_ITEMS} SELECT page_id, count(DISTINCT r_regionkey) AS groups, count(*) AS items FROM items GROUP BY page_id")
def s2(spark, d):
    kids = F.aggregate("children", F.lit(0), lambda a, c: a + F.greatest(F.coalesce(F.size(c["children"]), F.lit(0)), F.lit(0)))
    counted = saved_and_loaded(spark, d).withColumn("n", F.size("children") + kids)
    return counted.groupBy("page_id").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("items"))


@query("s3_save_structure", f"WITH {_ITEMS}, {_KIDS.format('text')} SELECT page_id, header_text, outline FROM ({_OUTLINES.format('text')})")
def s3(spark, d):
    def item(i):
        kids = F.coalesce(F.transform(i["children"], lambda c: c["text"]), F.array().cast("array<string>"))
        return F.concat(i["text"], F.lit("["), F.array_join(kids, ","), F.lit("]"))

    return saved_and_loaded(spark, d).select("page_id", "header_text", F.array_join(F.transform("children", item), ";").alias("outline"))


@query(
    "s2_load_structure_all",
    f"""WITH {_ITEMS}
SELECT page_id, count(DISTINCT r_regionkey) AS groups, count(*) FILTER (level = 0) AS tops, count(*) FILTER (level = 1) AS kids FROM items GROUP BY page_id""",
)
def s2_all(spark, d):
    def kids(c):
        return F.coalesce(F.size(F.filter(c["children"], lambda x: x["text"].isNotNull())), F.lit(0))

    counted = saved_and_loaded(spark, d).select(
        "page_id", F.size("children").alias("n"), F.aggregate("children", F.lit(0), lambda a, c: a + F.greatest(kids(c), F.lit(0))).alias("k")
    )
    return counted.groupBy("page_id").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("tops"), F.sum("k").alias("kids"))


def named_outline(children):
    """Items of a group as text: type, text, id, and the items of menus."""

    def named(i):
        return F.concat(i["text"], F.lit("#"), F.coalesce(i["id"], F.lit("none")))

    def item(i):
        kids = F.coalesce(F.transform(i["children"], named), F.array().cast("array<string>"))
        return F.concat(i["type"], F.lit(":"), named(i), F.lit("["), F.array_join(kids, ","), F.lit("]"))

    return F.array_join(F.transform(children, item), ";")


_KIDS_NAMED = _KIDS.format("text || '#' || id")


@query("s3_save_structure_all", f"WITH {_ITEMS}, {_KIDS_NAMED} SELECT page_id, header_text, outline FROM ({_OUTLINES.format(_NAMED)})")
def s3_all(spark, d):
    return saved_and_loaded(spark, d).select("page_id", "header_text", named_outline(col("children")).alias("outline"))


@query(
    "t10_parse_structure",
    f"""{_PLACED}, {_ITEMS}, {_KIDS_NAMED}, o AS ({_OUTLINES.format(_NAMED)}),
nested AS (SELECT page_id, string_agg(header_text || '(' || outline || ')', '|' ORDER BY r_regionkey) AS nested FROM o GROUP BY page_id),
flat AS (SELECT page_id, string_agg(level || ':' || text || '<' || coalesce(menu, header), '|' ORDER BY pos) AS flat, count(*) AS total_items,
 count(*) FILTER (type = 'item' AND id IS NOT NULL) AS valid_items, count(*) FILTER (type = 'menu') AS menu_items, count(*) FILTER (type = 'item') AS content_items
 FROM items GROUP BY page_id)
SELECT p.page_id, coalesce(nested, '') AS nested, coalesce(flat, '') AS flat, coalesce(total_items, 0) AS total_items, coalesce(valid_items, 0) AS valid_items,
 coalesce(menu_items, 0) AS menu_items, coalesce(content_items, 0) AS content_items
FROM (SELECT DISTINCT page_id FROM placed) p LEFT JOIN nested USING (page_id) LEFT JOIN flat USING (page_id)""",
)
def t10_structure(spark, d):
    """Nested form, flat items and counts of every page in one row."""
    parsed = tree.parse_structure(B.sidebar_pages(spark, d))
    group = lambda g: F.concat(g["header_text"], F.lit("("), named_outline(g["children"]), F.lit(")"))
    flat = lambda i: F.concat(i["level"].cast("string"), F.lit(":"), i["text"], F.lit("<"), F.coalesce(i["menu"], i["header"]))
    counts = ["total_items", "valid_items", "menu_items", "content_items"]
    return parsed.select(
        "page_id", F.array_join(F.transform("structured_data", group), "|").alias("nested"),
        F.array_join(F.transform("items", flat), "|").alias("flat"), *counts,
    )


@query(
    "s4_save_raw_html",
    f"SELECT page_id, 'debug/page_content_' || {S.slug('url')} || '.html' AS debug_path, sha256(html) AS sha256 FROM pages",
)
def s4(spark, d):
    folder = work_dir(spark, "raw-html")
    writers.save_raw_html(pages(spark, d, "page_id", "url", "html"), folder, col("url"))
    return spark.read.parquet(folder).select("page_id", "debug_path", X.checksum(col("html")).alias("sha256"))


def published_sql(source: str, pos: str, title: str, batch: str = "0") -> str:
    """The first row of every path: pages of all strategies to Markdown, cleaned, with path and checksum."""
    return f"""shaped AS (SELECT *, p_partkey AS page_id, {pos} AS doc_id, {title} AS title_, {batch} AS batch_, {B.SHAPE_EXPR} AS shape FROM {source}),
texts AS (SELECT doc_id, {CONTENT_SQL} AS text FROM shaped), {sanitized_ctes('texts')},
p AS (SELECT batch_, doc_id, p_brand AS header, p_type AS menu, title_ AS text, {S.path('p_brand', 'p_type', 'title_')} AS output_path, result AS markdown
 FROM shaped JOIN sane USING (doc_id))
SELECT output_path, header, menu, text, markdown, sha256(markdown) AS sha256 FROM p
WHERE NOT (contains(output_path, '..') OR contains(output_path, '~') OR contains(output_path, '//'))
QUALIFY row_number() OVER (PARTITION BY output_path ORDER BY batch_, doc_id) = 1"""


PUBLISHED = ("output_path", "header", "menu", "text", "markdown", "sha256")


def content_rows(parts, title):
    """Pages of parts as content rows: the brand is the header, the type the menu."""
    named = {"pos": col("page_id"), "header": col("p_brand"), "menu": col("p_type"), "text": title}
    return parts.withColumns(named).select(*named, "html")


@query("s5_publish_markdown", "WITH " + published_sql("part", "p_partkey", "p_name"))
def s5(spark, d):
    folder = work_dir(spark, "published")
    rows = content_rows(B.part_pages(readers.spread_scan(B.table(spark, d, "part"))), col("p_name"))
    writers.publish_markdown(rows, folder, render=content.rendered)
    again = writers.publish_markdown(rows, folder, verify=True, render=content.rendered)
    return again.select(*PUBLISHED)
