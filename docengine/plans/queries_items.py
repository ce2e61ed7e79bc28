"""Registered queries over item tables: tree, joins, aggregates, order, storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from docengine.functions import text as X
from docengine.operators import nodes, ordered, resume, rules, summaries, tree
from docengine.plans import bindings as B
from docengine.plans import sql_parts as S
from docengine.plans.registry import query

col = F.col
CATALOG, FLAWED = f"WITH {B.CATALOG_SQL}", f"WITH {B.FLAWED_SQL}"

# --- header attachment and order over conversations ------------------------------------


def convo(spark, d):
    return B.table(spark, d, "conversations").withColumn("is_header", col("role") == "user")


@query(
    "t1_attach_leading_header",
    """SELECT conv_id, turn, header FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)
 OVER (PARTITION BY conv_id ORDER BY turn) AS header FROM conversations) WHERE role <> 'user' AND header IS NOT NULL""",
)
def t1(spark, d):
    found = tree.attach_leading_header(convo(spark, d), ["conv_id"], "turn", col("is_header"), col("text"))
    return found.select("conv_id", "turn", "header")


@query(
    "t2_attach_trailing_header",
    """SELECT conv_id, turn, coalesce(first_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)
   OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
 last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)
   OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 'API Documentation') AS header
FROM conversations QUALIFY role <> 'user'""",
)
def t2(spark, d):
    found = tree.attach_trailing_header(convo(spark, d), ["conv_id"], "turn", col("is_header"), col("text"))
    return found.select("conv_id", "turn", "header")


@query(
    "w2_doc_order",
    """SELECT conv_id, turn, count(*) FILTER (role <> 'user') OVER (PARTITION BY conv_id ORDER BY turn
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (role <> 'user')::INT AS position FROM conversations""",
)
def w2(spark, d):
    found = tree.document_order(convo(spark, d), ["conv_id"], "turn", col("is_header"))
    return found.select("conv_id", "turn", "position")


@query(
    "w1_round_robin",
    CATALOG + " SELECT pos, header, ((row_number() OVER (PARTITION BY header ORDER BY pos) - 1) % 7)::INTEGER AS shard FROM catalog",
)
def w1(spark, d):
    return ordered.round_robin(B.catalog(spark, d), ["header"], "pos", 7).select("pos", "header", "shard")


# --- entries and nesting over the catalog ------------------------------------------------

_T6_ID = (
    f"CASE WHEN type = 'menu' OR {S.filled('id')} THEN id WHEN {S.any_of('text', rules.ENDPOINT_PHRASES)} THEN 'synthetic-' || "
    f"trim({S.sub(S.sub(S.sub('lower(text)', rf'[^\p{{L}}\p{{N}}_{S.WS}-]', ''), f'{S.W}+', '-'), '-+', '-')}, '-') ELSE id END"
)
_SKIP = f"({S.blank('text')} OR text IN ('Overview', {', '.join(repr(t) for t in rules.PLACEHOLDER_TEXTS)}))"


@query(
    "t6_parse_entry",
    FLAWED
    + f""", e AS (SELECT pos, text, CASE WHEN type = 'menu' THEN 'menu' ELSE 'item' END AS type, {_T6_ID} AS id FROM flawed)
SELECT pos, id, text, type, type = 'menu' AS is_expandable FROM e
WHERE NOT {_SKIP} AND (type = 'menu' OR {S.filled('id')})""",
)
def t6(spark, d):
    items = B.flawed_catalog(spark, d).withColumn("is_menu", F.coalesce(col("type") == "menu", F.lit(False)))
    kind = F.when(col("is_menu"), F.lit("menu")).otherwise(F.lit("item"))
    parsed = items.withColumn("id", tree.resolved_id(col("id"), col("text"), col("is_menu"))).withColumn("type", kind)
    kept = parsed.filter(~rules.skip_item(col("text")) & rules.entry_valid(col("id"), col("text"), col("type")))
    return kept.select("pos", "id", "text", "type", col("is_menu").alias("is_expandable"))


SUB_MENUS = 3


def placed_items(spark, d):
    """Catalog items by page, ready to nest: a group per region, a menu per nation and a chain of menus in it, items at each depth."""
    rows = B.placed_customers(spark, d)
    nation, deep = col("n_nationkey").cast("bigint"), col("c_custkey") % (SUB_MENUS + 1)

    def menu_pos(k):
        """Position of the menu at depth k of a nation: its own menu, then the chain."""
        return F.when(k == 0, nation).otherwise(30 + SUB_MENUS * nation + k)

    kid_id = F.when(col("has_id"), F.concat(F.lit("cust-"), col("c_custkey").cast("string")))
    place = [col("page_id"), col("r_regionkey").alias("header_pos"), col("r_name").alias("header")]
    kids = rows.select(
        *place, (col("c_custkey") + 1000).alias("pos"), kid_id.alias("id"), col("label").alias("text"), F.lit("item").alias("type"),
        F.lit(False).alias("is_expandable"), menu_pos(deep).alias("menu_pos"),
    )
    own = rows.select("page_id", "r_regionkey", "r_name", "n_nationkey", "n_name").distinct()
    k = col("k")
    name = F.when(k == 0, col("n_name")).otherwise(F.concat("n_name", F.lit(" part "), k.cast("string")))
    menus = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(SUB_MENUS))).alias("k")).select(
        *place, menu_pos(k).alias("pos"), F.lit(None).cast("string").alias("id"), name.alias("text"), F.lit("menu").alias("type"),
        F.lit(True).alias("is_expandable"), F.when(k > 0, menu_pos(k - 1)).alias("menu_pos"),
    )
    return menus.unionByName(kids)


_PLACED = f"WITH {B.PLACED_SQL}"
_KIDS = "string_agg(label || '(' || CASE WHEN has_id THEN 'cust-' || c_custkey ELSE '-' END || ')', ',' ORDER BY c_custkey)"
_GROUPED = _PLACED + f""",
kids AS (SELECT page_id, r_regionkey, r_name, n_nationkey, n_name,
  [{", ".join(f"{_KIDS} FILTER (c_custkey % 4 = {k})" for k in range(4))}] AS kids
  FROM placed GROUP BY page_id, r_regionkey, r_name, n_nationkey, n_name),
menus AS (SELECT *, n_name || '[' || concat_ws(',', n_name || ' part 1[' || concat_ws(',', n_name || ' part 2[' || concat_ws(',', n_name || ' part 3['
  || coalesce(kids[4], '') || ']', kids[3]) || ']', kids[2]) || ']', kids[1]) || ']' AS body FROM kids),
groups AS (SELECT page_id, r_regionkey, r_name, string_agg(body, ';' ORDER BY n_nationkey) AS body FROM menus GROUP BY ALL)
SELECT page_id, string_agg(r_name || ': ' || body, '|' ORDER BY r_regionkey) AS outline FROM groups GROUP BY page_id"""


@query("t8_nest", _GROUPED)
def t8(spark, d):
    nested = tree.nest(placed_items(spark, d), ["page_id"])

    def entry(i, level):
        leaf = F.concat(i["text"], F.lit("("), F.coalesce(i["id"], F.lit("-")), F.lit(")"))
        if level > SUB_MENUS:
            return leaf
        inner = F.array_join(F.transform(i["children"], lambda c: entry(c, level + 1)), ",")
        return F.when(i["type"] == "menu", F.concat(i["text"], F.lit("["), inner, F.lit("]"))).otherwise(leaf)

    def group(g):
        return F.concat(g["header_text"], F.lit(": "), F.array_join(F.transform(g["children"], lambda i: entry(i, 0)), ";"))

    return nested.select("page_id", F.array_join(F.transform("structured_data", group), "|").alias("outline"))


_FLAT_ROWS = _PLACED + """,
menus AS (SELECT DISTINCT page_id, r_regionkey, r_name, n_nationkey, n_name, k, n_name || CASE k WHEN 0 THEN '' ELSE ' part ' || k END AS name,
  list_transform(range(k + 1), lambda i: CASE i WHEN 0 THEN n_nationkey ELSE 30 + 3 * n_nationkey + i END) AS path FROM placed, range(4) r(k)),
rows AS (
  SELECT page_id, r_regionkey, path, NULL::VARCHAR AS id, name AS text, 'menu' AS type, r_name AS header,
    CASE k WHEN 0 THEN NULL WHEN 1 THEN n_name ELSE n_name || ' part ' || (k - 1) END AS menu, k AS level FROM menus
  UNION ALL
  SELECT page_id, r_regionkey, list_append(m.path, 1000 + c_custkey), 'cust-' || c_custkey, label, 'item', p.r_name, m.name, m.k + 1
  FROM placed p JOIN menus m USING (page_id, r_regionkey, n_nationkey) WHERE has_id AND c_custkey % 4 = m.k
)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY r_regionkey, path) - 1)::INTEGER AS pos,
  id, text, type, header, menu, menu AS parent_menu_text, level::INTEGER AS level FROM rows"""


@query("t9_flatten", _FLAT_ROWS)
def t9(spark, d):
    return tree.flatten_items(placed_items(spark, d), ["page_id"])


@query("t9_flatten_nested", _FLAT_ROWS)
def t9_nested(spark, d):
    return tree.flatten(tree.nest(placed_items(spark, d), ["page_id"]), ["page_id"])


# --- menus of any depth as an adjacency table -------------------------------------------------

# A region is a top row, a nation lies in its region, customers in their nation or in another customer: up to eight levels.
_LINKS_SQL = """links AS (
 SELECT 'r' || r_regionkey AS key, NULL::VARCHAR AS parent, r_name AS text FROM region
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
 UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey < 4 OR c_custkey % 7 = 0 THEN 'n' || c_nationkey ELSE 'c' || (c_custkey // 4) END, c_name FROM customer)"""
_WALK_SQL = f"""WITH RECURSIVE {_LINKS_SQL},
walk(key, text, keys, texts, level) AS (
 SELECT key, text, []::VARCHAR[], []::VARCHAR[], 0 FROM links WHERE parent IS NULL
 UNION ALL SELECT l.key, l.text, list_append(w.keys, w.key), list_append(w.texts, w.text), w.level + 1 FROM walk w JOIN links l ON l.parent = w.key)"""


def links(spark, d):
    def named(prefix, value):
        return F.concat(F.lit(prefix), value.cast("string"))

    key, nation = col("c_custkey"), named("n", col("c_nationkey"))
    regions = B.table(spark, d, "region").select(named("r", col("r_regionkey")).alias("key"), F.lit(None).cast("string").alias("parent"), col("r_name").alias("text"))
    nations = B.table(spark, d, "nation").select(named("n", col("n_nationkey")), named("r", col("n_regionkey")), "n_name")
    above = F.when((key < 4) | (key % 7 == 0), nation).otherwise(named("c", F.floor(key / 4)))
    return regions.union(nations).union(B.table(spark, d, "customer").select(named("c", key), above, "c_name"))


@query("n4_ancestor_paths", _WALK_SQL + " SELECT key, array_to_string(texts, ' > ') AS path, level FROM walk")
def n4_paths(spark, d):
    """The menus around every item, from an adjacency table."""
    paths = tree.item_paths(links(spark, d), "key", "parent", "text")
    return paths.select("key", F.array_join("texts", " > ").alias("path"), "level")


@query(
    "t5_flat_children",
    _WALK_SQL + " SELECT keys[i] AS menu, key, text, (level - i + 1)::INTEGER AS level FROM (SELECT *, unnest(range(1, level + 1)) AS i FROM walk)",
)
def t5_table(spark, d):
    """Every item below every menu, whatever the depth."""
    return tree.flat_children(tree.item_paths(links(spark, d), "key", "parent", "text"))


@query(
    "t11_standard_item",
    FLAWED
    + """ SELECT pos, id, text, coalesce(type, 'unknown') AS type, menu, header, level AS original_level, type IS NULL AS untyped FROM flawed""",
)
def t11(spark, d):
    made = tree.standard_item(B.flawed_catalog(spark, d))
    original = col("original_item")
    return made.select(
        original["pos"].alias("pos"), "id", "text", "type", "menu", "header", original["level"].alias("original_level"),
        original["type"].isNull().alias("untyped"),
    )


# Entry counts per nation stand in for the counts of a rendered page.


# --- selections ------------------------------------------------------------------------------


_SPACED = "CASE (page_id + r_regionkey) % 3 WHEN 0 THEN '  ' || r_name || chr(9) WHEN 1 THEN ' ' || chr(10) ELSE r_name END"


@query(
    "p9_header_constraints",
    _PLACED
    + f""", g AS (SELECT DISTINCT page_id, r_regionkey, {_SPACED} AS h FROM placed)
SELECT page_id, r_regionkey, CASE WHEN {S.blank('h')} THEN 'blank header_text' ELSE 'none' END AS fault, {S.strip('h')} AS header_text FROM g""",
)
def p9_headers(spark, d):
    """The header groups of all pages, some with blanks around their text or nothing but blanks."""
    groups = B.placed_customers(spark, d).select("page_id", "r_regionkey", F.expr(_SPACED).alias("header_text")).distinct()
    good, bad = rules.quarantine(groups, rules.header_fault(col("header_text")), ("header_text",))
    rows = good.withColumn("fault", F.lit("none")).unionByName(bad.withColumn("header_text", F.lit("")))
    return rows.select("page_id", "r_regionkey", "fault", "header_text")


@query("p10_select_by_id", CATALOG + " SELECT pos, id, text, header, menu FROM catalog WHERE id = 'cust-42'")
def p10(spark, d):
    return B.catalog(spark, d).filter(col("id") == "cust-42").select("pos", "id", "text", "header", "menu")


@query(
    "p11_split_by_type",
    FLAWED + " SELECT pos, CASE type WHEN 'menu' THEN 'menu_items' ELSE 'content_items' END AS part FROM flawed WHERE type IN ('menu', 'item')",
)
def p11(spark, d):
    items = B.flawed_catalog(spark, d)
    menus = items.filter(col("type") == "menu").select("pos", F.lit("menu_items").alias("part"))
    return menus.unionByName(items.filter(col("type") == "item").select("pos", F.lit("content_items").alias("part")))


@query(
    "p12_structure_acceptable",
    FLAWED
    + """, c AS (SELECT header, menu, count(*) AS total, count(*) FILTER (id IS NOT NULL AND type = 'item') AS valid FROM flawed GROUP BY ALL)
SELECT *, valid >= 10 AND valid > total * 0.1 AS acceptable FROM c""",
)
def p12(spark, d):
    return rules.structure_acceptable(B.flawed_catalog(spark, d), ["header", "menu"])


@query("l1_max_items", CATALOG + " SELECT pos, id, text FROM catalog ORDER BY pos LIMIT 100")
def l1(spark, d):
    return summaries.max_items(B.catalog(spark, d), "pos", 100).select("pos", "id", "text")


# --- resume joins: customers are items, urgent orders mark what exists ---------------------------------


def _customers(spark, d):
    return B.table(spark, d, "customer").select(
        col("c_custkey").alias("pos"), F.concat(F.lit("cust-"), col("c_custkey").cast("string")).alias("id"),
        col("c_name").alias("text"), col("c_mktsegment").alias("header"), F.lit(None).cast("string").alias("menu"),
    )


def _urgent(spark, d):
    return B.table(spark, d, "orders").filter(col("o_orderpriority") == "1-URGENT")


def _with_paths(spark, d):
    items = resume.with_output_path(_customers(spark, d))
    done = _urgent(spark, d).join(B.table(spark, d, "customer"), col("o_custkey") == col("c_custkey"))
    paths = done.select(X.output_path(col("c_mktsegment"), F.lit(None).cast("string"), col("c_name")).alias("output_path"))
    return items, paths


_CUST_PATH = S.path("c_mktsegment", "NULL::VARCHAR", "c_name")
_PATHS = f"""WITH items AS (SELECT c_custkey AS pos, c_name AS text, 'cust-' || c_custkey AS id, {_CUST_PATH} AS output_path FROM customer),
done AS (SELECT DISTINCT {_CUST_PATH} AS output_path FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT')"""


@query("j1_resume_existing", _PATHS + " SELECT pos, output_path FROM items WHERE output_path IN (SELECT output_path FROM done)")
def j1(spark, d):
    items, done = _with_paths(spark, d)
    return resume.existing_items(items, done).select("pos", "output_path")


@query("j2_resume_pending", _PATHS + " SELECT pos, output_path FROM items WHERE output_path NOT IN (SELECT output_path FROM done)")
def j2(spark, d):
    items, done = _with_paths(spark, d)
    return resume.pending_items(items, done).select("pos", "output_path")


_J3_EDIT = "CASE WHEN doc_id % 3 = 1 THEN text || ' edited' ELSE text END"


@query(
    "j3_skip_or_write",
    f"""WITH stored AS (SELECT 'doc-' || doc_id AS output_path, sha256({_J3_EDIT}) AS h FROM documents WHERE doc_id % 3 <> 0)
SELECT doc_id AS pos, CASE WHEN h IS NULL THEN 'write' WHEN h = sha256(text) THEN 'skip_same' ELSE 'skip_differs' END AS action
FROM documents LEFT JOIN stored ON output_path = 'doc-' || doc_id""",
)
def j3(spark, d):
    docs = B.documents(spark, d, "doc_id", "text").withColumn("output_path", F.concat(F.lit("doc-"), col("doc_id").cast("string")))
    stored = docs.filter("doc_id % 3 <> 0").select("output_path", X.checksum(F.expr(_J3_EDIT)).alias("sha256"))
    items = docs.select(col("doc_id").alias("pos"), "output_path", X.checksum(col("text")).alias("sha256"))
    return resume.write_actions(items, stored).select("pos", "action")


_NAME = "left(replace(rtrim(regexp_replace({t}, '[^\\p{{L}}\\p{{N}} _-]', '', 'g')), ' ', '_'), 50) || '_' || {i} || '.md'"


@query(
    "j4_existing_alt_name",
    f"""WITH f AS (SELECT DISTINCT {_NAME.format(t='c_name', i="'cust-' || c_custkey")} AS file_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT')
SELECT c_custkey AS pos, file_name FROM customer JOIN f ON file_name = {_NAME.format(t='c_name', i="'cust-' || c_custkey")}""",
)
def j4(spark, d):
    done = _urgent(spark, d).join(B.table(spark, d, "customer"), col("o_custkey") == col("c_custkey"))
    done_id = F.concat(F.lit("cust-"), col("c_custkey").cast("string"))
    files = done.select(X.output_filename(col("c_name"), done_id).alias("file_name"))
    return resume.existing_by_filename(_customers(spark, d), files).select("pos", "file_name")


# Ids are made from source and language, so many documents share one; every second is padded.
_DOC_ID = "CASE WHEN doc_id % 50 = 0 THEN '' WHEN doc_id % 2 = 0 THEN ' _' || source || '-' || lang || '- ' ELSE source || '-' || lang END"
_DOC_TEXT = "lang || ' ' || (n_chars % 3)"
_DOC_ITEMS = f"""WITH items AS (SELECT doc_id AS pos, {_DOC_ID} AS id, {_DOC_TEXT} AS text FROM documents),
keyed AS (SELECT *, trim(id, '{S.CHARS}-_') AS norm_id FROM items WHERE id <> ''),
winners AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY norm_id ORDER BY pos DESC) = 1)"""


def _doc_items(spark, d):
    docs = B.table(spark, d, "documents")
    return docs.select(col("doc_id").alias("pos"), F.expr(_DOC_ID).alias("id"), F.expr(_DOC_TEXT).alias("text"))


@query("j5_reference_map", _DOC_ITEMS + " SELECT norm_id, pos, id, text FROM winners")
def j5(spark, d):
    return resume.reference_map(_doc_items(spark, d)).select("norm_id", "item.*")


@query(
    "j6_duplicate_ids",
    _DOC_ITEMS
    + """ SELECT k.pos, 'Duplicate ID found: ' || k.id || ' for item ''' || k.text || '''' AS message FROM keyed k JOIN winners w USING (norm_id)
WHERE k.id IS DISTINCT FROM w.id OR k.text IS DISTINCT FROM w.text""",
)
def j6(spark, d):
    return resume.duplicate_ids(_doc_items(spark, d)).select("pos", "message")


@query(
    "j7_path_collisions",
    f"""WITH p AS (SELECT p_partkey AS pos, {S.path('p_brand', 'p_type', 'p_name')} AS output_path FROM part)
SELECT pos, output_path, count(*) OVER (PARTITION BY output_path) AS sharing FROM p QUALIFY sharing > 1""",
)
def j7(spark, d):
    parts = B.table(spark, d, "part").select(
        col("p_partkey").alias("pos"), X.output_path(col("p_brand"), col("p_type"), col("p_name")).alias("output_path")
    )
    return resume.path_collisions(parts).select("pos", "output_path", "sharing")


# --- aggregates --------------------------------------------------------------------------------


@query(
    "a1_group_by_menu",
    FLAWED
    + """, k AS (SELECT *, CASE WHEN coalesce(menu, '') = '' THEN 'no_menu' ELSE menu END AS menu_key FROM flawed)
SELECT menu_key, row_number() OVER (PARTITION BY menu_key ORDER BY pos) - 1 AS index_in_menu, pos, id, text, type,
 count(*) OVER (PARTITION BY menu_key) AS group_size FROM k""",
)
def a1(spark, d):
    grouped = summaries.group_by_menu(B.flawed_catalog(spark, d), "pos")
    return grouped.select("menu_key", "index_in_menu", "pos", "id", "text", "type", "group_size")


@query(
    "a2_structure_counts",
    FLAWED
    + """ SELECT header, count(*) AS total_items, count(*) FILTER (id IS NOT NULL AND type = 'item') AS valid_items,
 count(*) FILTER (type = 'menu') AS menu_items, count(*) FILTER (type = 'item') AS content_items FROM flawed GROUP BY header""",
)
def a2(spark, d):
    return summaries.structure_counts(B.flawed_catalog(spark, d), ["header"])


@query(
    "a3_resume_summary",
    """WITH c AS (SELECT c_mktsegment AS header, count(*) AS total, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')) AS existing FROM customer GROUP BY 1)
SELECT header, total, existing, total - existing AS remaining,
 printf('Resume Info: %d/%d complete (%.1f%%), %d remaining', existing, total, existing / total * 100.0, total - existing) AS report FROM c""",
)
def a3(spark, d):
    done = _urgent(spark, d).select(col("o_custkey").alias("pos"), F.lit(True).alias("done")).distinct()
    marked = _customers(spark, d).join(done, "pos", "left")
    made = resume.resume_summary(marked, F.coalesce(col("done"), F.lit(False)), ["header"])
    return made.select("header", "total", "existing", "remaining", "report")


@query(
    "l2_next_pending",
    """WITH p AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')),
r AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS n FROM p)
SELECT (n - 1)::INTEGER AS line, n || '. ' || c_name || ' (ID: cust-' || c_custkey || ')' AS entry FROM r WHERE n <= 5
UNION ALL SELECT 5, '... and ' || (count(*) - 5) || ' more items' FROM p HAVING count(*) > 5""",
)
def l2(spark, d):
    done = _urgent(spark, d).select(col("o_custkey").alias("pos"))
    return resume.next_pending(resume.pending_items(_customers(spark, d), done, "pos"), "pos")
