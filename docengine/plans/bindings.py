"""Input tables of the registered queries, in Spark and as SQL common tables.

Where stored tables lack the documentation layout, pages are built from them in
Spark: navigation pages from customers, endpoint pages from parts. A page takes a
fixed range of unique keys, so its size is bounded at any scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.sources.readers import parse_partitions, spread_scan


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- catalog: items from region, nation and customer --------------------------------

CATALOG_SQL = """
catalog AS (
  SELECT n_nationkey::BIGINT AS pos, NULL::VARCHAR AS id, n_name AS text, 'menu' AS type, r_name AS header,
         NULL::VARCHAR AS menu, NULL::VARCHAR AS parent_menu_text, 0 AS level
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT 1000 + c_custkey, 'cust-' || c_custkey, c_name, 'item', r_name, n_name, n_name, 1
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def catalog(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.lit(None).cast("string")
    menus = places.select(
        F.col("n_nationkey").cast("bigint").alias("pos"), none.alias("id"), F.col("n_name").alias("text"),
        F.lit("menu").alias("type"), F.col("r_name").alias("header"), none.alias("menu"),
        none.alias("parent_menu_text"), F.lit(0).alias("level"),
    )
    customers = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    items = customers.select(
        (F.col("c_custkey") + 1000).alias("pos"), F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("id"),
        F.col("c_name").alias("text"), F.lit("item").alias("type"), F.col("r_name").alias("header"),
        F.col("n_name").alias("menu"), F.col("n_name").alias("parent_menu_text"), F.lit(1).alias("level"),
    )
    return menus.unionByName(items)


# Faults put into the catalog, read by both engines.
FLAWS = {
    "id": "CASE pos % 10 WHEN 3 THEN NULL WHEN 4 THEN '' ELSE id END",
    "text": "CASE pos % 12 WHEN 5 THEN 'Overview' WHEN 6 THEN '   ' WHEN 7 THEN 'Unknown Item'"
    " WHEN 8 THEN '  ' || text || ' ' WHEN 9 THEN 'Get ' || text WHEN 10 THEN NULL ELSE text END",
    "type": "CASE pos % 13 WHEN 1 THEN 'link' WHEN 2 THEN '' WHEN 4 THEN NULL ELSE type END",
    "level": "CASE WHEN pos % 17 = 0 THEN -1 ELSE level END",
}
FLAWED_SQL = (
    CATALOG_SQL
    + ",\nflawed AS (SELECT pos, "
    + ", ".join(f"{expr} AS {name}" for name, expr in FLAWS.items())
    + ", header, menu, parent_menu_text FROM catalog)"
)


def flawed_catalog(spark: SparkSession, d: str) -> DataFrame:
    flawed = [F.expr(expr).alias(name) for name, expr in FLAWS.items()]
    return catalog(spark, d).select("pos", *flawed, "header", "menu", "parent_menu_text")


# --- Markdown: documents with faults added --------------------------------------------

_NL = "chr(10)"
_LINES = [
    "'#' || source", "'Intro' || chr(9) || lang || chr(9) || 'end  '", "text", "'before'", "'| a | b | c |'",
    "'| --- | --- | --- |'", "'| 1 | 2 | 3 |'", "'after'", "'more'", "''", "''", "''", "'##' || chr(9) || 'Tab head'",
    "'[link]( ) &amp;lt; &nbsp;&quot;q&quot; “s” ‘t’ — x​y **bold** _ _ a***b'", "'Heading'", "'====='", "'Sub'",
    "'---'", "'```py'", "'x = 1'", "'```'", "'<!-- c'", "'d -->'", "'tail  '",
]
MD_EXPR = f" || {_NL} || ".join(_LINES)
MD_SQL = f"md AS (SELECT doc_id, {MD_EXPR} AS text FROM documents)"


def md(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return spread_scan(docs).select("doc_id", F.expr(MD_EXPR).alias("text"))


def documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Chosen columns of the documents, dealt out to all cores if they are one small file."""
    return spread_scan(table(spark, d, "documents").select(*columns))


# --- log: events with a level -------------------------------------------------------

LEVEL_EXPR = (
    "CASE event_type WHEN 'view' THEN 'DEBUG' WHEN 'click' THEN 'INFO' WHEN 'signup' THEN 'INFO'"
    " WHEN 'purchase' THEN 'WARNING' WHEN 'error' THEN 'ERROR' END"
)
STATUS_EXPR = (
    "CASE event_type WHEN 'purchase' THEN 'processed' WHEN 'signup' THEN 'processed' WHEN 'error' THEN 'errors'"
    " WHEN 'view' THEN 'skipped' ELSE 'no_content' END"
)


def log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("level", F.expr(LEVEL_EXPR))


# --- navigation pages -----------------------------------------------------------------

PER_PAGE = 40
PLACED_SQL = f"""
placed AS (
  SELECT c_custkey // {PER_PAGE} AS page_id, (c_custkey // {PER_PAGE}) % 4 AS shape, c_custkey, c_name, n_nationkey,
         n_name, r_regionkey, r_name,
         CASE WHEN (c_custkey // {PER_PAGE}) % 4 = 1 THEN c_custkey % 3 = 0 ELSE c_custkey % 7 <> 0 END AS has_id,
         CASE WHEN c_custkey % 9 = 0 THEN 'Overview'
              WHEN (c_custkey // {PER_PAGE}) % 4 = 1 AND c_custkey % 2 = 0 THEN 'Get ' || c_name ELSE c_name END AS label
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def placed_customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their page. Page shapes: 0 leading headers with child lists,
    1 trailing headers, 2 children inside the menu entry, 3 as 0 but without the wrapper."""
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    page = F.floor(F.col("c_custkey") / PER_PAGE)
    joined = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    marked = joined.withColumn("page_id", page).withColumn("shape", F.col("page_id") % 4)
    key, flat = F.col("c_custkey"), F.col("shape") == 1
    label = (
        F.when(key % 9 == 0, F.lit("Overview"))
        .when(flat & (key % 2 == 0), F.concat(F.lit("Get "), F.col("c_name")))
        .otherwise(F.col("c_name"))
    )
    has_id = F.when(flat, key % 3 == 0).otherwise(key % 7 != 0)
    return marked.withColumn("has_id", has_id).withColumn("label", label)


def _entry_html(inner: Column) -> Column:
    return F.concat(F.lit("<app-api-doc-item>\n"), inner, F.lit("</app-api-doc-item>\n"))


def _item_html(key: Column, has_id: Column, label: Column) -> Column:
    name = F.concat(F.lit("cust-"), key.cast("string"))
    li_id = F.when(has_id, F.concat(F.lit(' id="'), name, F.lit('"'))).otherwise(F.lit(""))
    span_id = F.when(has_id, F.concat(F.lit(' id="'), name, F.lit('-sp"'))).otherwise(F.lit(""))
    return F.concat(
        F.lit('<li class="toc-item-highlight clickable"'), li_id, F.lit("><div><!----><span"), span_id, F.lit(">\n "),
        label, F.lit(" </span></div></li>"),
    )


def _menu_html(nation: Column, name: Column, nested: Column) -> Column:
    icon = F.when(nation % 5 == 0, F.lit("down")).otherwise(F.lit("right"))
    return F.concat(
        F.lit('<li class="toc-item-highlight clickable"><div><i class="dds__icon--chevron-'), icon,
        F.lit('"></i><div class="align-middle dds__text-truncate dds__position-relative"> '), name,
        F.lit("</div></div>"), nested, F.lit("</li>"),
    )


def sidebar_pages(spark: SparkSession, d: str) -> DataFrame:
    def ordered(value: str, *keys: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.struct(*keys, value)))
        return F.array_join(F.transform(pairs, lambda p: p[value]), "")

    item = _item_html(F.col("c_custkey"), F.col("has_id"), F.col("label"))
    nested_item = F.col("shape") == 2
    rows = placed_customers(spark, d).withColumn("html", F.when(nested_item, item).otherwise(_entry_html(item)))
    menus = rows.groupBy("page_id", "shape", "r_regionkey", "r_name", "n_nationkey", "n_name").agg(
        ordered("html", "c_custkey").alias("kids"),
        F.array_sort(F.collect_list(F.struct("c_custkey", "html"))).alias("members"),
    )
    listed = F.concat(F.lit("<ul>\n"), F.col("kids"), F.lit("</ul>\n"))
    menu = _menu_html(F.col("n_nationkey"), F.col("n_name"), F.when(F.col("shape") == 2, listed).otherwise(F.lit("")))
    block = F.concat(_entry_html(menu), F.when(F.col("shape").isin(0, 3), listed).otherwise(F.lit("")))
    regions = menus.withColumn("block", block).groupBy("page_id", "shape", "r_regionkey", "r_name").agg(
        ordered("block", "n_nationkey").alias("menus"), F.array_sort(F.flatten(F.collect_list("members"))).alias("members")
    )
    head = _entry_html(F.concat(F.lit('<li class="toc-item-divider"><a>'), F.col("r_name"), F.lit("</a></li>")))
    loose = F.array_join(F.transform("members", lambda m: m["html"]), "")
    part = F.when(F.col("shape") == 1, F.concat(loose, F.col("menus"), head)).otherwise(F.concat(head, F.col("menus")))
    # Pages are small on disk and costly to parse: keep all cores busy with them.
    spread = regions.withColumn("part", part).repartition(parse_partitions(spark), "page_id", "shape")
    pages = spread.groupBy("page_id", "shape").agg(ordered("part", "r_regionkey").alias("body"))
    inner = F.concat(F.lit("<ul>\n"), F.col("body"), F.lit("</ul>"))
    wrapped = F.concat(F.lit('<div class="filter-api-sidebar-wrapper">'), inner, F.lit("</div>"))
    return pages.select("page_id", "shape", F.when(F.col("shape") == 3, inner).otherwise(wrapped).alias("html"))


# --- endpoint pages ---------------------------------------------------------------------

ENDPOINT_HTML = {
    "endpoint": """'<app-api-doc-endpoint><div class="dds__mb-4">' ||
 CASE WHEN p_size % 4 = 0 THEN '' ELSE '<app-show-http-method><span class="tag http-method-get">GET</span></app-show-http-method>' END ||
 '<span class="dds__pl-3"> ' || p_name || ' </span>' || CASE WHEN p_size % 3 = 0 THEN '<button>Try It</button>' ELSE '' END ||
 '</div><markdown><pre>/parts/' || p_partkey || '</pre></markdown><div class="dds__mt-2">' || CASE p_size % 7
 WHEN 0 THEN '<markdown><pre>/parts/' || p_partkey || '</pre></markdown>' WHEN 1 THEN '<markdown><p>/parts/' || p_partkey || '</p></markdown>'
 WHEN 2 THEN '<markdown class="d"><pre>/parts/' || p_partkey || '</pre></markdown>'
 ELSE '<markdown><p>Part of type <b>' || p_type || '</b>.</p></markdown>' END || '</div><app-api-doc-security><p>Key of <i>' || p_brand || '</i></p></app-api-doc-security>' ||
 '<app-api-doc-server>https://' || p_type || '.example</app-api-doc-server>' ||
 '<app-show-parameters><h4>Path <b>id</b></h4><ul><li>id</li><li>size ' || p_size || '</li></ul></app-show-parameters>' ||
 '<app-show-parameters> </app-show-parameters><app-show-parameters><p>page<br>limit</p></app-show-parameters><app-api-doc-response>' ||
 CASE WHEN p_size % 5 = 0 THEN '<p>plain</p>' ELSE '<div><button role="tab">200</button><button role="tab">404</button></div>' ||
 '<div role="tabpanel"><table><tr><th>name</th><th>size</th></tr><tr><td></td><td> </td></tr><tr><td><b>' || p_name ||
 '</b></td><td> ' || p_size || ' </td></tr></table></div><div role="tabpanel"><p>No part ' || p_partkey || '</p></div>' END ||
 '</app-api-doc-response><app-api-doc-request-body><pre>{"size": ' || p_size || '}</pre></app-api-doc-request-body></app-api-doc-endpoint>'""",
    "model": """'<app-api-doc-model><h2>' || p_name || '</h2><p>A <a href="/types/' || p_type || '">type</a></p></app-api-doc-model>'""",
    "markdown": """'<markdown><h1>' || p_name || '</h1></markdown><p>left out</p><markdown> </markdown><markdown><p>size <b>' || p_size || '</b></p></markdown>'""",
    "fallback": """'<nav>menu</nav><section class="Main-Content"><p>' || p_name || ' is a part of some type with a long enough text, ' || p_type ||
 '</p></section><div class="docs">short</div>'""",
}
SHAPE_EXPR = "CASE p_partkey % 6 WHEN 0 THEN 'model' WHEN 1 THEN 'markdown' WHEN 2 THEN 'fallback' ELSE 'endpoint' END"


def endpoint_pages(spark: SparkSession, d: str) -> DataFrame:
    return part_pages(spread_scan(table(spark, d, "part"))).select("page_id", "shape", "html")


def part_pages(parts: DataFrame) -> DataFrame:
    """Parts with page_id, shape and html."""
    shaped = parts.withColumn("shape", F.expr(SHAPE_EXPR)).withColumn("page_id", F.col("p_partkey"))
    cases = " ".join(f"WHEN '{name}' THEN {html}" for name, html in ENDPOINT_HTML.items())
    return shaped.withColumn("html", F.expr(f"CASE shape {cases} END"))


# Versions of a part for the stream: a batch each, every part in two of three, with a name that tells the batch.
BATCHES = 3
VERSIONS_SQL = f"""versions AS (SELECT p.* REPLACE (p_name || ' v' || b AS p_name), p_name AS title, b AS batch
 FROM part p, generate_series(0, {BATCHES - 1}) g(b) WHERE p_partkey % {BATCHES} <> b)"""


def part_versions(parts: DataFrame, batch: int) -> DataFrame:
    chosen = parts.filter(F.col("p_partkey") % BATCHES != batch).withColumn("title", F.col("p_name"))
    return chosen.withColumn("p_name", F.concat("p_name", F.lit(f" v{batch}")))
