"""Registered queries: string functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from docengine.functions import text as X
from docengine.operators import navigation, rules, summaries
from docengine.plans import bindings as B
from docengine.plans import sql_parts as S
from docengine.plans.registry import query

col = F.col
TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"


def documents(spark, d):
    return B.documents(spark, d, "doc_id", "text", "lang", "source")


def md_query(name: str, make, sql_expr: str):
    """Doc id and the result of one Markdown function over the faulty documents."""

    @query(name, f"WITH {B.MD_SQL} SELECT doc_id, {sql_expr} AS result FROM md")
    def run(spark, d):
        return B.md(spark, d).select("doc_id", make(col("text")).alias("result"))

    return run


# --- names, ids and paths -----------------------------------------------------------


@query("x1_clean_text", f"SELECT doc_id, {S.clean('text')} AS result FROM documents")
def x1(spark, d):
    return documents(spark, d).select("doc_id", X.clean_text(col("text")).alias("result"))


@query("x2_slugify", f"SELECT doc_id, {S.slug('text')} AS slug, {S.slug('lang || source')} AS source_slug FROM documents")
def x2(spark, d):
    source = X.slugify(F.concat("lang", "source"))
    return documents(spark, d).select("doc_id", X.slugify(col("text")).alias("slug"), source.alias("source_slug"))


def _unicode_slug(text: str) -> str:
    dashed = S.sub(f"nfc_normalize(coalesce({text}, ''))", rf"[-{S.WS}_/\\]+", "-")
    short = f"trim(lower({S.sub(dashed, r'[^\p{L}\p{N}_.-]', '')}), '-_.')"
    return f"(CASE WHEN length({short}) > 100 THEN rtrim(left({short}, 100), '-_.') ELSE {short} END)"


# Compatibility characters, and what they are composed to.
_COMPAT = {"ﬁ": "fi", "½": "1⁄2", "²": "2", "Ａ": "A", "…": "..."}
_MIXED = " || ".join(["lang", "' '", *[f"'{c}'" for c in _COMPAT], "' '", "text"])
_MIXED_SQL = " || ".join(["lang", "' '", *[f"'{c}'" for c in _COMPAT.values()], "' '", "text"])


@query("x2_slugify_unicode", f"SELECT doc_id, {_unicode_slug('text')} AS slug, {_unicode_slug(_MIXED_SQL)} AS mixed_slug FROM documents")
def x2_unicode(spark, d):
    mixed = X.slugify(F.expr(_MIXED), allow_unicode=True)
    return documents(spark, d).select("doc_id", X.slugify(col("text"), allow_unicode=True).alias("slug"), mixed.alias("mixed_slug"))


def _synthetic(text: str) -> str:
    kept = S.sub(f"lower({text})", rf"[^\p{{L}}\p{{N}}_{S.WS}-]", "")
    return f"'synthetic-' || trim({S.sub(S.sub(kept, f'{S.W}+', '-'), '-+', '-')}, '-')"


_X3_TEXT = "'Get -- ' || p_name || '  (' || p_brand || ') & _v' || p_size"


@query("x3_synthetic_id", f"SELECT p_partkey, {_synthetic(_X3_TEXT)} AS synthetic_id FROM part")
def x3(spark, d):
    return B.table(spark, d, "part").select("p_partkey", X.synthetic_id(F.expr(_X3_TEXT)).alias("synthetic_id"))


_X4_ID = "' _-' || p_brand || '-' || p_partkey || '_ ' || chr(10)"


@query("x4_normalize_id", f"SELECT p_partkey, trim({_X4_ID}, '{S.CHARS}-_') AS norm_id FROM part")
def x4(spark, d):
    return B.table(spark, d, "part").select("p_partkey", X.normalize_id(F.expr(_X4_ID)).alias("norm_id"))


@query("x5_output_path", f"WITH {B.FLAWED_SQL} SELECT pos, {S.path('header', 'menu', 'text')} AS output_path FROM flawed")
def x5(spark, d):
    made = X.output_path(col("header"), col("menu"), col("text"))
    return B.flawed_catalog(spark, d).select("pos", made.alias("output_path"))


def _filename(text: str, item_id: str) -> str:
    kept = S.rstrip(S.sub(text, r"[^\p{L}\p{N} _-]", ""))
    return f"left(replace({kept}, ' ', '_'), 50) || '_' || coalesce({item_id}, 'None') || '.md'"


@query("x6_output_filename", f"WITH {B.FLAWED_SQL} SELECT pos, {_filename('text', 'id')} AS file_name FROM flawed")
def x6(spark, d):
    return B.flawed_catalog(spark, d).select("pos", X.output_filename(col("text"), col("id")).alias("file_name"))


# --- Markdown repair -------------------------------------------------------------------


def _cleanup(text: str) -> str:
    for pattern, replacement in X.CLEANUP_RULES:
        text = S.sub(text, pattern, replacement.replace("$1", r"\1"))
    return text


def _headers(text: str) -> str:
    spaced = S.sub(text, rf"(?m)^({S.WN}*)(#+){S.WN_NO_BLANK}{S.WN}*", r"\1\2 ")
    return S.sub(spaced, rf"(?m)^({S.WN}*)(#+)([^#{S.WS}])", r"\1\2 \3")


_SEPARATOR = rf"\|{S.W}*-+{S.W}*\|"


def _separators(text: str) -> str:
    gaps = f"string_split_regex({text}, '{_SEPARATOR}')"
    marks = f"regexp_extract_all({text}, '{_SEPARATOR}')"
    dashes = f"list_transform({marks}, lambda m: '|' || repeat('-', length(m) - 2) || '|')"
    return f"array_to_string(list_transform(list_zip({gaps}, {dashes}), lambda z: z[1] || coalesce(z[2], '')), '')"


def _spacing(text: str) -> str:
    """Sequential rule restated over (before, line, after) flags with list indexes from 1."""
    lines = f"string_split({text}, chr(10))"
    is_table = f"list_transform(ls, lambda l: starts_with({S.strip('l')}, '|') AND ends_with({S.strip('l')}, '|'))"
    t = lambda i: f"coalesce(ts[{i}] AND {i} >= 1, false)"
    full = lambda i: f"({i} >= 1 AND coalesce({S.strip(f'ls[{i}]')} <> '', false))"
    leaves = lambda i: f"(NOT {t(i)} AND {t(f'{i} - 1')})"
    before = f"{t('i')} AND NOT {t('i - 1')} AND {full('i - 1')} AND NOT ({leaves('i - 1')} AND i - 1 >= 1)"
    after = f"{leaves('i')} AND {full('i + 1')}"
    emit = f"CASE WHEN {before} THEN chr(10) ELSE '' END || l || CASE WHEN {after} THEN chr(10) ELSE '' END"
    inner = f"SELECT array_to_string(list_transform(ls, lambda l, i: {emit}), chr(10)) FROM (SELECT ls, {is_table} AS ts FROM (SELECT {lines} AS ls))"
    return f"({inner})"


def _whitespace(text: str) -> str:
    stop = "(length(a) - coalesce(length(a) - length(string_split(a, chr(13))[-1]), 0)) % 4"
    expand = f"list_reduce(string_split(l, chr(9)), lambda a, x: a || repeat(' ', 4 - {stop}) || x)"
    return f"array_to_string(list_transform(string_split({text}, chr(10)), lambda l: {S.rstrip(expand)}), chr(10))"


def _squeeze(text: str) -> str:
    return S.sub(text, "\n{3,}", "\n\n")


md_query("x8_cleanup_patterns", X.cleanup_patterns, _cleanup("text"))
md_query("x9_fix_headers", X.fix_headers, _headers("text"))
md_query("x11_normalize_ws", X.normalize_ws, _whitespace("text"))
md_query("x12_squeeze_blank", X.squeeze_blank, _squeeze("text"))
md_query("x13_strip_comments", X.strip_comments, S.sub("text", "(?s)<!--.*?-->", ""))

def _code_blocks(text: str) -> str:
    # A line end that follows directly cannot be a fence, so the rule needs no lookahead here.
    closed = S.sub(text, "(?ms)^```([^`\n]*)\n(.*?)\n$", "```\\1\n\\2\n```")
    return S.sub(S.sub(closed, "(\n```[^\n]*\n)", "\n\\1"), "(\n```\n)", "\\1\n")


md_query("x14_fix_code_blocks", X.fix_code_blocks, _code_blocks("text"))
md_query("x17_checksum", X.checksum, "sha256(text)")

_STEPS_SQL = (
    f"a AS (SELECT doc_id, {_separators('text')} AS text FROM src), b AS (SELECT doc_id, {_spacing('text')} AS text FROM a)"
)


@query("x10_clean_md_tables", f"WITH {B.MD_SQL}, src AS (SELECT * FROM md), {_STEPS_SQL} SELECT doc_id, text AS result FROM b")
def x10(spark, d):
    return B.md(spark, d).select("doc_id", X.clean_md_tables(col("text")).alias("result"))


def sanitized_ctes(source: str) -> str:
    """``sane(doc_id, result)`` from a table (doc_id, text)."""
    return (
        f"s1 AS (SELECT doc_id, {_cleanup('text')} AS text FROM {source}), "
        f"src AS (SELECT doc_id, {_headers('text')} AS text FROM s1), {_STEPS_SQL}, "
        f"c AS (SELECT doc_id, {_whitespace('text')} AS text FROM b), "
        f"sane AS (SELECT doc_id, {S.strip(_squeeze('text'))} AS result FROM c)"
    )


@query("x7_sanitize", f"WITH {B.MD_SQL}, {sanitized_ctes('md')} SELECT doc_id, result FROM sane")
def x7(spark, d):
    return B.md(spark, d).select("doc_id", X.sanitize(col("text")).alias("result"))


_X15_SQL = f"""
WITH {B.MD_SQL},
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM md),
near AS (
  SELECT *, lag(line) OVER w AS above FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
marked AS (
  SELECT *, regexp_full_match({S.strip('line')}, '[=-]+') AND {S.strip('above')} <> '' AND NOT starts_with({S.strip('above')}, '#') AS rule_line
  FROM near
),
next AS (
  SELECT *, lead(rule_line) OVER w AS ruled, lead(line) OVER w AS below FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY i)
)
SELECT doc_id, string_agg(CASE WHEN ruled THEN CASE WHEN contains(below, '=') THEN '# ' ELSE '## ' END || {S.strip('line')} ELSE line END,
                          chr(10) ORDER BY i) AS result
FROM next WHERE NOT coalesce(rule_line, false) GROUP BY doc_id"""


@query("x15_setext_to_atx", _X15_SQL)
def x15(spark, d):
    return B.md(spark, d).select("doc_id", X.setext_to_atx(col("text")).alias("result"))


def _counted(text: str, mark: str) -> str:
    return f"((length({text}) - length(replace({text}, '{mark}', ''))) // {len(mark)})"


def _balanced(text: str, mark: str) -> str:
    double = _counted(text, mark * 2)
    return f"({double} % 2 = 0 AND ({_counted(text, mark)} - 2 * {double}) % 2 = 0)"


def _checks(text: str) -> str:
    row = f"list_transform(string_split({text}, chr(10)), lambda l: NOT contains(l, '|') OR (starts_with({S.strip('l')}, '|') AND ends_with({S.strip('l')}, '|')))"
    return f"""regexp_matches({text}, '(?m)^#+{S.W}+[^\n]') AS has_headers,
  length(regexp_extract_all({text}, '(?m)^```')) % 2 = 0 AS has_proper_code_blocks,
  {_balanced(text, '*')} AND {_balanced(text, '_')} AS has_balanced_emphasis,
  NOT regexp_matches({text}, '\\[([^\\]]+)\\]\\({S.W}*\\)') AS has_valid_links,
  NOT list_contains({row}, false) AS has_clean_tables"""


@query(
    "x16_md_checks",
    f"WITH {B.MD_SQL} SELECT doc_id, 'raw' AS form, {_checks('text')} FROM documents "
    f"UNION ALL SELECT doc_id, 'faulty', {_checks('text')} FROM md",
)
def x16(spark, d):
    raw = documents(spark, d).select("doc_id", F.lit("raw").alias("form"), "text")
    both = raw.unionByName(B.md(spark, d).withColumn("form", F.lit("faulty")))
    return both.withColumn("c", X.md_checks(col("text"))).select("doc_id", "form", "c.*")


_CRUMBS = "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN {empty} ELSE {some} END"


@query(
    "x18_content_facts",
    "SELECT doc_id, length(text)::INTEGER AS content_length, doc_id % 3 = 2 AS has_breadcrumbs FROM documents",
)
def x18(spark, d):
    crumbs = F.expr(_CRUMBS.format(empty="cast(array() AS array<string>)", some="array(lang, source)"))
    return documents(spark, d).select(
        "doc_id", X.content_length(col("text")).alias("content_length"), X.has_breadcrumbs(crumbs).alias("has_breadcrumbs")
    )


_STAMP = "CASE WHEN event_id % 10 = 0 THEN 'not a time' ELSE {iso} END"


@query(
    "x19_iso_time",
    "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN epoch_us(ts) ELSE -1 END AS micros FROM events",
)
def x19(spark, d):
    iso = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
    parsed = X.iso_time(F.expr(_STAMP.format(iso=iso)))
    return B.table(spark, d, "events").select("event_id", F.coalesce(F.unix_micros(parsed), F.lit(-1)).alias("micros"))


# --- predicates ----------------------------------------------------------------------


def flawed_query(name: str, column: str, make, sql_expr: str):
    @query(name, f"WITH {B.FLAWED_SQL} SELECT pos, {sql_expr} AS {column} FROM flawed")
    def run(spark, d):
        return B.flawed_catalog(spark, d).select("pos", make().alias(column))

    return run


def _abc():
    return col("id"), col("text"), col("type")


_PLACEHOLDERS = ", ".join(f"'{t}'" for t in ["Overview", *rules.PLACEHOLDER_TEXTS])
_SKIP = f"({S.blank('text')} OR coalesce(text IN ({_PLACEHOLDERS}), false))"
_VALID = f"({S.filled('text')} AND {S.filled('type')} AND (coalesce(type = 'menu', false) OR {S.filled('id')}))"
_ID_OK = f"({S.filled('id')} OR coalesce(type <> 'item', true))"

flawed_query("p1_skip_item", "skipped", lambda: rules.skip_item(col("text")), _SKIP)
flawed_query("p2_entry_valid", "valid", lambda: rules.entry_valid(*_abc()), _VALID)
flawed_query("p3_id_required", "id_ok", lambda: rules.id_ok(col("id"), col("type")), _ID_OK)
flawed_query(
    "p4_add_entry", "added", lambda: rules.add_entry(*_abc()),
    f"(NOT {_SKIP} AND {_ID_OK} AND {S.filled('text')} AND {S.filled('type')})",
)


@query(
    "p5_valid_items",
    f"WITH {B.FLAWED_SQL} SELECT pos, 'model' AS mode FROM flawed WHERE id IS NOT NULL AND type = 'item' "
    f"UNION ALL SELECT pos, 'dict' FROM flawed WHERE {S.filled('id')} AND {S.filled('text')}",
)
def p5(spark, d):
    items = B.flawed_catalog(spark, d)
    modes = [items.filter(rules.valid_item(*_abc(), m)).select("pos", F.lit(m).alias("mode")) for m in ("model", "dict")]
    return modes[0].unionByName(modes[1])


_P6_TEXT = "text || CASE doc_id % 6 WHEN 0 THEN ' (POST) x' WHEN 1 THEN ' RETRIEVE all' WHEN 2 THEN ' Set it' WHEN 3 THEN ' set' ELSE '' END"


@query("p6_looks_like_endpoint", f"SELECT doc_id FROM documents WHERE {S.any_of(_P6_TEXT, rules.ENDPOINT_PHRASES)}")
def p6(spark, d):
    return documents(spark, d).filter(rules.looks_like_endpoint(F.expr(_P6_TEXT))).select("doc_id")


_P7_TEXT = "CASE doc_id % 9 WHEN 1 THEN text || ' (TBD)' WHEN 2 THEN 'Coming Soon: ' || lang WHEN 3 THEN '' ELSE text END"
_P7_OK = f"(t <> '' AND NOT {S.any_of('t', rules.PLACEHOLDER_PHRASES)})"


@query(
    "p7_placeholder_filter",
    f"SELECT lang, count(*) AS total_items, count(*) FILTER ({_P7_OK}) AS valid_items, count(*) FILTER (NOT {_P7_OK}) AS invalid_items "
    f"FROM (SELECT lang, {_P7_TEXT} AS t FROM documents) GROUP BY lang",
)
def p7(spark, d):
    rows = documents(spark, d).select("lang", col("doc_id").cast("string").alias("id"), F.expr(_P7_TEXT).alias("text"))
    return summaries.placeholder_counts(rows, rules.not_placeholder(col("id"), col("text")), ["lang"])


@query(
    "p8_item_constraints",
    f"""WITH {B.FLAWED_SQL}, f AS (SELECT *, CASE WHEN NOT coalesce(type IN ('item', 'menu'), false) THEN 'bad type'
 WHEN {S.blank('text')} THEN 'blank text' WHEN coalesce(level < 0, true) THEN 'negative level' END AS fault FROM flawed)
SELECT pos, coalesce(fault, 'none') AS fault, CASE WHEN fault IS NULL THEN {S.strip('text')} ELSE text END AS text FROM f""",
)
def p8(spark, d):
    fault = rules.item_fault(col("text"), col("type"), col("level"))
    good, bad = rules.quarantine(B.flawed_catalog(spark, d), fault, ("text",))
    return good.withColumn("fault", F.lit("none")).unionByName(bad).select("pos", "fault", "text")


_P9_URL = "CASE page_id % 4 WHEN 0 THEN 'ftp:' || url WHEN 1 THEN ' ' || url ELSE url END"
_P9_ID = "CASE page_id % 7 WHEN 0 THEN '  ' ELSE 'p-' || page_id END"


@query(
    "p9_content_constraints",
    f"""WITH r AS (SELECT page_id, {_P9_ID} AS item_id, {TITLE} AS title, {_P9_URL} AS url, html FROM pages)
SELECT page_id, CASE WHEN {S.blank('item_id')} THEN 'blank item_id' WHEN {S.blank('title')} THEN 'blank title'
 WHEN {S.blank('url')} THEN 'blank url' WHEN {S.blank('html')} THEN 'blank markdown_content'
 WHEN NOT regexp_matches({S.strip('url')}, '^https?://') THEN 'bad url' ELSE 'none' END AS fault FROM r""",
)
def p9(spark, d):
    rows = B.table(spark, d, "pages").select(
        "page_id", F.expr(_P9_ID).alias("item_id"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        F.expr(_P9_URL).alias("url"), "html",
    )
    fault = rules.content_fault(col("item_id"), col("title"), col("url"), col("html"))
    return rows.select("page_id", F.coalesce(fault, F.lit("none")).alias("fault"))


_P13_PATH = (
    "CASE p_partkey % 8 WHEN 0 THEN 'out/../' || p_name WHEN 1 THEN '~/' || p_brand WHEN 2 THEN 'out//' || p_name"
    " WHEN 3 THEN 'out/.hidden/x.md' WHEN 4 THEN '/out/./' || p_name WHEN 5 THEN 'out/' || repeat(p_name || 'x', 40)"
    " ELSE 'out/' || p_brand || '/' || p_name || '.md' END"
)


@query(
    "p13_path_safe",
    f"""WITH r AS (SELECT p_partkey, {_P13_PATH} AS path FROM part)
SELECT p_partkey, NOT (contains(path, '..') OR contains(path, '~') OR contains(path, '//')) AND NOT list_contains(
  list_transform(string_split(CASE WHEN starts_with(path, '/') THEN path[2:] ELSE path END, '/'),
  lambda p: p = '' OR (starts_with(p, '.') AND p <> '.') OR length(p) > 255), true) AS safe FROM r""",
)
def p13(spark, d):
    return B.table(spark, d, "part").select("p_partkey", rules.path_safe(F.expr(_P13_PATH)).alias("safe"))


@query(
    "p14_path_excluded",
    "SELECT page_id, contains(url, 'example.net') OR contains(url, '?page=') OR NOT (ends_with(url, '5') OR ends_with(url, 'top')) AS excluded FROM pages",
)
def p14(spark, d):
    hit = rules.path_excluded(col("url"), ["example.net", "?page="], ["5", "top"])
    return B.table(spark, d, "pages").select("page_id", hit.alias("excluded"))


# --- page-level text rules --------------------------------------------------------------


_N2_TEXT = "CASE doc_id % 4 WHEN 0 THEN 'INTRODUCTION: ' || text WHEN 1 THEN text || ' Api Reference' ELSE text END"


@query(
    "n2_standalone_pages",
    f"SELECT DISTINCT doc_id, lang FROM documents WHERE {S.any_of(_N2_TEXT, navigation.STANDALONE_TOPICS)}",
)
def n2(spark, d):
    hits = documents(spark, d).filter(navigation.is_standalone(F.expr(_N2_TEXT)))
    return hits.select("doc_id", "lang").distinct()


_N3_URL = "CASE WHEN page_id % 2 = 0 THEN url || '/versions/3.' || (page_id % 7) || '/docs' ELSE url END"


@query(
    "n3_endpoint_version",
    f"SELECT page_id, coalesce(nullif(regexp_extract({_N3_URL}, '/versions/([0-9]+\\.[0-9]+)/', 1), ''), '4.6') AS version FROM pages",
)
def n3(spark, d):
    return B.table(spark, d, "pages").select("page_id", X.endpoint_version(F.expr(_N3_URL)).alias("version"))


_VISIBLE = S.strip(
    S.sub(S.sub("html", r"(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<[^>]*>", " "), f"{S.W}+", " ")
)
_N6_HTML = "CASE page_id % 5 WHEN 0 THEN html || '<p>Please wait</p>' WHEN 1 THEN '<script>' || html || '</script>' ELSE html END"


@query(
    "n6_content_ready",
    f"""WITH r AS (SELECT page_id, {_N6_HTML} AS html FROM pages)
SELECT page_id, length({S.strip('html')}) >= 100 AND length({_VISIBLE}) >= 50 AND NOT {S.any_of(_VISIBLE, navigation.LOADING_WORDS)} AS ready FROM r""",
)
def n6(spark, d):
    return B.table(spark, d, "pages").select("page_id", navigation.content_ready(F.expr(_N6_HTML)).alias("ready"))
