"""Predicates and constraints on items, content rows, paths and structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions.text import is_blank, strip

# Texts that mark an entry as not real, and phrases searched for.
PLACEHOLDER_TEXTS = ["Unknown Item", "Unknown Menu", "Unnamed Item", "Unnamed Menu", "Unnamed Sub-Item"]
PLACEHOLDER_PHRASES = ["coming soon", "placeholder", "todo", "tbd", "not available", "n/a"]
ENDPOINT_PHRASES = [
    "(get)", "(post)", "(put)", "(delete)", "(patch)",
    "query", "add", "create", "update", "delete", "modify",
    "get ", "set ", "list ", "remove ", "retrieve",
]
ITEM_TYPES = ["item", "menu"]


def contains_any(text: Column, phrases: list[str]) -> Column:
    """Case-insensitive substring match on any of some lower-case phrases."""
    quoted = "|".join(r"\Q" + p + r"\E" for p in phrases)
    return F.lower(text).rlike(quoted)


def filled(value: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(value != "", F.lit(False))


def skip_item(text: Column) -> Column:
    return is_blank(text) | F.coalesce(text.isin("Overview", *PLACEHOLDER_TEXTS), F.lit(False))


def entry_valid(item_id: Column, text: Column, kind: Column) -> Column:
    """Needs text and type, and unless it is a menu also an id."""
    is_menu = F.coalesce(kind == "menu", F.lit(False))
    return filled(text) & filled(kind) & (is_menu | filled(item_id))


def id_ok(item_id: Column, kind: Column) -> Column:
    """Only rows of type item must have an id."""
    return filled(item_id) | F.coalesce(kind != "item", F.lit(True))


def add_entry(item_id: Column, text: Column, kind: Column) -> Column:
    return ~skip_item(text) & id_ok(item_id, kind) & filled(text) & filled(kind)


def valid_item(item_id: Column, text: Column, kind: Column, mode: str = "model") -> Column:
    """``model``: an id and type item. ``dict``: id and text filled, any type."""
    if mode == "model":
        return item_id.isNotNull() & F.coalesce(kind == "item", F.lit(False))
    return filled(item_id) & filled(text)


def looks_like_endpoint(text: Column) -> Column:
    return F.coalesce(contains_any(text, ENDPOINT_PHRASES), F.lit(False))


def not_placeholder(item_id: Column, text: Column) -> Column:
    return filled(item_id) & filled(text) & ~F.coalesce(contains_any(text, PLACEHOLDER_PHRASES), F.lit(False))


def item_fault(text: Column, kind: Column, level: Column) -> Column:
    """Why an item row breaks the item model, or null."""
    return (
        F.when(~F.coalesce(kind.isin(*ITEM_TYPES), F.lit(False)), F.lit("bad type"))
        .when(is_blank(text), F.lit("blank text"))
        .when(F.coalesce(level < 0, F.lit(True)), F.lit("negative level"))
    )


def content_fault(item_id: Column, title: Column, url: Column, markdown: Column) -> Column:
    """Why a content row breaks the content model, or null."""
    blank = (
        F.when(is_blank(item_id), F.lit("blank item_id"))
        .when(is_blank(title), F.lit("blank title"))
        .when(is_blank(url), F.lit("blank url"))
        .when(is_blank(markdown), F.lit("blank markdown_content"))
    )
    return F.coalesce(blank, F.when(~strip(url).rlike("^https?://"), F.lit("bad url")))


def header_fault(header_text: Column) -> Column:
    """Why a header group breaks the group model, or null."""
    return F.when(is_blank(header_text), F.lit("blank header_text"))


def quarantine(df: DataFrame, fault: Column, trimmed: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Good rows, text columns trimmed, and bad rows with their ``fault``."""
    marked = df.withColumn("fault", fault)
    good = marked.filter(F.col("fault").isNull()).drop("fault")
    for name in trimmed:
        good = good.withColumn(name, strip(F.col(name)))
    return good, marked.filter(F.col("fault").isNotNull())


def path_safe(path: Column) -> Column:
    """Lexical safety: no parent or home references, no empty, hidden or over-long part."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    bad_part = F.exists(parts, lambda p: (p == "") | (p.startswith(".") & (p != ".")) | (F.length(p) > 255))
    return F.coalesce(~path.rlike(r"\.\.|~|//") & ~bad_part, F.lit(False))


def path_excluded(path: Column, patterns: list[str], extensions: list[str] | None = None) -> Column:
    """Path holds one of the substrings, or ends in another extension than those given."""
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | path.contains(pattern)
    if extensions:
        wanted = F.lit(False)
        for extension in extensions:
            wanted = wanted | path.endswith(extension)
        hit = hit | ~wanted
    return hit


def structure_acceptable(items: DataFrame, keys: list[str], least: int = 10, share: float = 0.1) -> DataFrame:
    """Per saved structure, its counts and whether it is good enough to reuse."""
    valid = F.count_if(valid_item(F.col("id"), F.col("text"), F.col("type")))
    counted = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), valid.alias("valid"))
    good = (F.col("valid") >= least) & (F.col("valid") > F.col("total") * share)
    return counted.withColumn("acceptable", good)
