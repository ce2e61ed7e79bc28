"""Counts, audits, rankings and tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docengine.functions.text import let, one_decimal, strip
from docengine.operators.ordered import running_row_number
from docengine.operators.rules import valid_item

# Line limits of the size check, threshold of the oversize list.
MODULE_LIMIT, MODULE_TARGET, OVERSIZE = 300, 250, 500


def group_by_menu(items: DataFrame, pos: str) -> DataFrame:
    """Every item with its menu's key, its index in the menu and the menu's size.

    A menu can hold any share of the items, so its ordered list stays a column of indexes.
    """
    key = F.coalesce(F.nullif(F.col("menu"), F.lit("")), F.lit("no_menu"))
    keyed = running_row_number(items.withColumn("menu_key", key), ["menu_key"], pos, "index_in_menu")
    sizes = keyed.groupBy("menu_key").agg(F.count(F.lit(1)).alias("group_size"))
    return keyed.join(sizes, "menu_key")


def structure_counts(items: DataFrame, keys: list[str]) -> DataFrame:
    """Total, valid, menu and content items."""
    kind = F.col("type")
    return items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(valid_item(F.col("id"), F.col("text"), kind)).alias("valid_items"),
        F.count_if(kind == "menu").alias("menu_items"),
        F.count_if(kind == "item").alias("content_items"),
    )


def placeholder_counts(items: DataFrame, valid: Column, keys: list[str]) -> DataFrame:
    counted = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_items"), F.count_if(valid).alias("valid_items"))
    return counted.withColumn("invalid_items", F.col("total_items") - F.col("valid_items"))


# --- run outcomes --------------------------------------------------------------


def outcome_tally(runs: DataFrame, succeeded: Column, failed: Column, keys: list[str]) -> DataFrame:
    """``succeeded`` is true, false or null (neither); an error counts as failed."""
    bad = F.coalesce(failed, F.lit(False)) | F.coalesce(~succeeded, F.lit(False))
    good = F.coalesce(succeeded, F.lit(False)) & ~bad
    return runs.groupBy(*keys).agg(
        F.count_if(good).alias("processed"), F.count_if(bad).alias("failed"), F.count_if(~good & ~bad).alias("skipped")
    )


def merge_tallies(parts: DataFrame, keys: list[str], counters: tuple[str, ...] = ("processed", "failed", "skipped")) -> DataFrame:
    """Sum partial tallies; a missing counter is 0."""
    have = [F.coalesce(F.sum(c), F.lit(0)).alias(c) if c in parts.columns else F.lit(0).alias(c) for c in counters]
    return parts.groupBy(*keys).agg(*have)


def final_summary(runs: DataFrame, status: Column, keys: list[str]) -> DataFrame:
    """Attempted items and success rate over four outcomes."""
    names = ["processed", "skipped", "errors", "no_content"]
    counted = runs.withColumn("_status", status).groupBy(*keys).agg(
        *[F.count_if(F.col("_status") == n).alias(n) for n in names]
    )
    attempted = F.col("processed") + F.col("skipped") + F.col("errors") + F.col("no_content")
    rate = F.when(F.col("attempted") > 0, F.col("processed") / F.col("attempted") * 100).otherwise(F.lit(0.0))
    return counted.withColumn("attempted", attempted).withColumn("success_rate", F.concat(one_decimal(rate), F.lit("%")))


# --- text audits -------------------------------------------------------------------


def line_counts(text: Column) -> Column:
    """total, code, comment and blank lines; a final line end starts no line."""

    def count(lines: Column) -> Column:
        def comment(line: Column) -> Column:
            return line.startswith("#") | line.contains('"""') | line.contains("'''")

        blank = F.size(F.filter(lines, lambda l: l == ""))
        comments = F.size(F.filter(lines, comment))
        return F.struct(
            F.size(lines).alias("total_lines"),
            (F.size(lines) - blank - comments).alias("code_lines"),
            comments.alias("comment_lines"),
            blank.alias("blank_lines"),
        )

    split = F.split(text, "\r\n|[\r\n]", -1)
    ended = let(split, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))
    return let(F.transform(ended, strip), count)


def line_audit(texts: DataFrame, text: str = "text") -> DataFrame:
    """Add line counts and size in bytes; unreadable (null) text has no lines."""
    counted = texts.withColumn("_lines", line_counts(F.coalesce(F.col(text), F.lit(""))))
    size = F.coalesce(F.octet_length(text), F.lit(0)) if "size_bytes" not in texts.columns else F.col("size_bytes")
    return counted.withColumn("size_bytes", size).select("*", "_lines.*").drop("_lines", text)


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count(F.lit(1)).alias("total_files"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}" if not c.startswith("total") else c)
          for c in ("total_lines", "code_lines", "comment_lines", "size_bytes")],
    )


def relevant_lines(text: Column) -> Column:
    """Lines that are neither blank nor a hash comment; all Unicode line ends count."""
    lines = F.split(text, r"\r\n|[\n\x{b}\x{c}\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]", -1)
    return F.size(F.filter(F.transform(lines, strip), lambda l: (l != "") & ~l.startswith("#")))


def size_violations(
    texts: DataFrame, text: str = "text", strict: bool = False, limit: int = MODULE_LIMIT, target: int = MODULE_TARGET
) -> DataFrame:
    """Texts over the limit (strict: over the target), with the excess over the limit."""
    counted = texts.withColumn("line_count", relevant_lines(F.col(text))).drop(text)
    over = counted.filter(F.col("line_count") > (target if strict else limit))
    return over.withColumn("kind", F.lit("Module")).withColumn("excess", F.col("line_count") - limit)


def violation_counts(violations: DataFrame) -> DataFrame:
    """How many violations of each kind, and the largest excess."""
    return violations.groupBy("kind").agg(F.count(F.lit(1)).alias("violations"), F.max("excess").alias("largest_excess"))


def oversized(audit: DataFrame, threshold: int = OVERSIZE) -> DataFrame:
    return audit.filter(F.col("total_lines") > threshold)


def largest_first(audit: DataFrame, tie: str) -> DataFrame:
    return audit.orderBy(F.desc("total_lines"), tie)


def top_by_lines(audit: DataFrame, tie: str, n: int = 20) -> DataFrame:
    """Ranked report of the longest texts, size in KB to one decimal."""
    best = audit.orderBy(F.desc("total_lines"), tie).limit(n)
    # The window runs over the n rows the limit leaves.
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total_lines"), tie)))
    return ranked.withColumn("size_kb", one_decimal(F.col("size_bytes") / 1024))


def max_items(items: DataFrame, pos: str, n: int | None) -> DataFrame:
    """The first ``n`` items in order; null, zero or less means all of them."""
    return items.orderBy(pos).limit(n) if n is not None and n > 0 else items
