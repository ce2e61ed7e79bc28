"""Resume and publish logic: what exists, what is pending, what collides."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions.text import (
    checksum,
    join_path,
    menu_folder,
    normalize_id,
    one_decimal,
    output_filename,
    output_path,
    sanitize,
    slugify,
)
from docengine.operators import rules


def with_output_path(items: DataFrame, base: str = "output") -> DataFrame:
    return items.withColumn("output_path", output_path(F.col("header"), F.col("menu"), F.col("text"), base))


def _by_key(items: DataFrame, known: DataFrame, key: str, how: str) -> DataFrame:
    # Only the items' side can repeat a key without bound; adaptive execution splits it where it does.
    return items.join(known.select(key), key, how)


def existing_items(items: DataFrame, published: DataFrame, key: str = "output_path") -> DataFrame:
    """Items whose output is already there."""
    return _by_key(items, published, key, "left_semi")


def pending_items(items: DataFrame, published: DataFrame, key: str = "output_path") -> DataFrame:
    """Items whose output is missing."""
    return _by_key(items, published, key, "left_anti")


def existing_by_filename(items: DataFrame, files: DataFrame, by_id: bool = False) -> DataFrame:
    """Items whose output exists under ``<text>_<id>.md``, or ``<id>.md`` with ``by_id``;
    ``files`` has ``file_name``."""
    name = F.concat("id", F.lit(".md")) if by_id else output_filename(F.col("text"), F.col("id"))
    named = items.withColumn("file_name", name)
    return _by_key(named, files, "file_name", "left_semi")


def write_actions(items: DataFrame, published: DataFrame, force: bool = False) -> DataFrame:
    """Action per item: ``write``, ``skip_same`` or ``skip_differs``.

    ``items`` has output_path and sha256 of the new content, ``published`` one row
    per output_path with the stored sha256.
    """
    if force:
        return items.withColumn("action", F.lit("write"))
    known = published.select("output_path", F.col("sha256").alias("_stored"))
    joined = items.join(known, "output_path", "left")
    action = (
        F.when(F.col("_stored").isNull(), F.lit("write"))
        .when(F.col("_stored") == F.col("sha256"), F.lit("skip_same"))
        .otherwise(F.lit("skip_differs"))
    )
    return joined.withColumn("action", action).drop("_stored")


def reference_map(items: DataFrame, pos: str = "pos") -> DataFrame:
    """Normalized id to item; the last item of an id wins, items without an id are left out.

    The winner is picked by an aggregate that merges before the shuffle, so an id
    shared by many rows costs one row per map task.
    """
    with_id = items.filter(rules.filled(F.col("id"))).withColumn("norm_id", normalize_id(F.col("id")))
    return with_id.groupBy("norm_id").agg(F.max_by(F.struct(*items.columns), pos).alias("item"))


def duplicate_ids(items: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows whose normalized id leads to a different item; equal copies are fine."""
    value = [c for c in items.columns if c != pos]
    winners = reference_map(items, pos).select("norm_id", F.struct(*[F.col(f"item.{c}") for c in value]).alias("_winner"))
    with_id = items.filter(rules.filled(F.col("id"))).withColumn("norm_id", normalize_id(F.col("id")))
    joined = with_id.join(winners, "norm_id", "left")
    differs = ~F.struct(*value).eqNullSafe(F.col("_winner"))
    shown = F.coalesce(F.col("text"), F.lit("Unknown"))
    message = F.concat(F.lit("Duplicate ID found: "), F.col("id"), F.lit(" for item '"), shown, F.lit("'"))
    return joined.filter(differs).withColumn("message", message).drop("_winner")


def path_collisions(items: DataFrame) -> DataFrame:
    """Items that share their output path with others, and how many share it."""
    shared = items.groupBy("output_path").agg(F.count(F.lit(1)).alias("sharing")).filter(F.col("sharing") > 1)
    return items.join(shared, "output_path")


def resume_summary(items: DataFrame, exists: Column, keys: list[str] | None = None) -> DataFrame:
    """Total, existing, remaining, both percentages and the one-line report."""
    counted = items.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(exists).alias("existing")
    )
    done = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("existing") / F.col("total") * 100.0)
    line = F.format_string(
        "Resume Info: %d/%d complete (%s%%), %d remaining", "existing", "total", one_decimal(F.col("completion")), "remaining"
    )
    return (
        counted.withColumn("remaining", F.col("total") - F.col("existing"))
        .withColumn("completion", done)
        .withColumn("remaining_share", F.lit(100.0) - F.col("completion"))
        .withColumn("report", line)
    )


def _heads(rows: DataFrame, pos: str, show: int) -> DataFrame:
    """One row: the number of rows and the first ``show`` by ``pos`` (null first), from one pass; a task keeps ``show`` rows."""
    kind = rows.schema[pos].dataType.simpleString()

    def head(batches):
        count, best = 0, None
        for batch in batches:
            count += batch.num_rows
            table = pa.Table.from_batches([batch]) if best is None else pa.concat_tables([best, pa.Table.from_batches([batch])])
            keys = [(c, "ascending") for c in table.column_names]
            best = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start")[:show])
        if count:
            first = best.to_struct_array().combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array([count]), pa.ListArray.from_arrays(pa.array([0, len(first)], pa.int32()), first)], names=["n", "head"])

    thin = rows.select(F.col(pos).alias("pos"), F.col("text").cast("string").alias("text"), F.col("id").cast("string").alias("id"))
    parts = thin.mapInArrow(head, f"n long, head array<struct<pos:{kind},text:string,id:string>>")
    return parts.agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("head"))), 1, show).alias("head"))


def next_pending(pending: DataFrame, pos: str, show: int = 5) -> DataFrame:
    """The first few pending items as numbered lines, and one line for the rest."""
    entries = F.transform(
        "head",
        lambda x, i: F.struct(i.alias("line"), F.concat(
            (i + 1).cast("string"), F.lit(". "), F.coalesce(x["text"], F.lit("Unknown")), F.lit(" (ID: "),
            F.coalesce(x["id"], F.lit("Unknown")), F.lit(")"),
        ).alias("entry")),
    )
    more = F.concat(F.lit("... and "), (F.col("n") - show).cast("string"), F.lit(" more items"))
    rest = F.when(F.col("n") > show, F.array(F.struct(F.lit(show).alias("line"), more.alias("entry"))))
    lines = F.concat(entries, F.coalesce(rest, F.slice(F.array(F.struct(F.lit(0).alias("line"), F.lit("").alias("entry"))), 1, 0)))
    return _heads(pending, pos, show).select(F.inline(lines))


def publish_paths(content: DataFrame, base: str = "output") -> DataFrame:
    """Content rows with header_slug, menu_slug and output_path; rows with an unsafe path drop out."""
    header, menu = F.col("header"), F.col("menu")
    slugs = content.withColumn("header_slug", F.nullif(slugify(header), F.lit("")))
    slugs = slugs.withColumn("menu_slug", menu_folder(header, menu)).withColumn("_text_slug", slugify(F.col("text")))
    path = join_path(F.col("header_slug"), F.col("menu_slug"), F.col("_text_slug"), base)
    return slugs.withColumn("output_path", path).drop("_text_slug").filter(rules.path_safe(F.col("output_path")))


def publish_texts(chosen: DataFrame, clean: bool = True) -> DataFrame:
    """Rows of ``publish_paths`` with clean Markdown and its checksum; missing slugs are empty."""
    text = sanitize(F.col("markdown")) if clean else F.col("markdown")
    return (
        chosen.withColumn("markdown", text)
        .withColumn("sha256", checksum(F.col("markdown")))
        .withColumn("header_slug", F.coalesce("header_slug", F.lit("")))
        .withColumn("menu_slug", F.coalesce("menu_slug", F.lit("")))
    )


def prepare_publish(
    content: DataFrame, base: str = "output", overwrite: bool = False, clean: bool = True, pos: str = "pos",
    known: DataFrame | None = None, render=None,
) -> DataFrame:
    """Content rows ready to be written: path, slugs, clean Markdown, checksum.

    ``content`` has header, menu, text, a position, and either markdown or what ``render`` makes it from: a function
    that adds the column, applied to the chosen rows only. Rows with an unsafe
    path drop out. Of several rows with one path the first stays, as later ones
    find the file there; with ``overwrite`` the last one does. Only (path, position)
    goes through the choice, and paths in ``known`` go before the clean-up starts.
    """
    safe = publish_paths(content, base)
    winners = safe.groupBy("output_path").agg((F.max(pos) if overwrite else F.min(pos)).alias(pos))
    if known is not None:
        # Both sides hold one row per path here, so no key can be hot.
        winners = winners.join(known.select("output_path"), "output_path", "left_anti")
    chosen = safe.join(winners, ["output_path", pos], "left_semi")
    return publish_texts(render(chosen) if render else chosen, clean)
