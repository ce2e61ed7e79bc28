"""Writers: structures, raw HTML, published Markdown, routed logs.

All go through Spark's commit protocol: output is complete or absent. Partitioned
writes are rebalanced on the partition columns, so a folder that takes most of the
rows is split over many tasks and small ones are merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions.text import checksum, raw_html_path
from docengine.operators.nodes import numbered_rows_of
from docengine.operators.resume import prepare_publish
from docengine.sources.versioned import VersionedTable


def save_structure(nested: DataFrame, path: str, keys: tuple[str, ...] = ("page_id",)) -> None:
    """One JSON record per header group, non-ASCII kept."""
    groups = numbered_rows_of(nested, F.col("structured_data"), keys, "group_pos", "g")
    groups.select(*keys, "group_pos", "g.*").write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def save_raw_html(pages: DataFrame, path: str, item_id, base: str = "debug") -> None:
    """Raw pages with the path each is kept under."""
    pages.withColumn("debug_path", raw_html_path(item_id, base)).write.mode("overwrite").parquet(path)


# A fixed schema: an empty table stays readable, and a folder named 2024 stays text.
PUBLISHED_DDL = (
    "output_path string, header string, menu string, text string, markdown string, sha256 string, "
    "header_slug string, menu_slug string"
)


def published_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, PUBLISHED_DDL, ["output_path"], ("header_slug", "menu_slug"))


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """What has been published so far, or None before the first run."""
    return published_table(spark, path).read()


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """Published rows whose text no longer has the stored checksum."""
    return published(spark, path).filter(~checksum(F.col("markdown")).eqNullSafe(F.col("sha256")))


def publish_markdown(content: DataFrame, path: str, base: str = "output", overwrite: bool = False, clean: bool = True, pos: str = "pos", verify: bool = False, render=None) -> DataFrame:
    """Publish one row per output path and return the published table.

    Without ``overwrite`` paths that are already there are skipped and the rest is added; with it, new rows take the
    place of old ones with their path. Either way only the new rows are written, and a run that is cut off at any
    point leaves the table as it was. ``render`` makes the Markdown of the rows to be written, see ``prepare_publish``;
    ``content.rendered`` does so from pages. ``verify`` reads the table back and hashes every text again.
    """
    table = published_table(content.sparkSession, path)
    ready = prepare_publish(content, base, overwrite, clean, pos, None if overwrite else table.read(), render)
    table.add(ready.select("output_path", "header", "menu", "text", "markdown", "sha256", "header_slug", "menu_slug"), replaces=overwrite)
    if verify and not damaged(content.sparkSession, path).isEmpty():
        raise ValueError(f"texts in {path} do not match their checksums")
    return table.read()


def write_routed_logs(routed: DataFrame, path: str, mode: str = "overwrite") -> None:
    routed.hint("rebalance", "sink").write.mode(mode).partitionBy("sink").json(path)
