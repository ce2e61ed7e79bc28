"""Readers: pages, saved structures, logs, text files."""

from __future__ import annotations

import os
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.functions.text import iso_time
from docengine.operators.logs import LOG_SCHEMA
from docengine.session import work_dir

_LEAF = "text:string,id:string,type:string,is_expandable:boolean"


def group_ddl(depth: int) -> str:
    """A header group whose items nest ``depth`` levels below the top ones."""
    kind = f"struct<{_LEAF}>"
    for _ in range(depth):
        kind = f"struct<{_LEAF},children:array<{kind}>>"
    return f"header_text string, children array<{kind}>"


# Folders the text scan leaves out.
TOOL_FOLDERS = ["__pycache__", "node_modules", "venv", ".venv"]


def parse_partitions(spark: SparkSession) -> int:
    """Partitions that keep every core busy with parsing."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_scan(scan: DataFrame) -> DataFrame:
    """A plain file scan with too few splits for the cores is dealt out; others stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def scan_pages(spark: SparkSession, path: str, html: str = "html", columns: tuple[str, ...] = ()) -> DataFrame:
    """Stored pages with HTML; name the columns wanted, so that no others are dealt out."""
    scan = spark.read.parquet(path)
    if columns:
        scan = scan.select(*columns)
    return spread_scan(scan.filter(F.length(html) > 0))


def scan_html_files(spark: SparkSession, path: str) -> DataFrame:
    """One page per file: url is the file name."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def _text(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Lines (or whole files) as ``value``; a missing path gives none."""
    try:
        return spark.read.text(path, wholetext=whole)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], "value string")


def load_structure(spark: SparkSession, path: str, keys: str = "", multi_line: bool = False, depth: int | None = None) -> DataFrame:
    """Saved header groups; a missing path or a corrupt record gives no rows.

    ``keys`` names extra columns, such as the page key. Menus are read to ``depth``; where it is not
    given, one pass over the records finds the deepest. Saved tables hold one record per line;
    ``multi_line`` reads files that each hold one indented list of groups.
    """
    text = _text(spark, path, multi_line)
    if depth is None:
        shape = text.agg(F.schema_of_variant_agg(F.try_parse_json("value"))).first()[0] or ""
        depth = max(1, shape.count("children: ARRAY<OBJECT") - 1)
    record = f"struct<{', '.join(c.strip().replace(' ', ':', 1) for c in keys.split(',') if c.strip())}{', ' if keys else ''}"
    record += f"{group_ddl(depth).replace('header_text ', 'header_text:').replace('children array', 'children:array')}, _corrupt:string>"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    if multi_line:
        found = text.select(F.explode(F.from_json("value", f"array<{record}>", options)).alias("r"))
    else:
        found = text.select(F.from_json("value", record, options).alias("r"))
    return found.filter(F.col("r").isNotNull() & F.col("r._corrupt").isNull()).select("r.*").drop("_corrupt")


def read_log(spark: SparkSession, path: str, schema: T.StructType = LOG_SCHEMA) -> DataFrame:
    """JSON-lines records with a parsed time; ``fields`` holds all other fields as text.

    Lines that are no record are left out; ``broken_log_lines`` returns them.
    """
    names = [F.lit(f.name) for f in schema.fields]
    extra = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, _: ~k.isin(*names))
    records = _log_records(spark, path, schema).filter("r is not null and r._corrupt is null")
    return records.select("r.*", extra.alias("fields")).drop("_corrupt").withColumn("timestamp", iso_time(F.col("timestamp")))


def broken_log_lines(spark: SparkSession, path: str, schema: T.StructType = LOG_SCHEMA) -> DataFrame:
    """Lines with text that hold no record."""
    broken = (F.col("r").isNull() | F.col("r._corrupt").isNotNull()) & (F.trim("value") != "")
    return _log_records(spark, path, schema).filter(broken).select("value")


def _log_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return _text(spark, path).select("value", F.from_json("value", full, options).alias("r"))


def scan_text_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = (".py",)) -> DataFrame:
    """path (relative to the folder), size_bytes and text of all files of the extensions below a folder.

    Files and folders whose name starts with a dot and tool folders are left out, all others stay, also
    those that Spark's own readers take for hidden. Tasks list the folders, one level after another, and read the files; text that
    is not UTF-8 is null. A missing folder gives no rows.
    """

    tool_folders = TOOL_FOLDERS

    def file_system():
        if "://" in path or path.startswith("file:"):
            return pafs.FileSystem.from_uri(path)
        return pafs.LocalFileSystem(), os.path.abspath(path)

    def list_folders(batches):
        fs, root = file_system()
        for batch in batches:
            rows = []
            for folder in batch.column(0).to_pylist():
                where = pafs.FileSelector(f"{root}/{folder}".rstrip("/"), allow_not_found=True)
                for found in fs.get_file_info(where):
                    name = found.base_name
                    if name.startswith(".") or (found.type == pafs.FileType.Directory and name in tool_folders):
                        continue
                    inner = f"{folder}/{name}" if folder else name
                    if found.type == pafs.FileType.Directory or name.endswith(extensions):
                        rows.append({"path": inner, "is_folder": found.type == pafs.FileType.Directory})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("is_folder", pa.bool_())]))

    def read_files(batches):
        fs, root = file_system()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{root}/{name}") as file:
                    data = file.read()
                row = [pa.array([name]), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["path", "size_bytes", "data"])

    folders, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        out = work_dir(spark, "listing")
        folders.repartition(parse_partitions(spark)).mapInArrow(list_folders, "path string, is_folder boolean").write.parquet(out)
        levels.append(spark.read.parquet(out))
        folders = levels[-1].filter("is_folder").select("path")
        if folders.isEmpty():
            break
    files = reduce(DataFrame.union, levels).filter("not is_folder").select("path")
    read = files.repartition(parse_partitions(spark)).mapInArrow(read_files, "path string, size_bytes long, data binary")
    text = F.col("data").cast("string")
    return read.select("path", "size_bytes", F.when(F.is_valid_utf8(text), text).alias("text"))
