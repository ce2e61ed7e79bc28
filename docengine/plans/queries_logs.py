"""Registered queries: logs, run outcomes, text audits, streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.operators import content, logs, summaries
from docengine.plans import bindings as B
from docengine.plans import sql_parts as S
from docengine.plans.queries_pages import PUBLISHED, content_rows, published_sql
from docengine.plans.registry import query
from docengine.session import work_dir
from docengine.sources import readers, writers
from docengine.streaming import jobs

col = F.col
_LEVELS = ", ".join(f"('{k}', {v})" for k, v in logs.LEVELS.items())
_SINKS = ", ".join(f"('{s}', {logs.LEVELS[least]})" for s, least in logs.SINKS.items())
_ROUTED = f"""WITH l(level, no) AS (VALUES {_LEVELS}), s(sink, least) AS (VALUES {_SINKS}),
e AS (SELECT *, {B.LEVEL_EXPR} AS level FROM events)
SELECT event_id, level, sink FROM e JOIN l USING (level) JOIN s ON no >= least"""


@query("s6_read_log_jsonl", f"SELECT event_type AS event, {B.LEVEL_EXPR} AS level, epoch_us(ts) AS micros, event_id FROM events")
def s6(spark, d):
    folder = work_dir(spark, "log")
    stamped = B.log(spark, d).withColumn("timestamp", F.expr("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"))
    record = F.to_json(F.struct("level", "timestamp", col("event_type").alias("event"), "event_id"))
    broken = F.when(col("event_id") % 5 == 0, F.substring(record, 1, 20))  # a second, cut line
    stamped.select(F.explode(F.array_compact(F.array(record, broken))).alias("value")).write.text(folder)
    read = readers.read_log(spark, folder)
    event_id = col("fields")["event_id"].cast("bigint").alias("event_id")
    return read.select("event", "level", F.unix_micros("timestamp").alias("micros"), event_id)


@query("s7_route_log_levels", _ROUTED)
def s7(spark, d):
    return logs.route_levels(B.log(spark, d)).select("event_id", "level", "sink")


# --- outcomes -----------------------------------------------------------------------------

_OK = "CASE event_type WHEN 'purchase' THEN true WHEN 'signup' THEN true WHEN 'view' THEN false END"
_TALLY = f"count(*) FILTER (coalesce({_OK}, false)) AS processed, count(*) FILTER (event_type IN ('error', 'view')) AS failed, count(*) FILTER (event_type = 'click') AS skipped"


def _runs(spark, d):
    return B.table(spark, d, "events").withColumn("ok", F.expr(_OK)).withColumn("hour", F.date_trunc("hour", "ts"))


@query("a4_outcome_tally", f"SELECT user_id, {_TALLY} FROM events GROUP BY user_id")
def a4(spark, d):
    return summaries.outcome_tally(_runs(spark, d), col("ok"), col("event_type") == "error", ["user_id"])


@query("a5_merge_tallies", f"SELECT user_id % 10 AS team, {_TALLY} FROM events GROUP BY 1")
def a5(spark, d):
    parts = summaries.outcome_tally(_runs(spark, d), col("ok"), col("event_type") == "error", ["user_id"])
    sparse = parts.withColumn("skipped", F.when(col("skipped") > 0, col("skipped")))
    return summaries.merge_tallies(sparse.withColumn("team", col("user_id") % 10), ["team"])


@query(
    "a6_final_summary",
    f"""WITH c AS (SELECT user_id, count(*) FILTER (s = 'processed') AS processed, count(*) FILTER (s = 'skipped') AS skipped,
 count(*) FILTER (s = 'errors') AS errors, count(*) FILTER (s = 'no_content') AS no_content FROM (SELECT user_id, {B.STATUS_EXPR} AS s FROM events) GROUP BY user_id)
SELECT *, processed + skipped + errors + no_content AS attempted, printf('%.1f%%', processed / (processed + skipped + errors + no_content) * 100) AS success_rate FROM c""",
)
def a6(spark, d):
    return summaries.final_summary(B.table(spark, d, "events"), F.expr(B.STATUS_EXPR), ["user_id"])


# --- text audits ------------------------------------------------------------------------------

# Some lines are made comments, so that all four kinds occur.
_AUDIT_TEXT = "CASE doc_id % 4 WHEN 0 THEN '# ' || text || chr(10) WHEN 1 THEN text || chr(13) || chr(10) || chr(10) || '\"\"\"doc\"\"\"' WHEN 2 THEN '' ELSE text END"
_LINES = f"""WITH src AS (SELECT doc_id, {_AUDIT_TEXT} AS text FROM documents),
parts AS (SELECT doc_id, text, string_split_regex(text, '\\r\\n|[\\r\\n]') AS p FROM src),
ended AS (SELECT doc_id, text, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS ls FROM parts),
lines AS (SELECT doc_id, {S.strip('l')} AS l FROM (SELECT doc_id, unnest(ls) AS l FROM ended)),
counted AS (SELECT doc_id, count(*) AS total, count(*) FILTER (l = '') AS blank,
  count(*) FILTER (l <> '' AND (starts_with(l, '#') OR contains(l, '\"\"\"') OR contains(l, ''''''''))) AS comment FROM lines GROUP BY doc_id),
audit AS (SELECT doc_id, strlen(text)::INTEGER AS size_bytes, coalesce(total, 0)::INTEGER AS total_lines, (coalesce(total, 0) - coalesce(blank, 0) - coalesce(comment, 0))::INTEGER AS code_lines,
  coalesce(comment, 0)::INTEGER AS comment_lines, coalesce(blank, 0)::INTEGER AS blank_lines FROM src LEFT JOIN counted USING (doc_id))"""


def _audit(spark, d):
    texts = B.documents(spark, d, "doc_id", "text").select("doc_id", F.expr(_AUDIT_TEXT).alias("text"))
    return summaries.line_audit(texts)


@query("a7_line_audit", _LINES + " SELECT * FROM audit")
def a7(spark, d):
    return _audit(spark, d)


_SUMS = """count(*) AS total_files, sum(total_lines)::BIGINT AS total_lines, sum(code_lines)::BIGINT AS total_code_lines,
 sum(comment_lines)::BIGINT AS total_comment_lines, sum(size_bytes)::BIGINT AS total_size_bytes"""


@query("a8_audit_summary", _LINES + f" SELECT {_SUMS} FROM audit")
def a8(spark, d):
    return summaries.audit_summary(_audit(spark, d))


_RELEVANT = f"""WITH l AS (SELECT doc_id, {S.strip('l')} AS l FROM (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|[\\n\\x{{b}}\\x{{c}}\\r\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS l FROM documents)),
c AS (SELECT doc_id, (count(*) FILTER (l <> '' AND NOT starts_with(l, '#')))::INTEGER AS line_count FROM l GROUP BY doc_id)"""


@query(
    "a9_size_violations",
    _RELEVANT + "\nSELECT doc_id, line_count, 'Module' AS kind, line_count - 30 AS excess FROM c WHERE line_count > 25",
)
def a9(spark, d):
    texts = B.documents(spark, d, "doc_id", "text")
    return summaries.size_violations(texts, strict=True, limit=30, target=25)


@query(
    "a9_violation_counts",
    _RELEVANT + "\nSELECT 'Module' AS kind, count(*) AS violations, max(line_count) - 30 AS largest_excess FROM c WHERE line_count > 25 HAVING count(*) > 0",
)
def a9_counts(spark, d):
    return summaries.violation_counts(a9(spark, d))


@query("l3_largest_first", _LINES + " SELECT doc_id, total_lines FROM audit ORDER BY total_lines DESC, doc_id")
def l3(spark, d):
    return summaries.largest_first(_audit(spark, d), "doc_id").select("doc_id", "total_lines")


@query(
    "l4_top20",
    _LINES
    + """ SELECT row_number() OVER (ORDER BY total_lines DESC, doc_id)::INTEGER AS rank, doc_id, total_lines, code_lines, printf('%.1f', size_bytes / 1024) AS size_kb
FROM audit ORDER BY rank LIMIT 20""",
)
def l4(spark, d):
    return summaries.top_by_lines(_audit(spark, d), "doc_id").select("rank", "doc_id", "total_lines", "code_lines", "size_kb")


@query("l5_oversized", _LINES + " SELECT doc_id, total_lines FROM audit WHERE total_lines > 40")
def l5(spark, d):
    return summaries.oversized(_audit(spark, d), 40).select("doc_id", "total_lines")


_PLACE = """CASE doc_id % 5 WHEN 0 THEN 'd' || doc_id || '.txt' WHEN 1 THEN '_priv/_x' || doc_id || '.txt' WHEN 2 THEN '.git/h' || doc_id || '.txt'
 WHEN 3 THEN 'node_modules/n' || doc_id || '.txt' ELSE 'src/lib/src/c' || doc_id || '.txt' END"""


@query(
    "s8_scan_text_files",
    f"""SELECT {_PLACE} AS path, strlen(text) AS size_bytes, length(string_split(text, chr(10)))::INTEGER AS lines
 FROM documents WHERE doc_id % 5 NOT IN (2, 3)""",
)
def s8(spark, d):
    folder = work_dir(spark, "texts")

    def put(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder) if ":" in folder else (pafs.LocalFileSystem(), folder)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{root}/{name}") as file:
                    file.write(data)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])

    files = B.table(spark, d, "documents").select(F.expr(_PLACE).alias("path"), col("text").cast("binary").alias("data"))
    files.mapInArrow(put, "path string").write.format("noop").mode("overwrite").save()
    found = readers.scan_text_files(spark, folder, (".txt",))
    return found.select("path", "size_bytes", F.size(F.split("text", "\n", -1)).alias("lines"))


# --- streams -------------------------------------------------------------------------------------


def _stream(spark, d, name):
    """Stored table as a file stream."""
    path = f"{d}/{name}.parquet"
    # Written as a pattern, as a stream takes a folder or a pattern, not a file.
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def _finished(stream_query):
    stream_query.awaitTermination()
    if stream_query.exception():
        raise stream_query.exception()


@query("r1_incremental_publish", f"WITH {B.VERSIONS_SQL}, {published_sql('versions', f'p_partkey * {B.BATCHES} + batch', 'title', 'batch')}")
def r1(spark, d):
    """Three batches, each of two thirds of the pages in a version of their own; the first version of a path stays."""
    source, out, marks = (work_dir(spark, f"stream-{name}") for name in ("pages", "published", "marks"))
    for batch in range(B.BATCHES):
        pages = B.part_pages(B.part_versions(readers.spread_scan(B.table(spark, d, "part")), batch))
        pages.write.mode("append").parquet(source)
        stream = spark.readStream.schema(pages.schema).parquet(source)
        _finished(jobs.incremental_publish(content_rows(stream, col("title")), out, marks, render=content.rendered))
    return spark.read.parquet(out).select(*PUBLISHED)


@query("r2_stream_log_routing", _ROUTED)
def r2(spark, d):
    out, marks = work_dir(spark, "stream-log"), work_dir(spark, "stream-marks")
    records = _stream(spark, d, "events").withColumn("level", F.expr(B.LEVEL_EXPR))
    _finished(jobs.stream_log_routing(records, out, marks))
    return spark.read.parquet(out).select("event_id", "level", "sink")


@query("r3_running_tally", f"SELECT user_id, {_TALLY} FROM events GROUP BY user_id")
def r3(spark, d):
    """Two batches, of which the second changes the counts of the users it holds."""
    source, out, marks = (work_dir(spark, f"stream-{name}") for name in ("events", "tally", "marks"))
    for half in range(2):
        events = B.table(spark, d, "events").filter((col("event_id") % 3 == 0) == F.lit(bool(half)))
        events.write.mode("append").parquet(source)
        runs = spark.readStream.schema(events.schema).parquet(source).withColumn("ok", F.expr(_OK))
        _finished(jobs.running_tally(runs, col("ok"), col("event_type") == "error", ["user_id"], out, marks))
    return jobs.tally_so_far(runs, out, ["user_id"])
