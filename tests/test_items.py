import json

import pytest
from pyspark.sql import functions as F

from docengine.operators import content, nodes, ordered, resume, rules, summaries, tree
from docengine.session import work_dir
from docengine.sources import readers, versioned, writers
from docengine.streaming import jobs

ITEM = "pos bigint, id string, text string, header string, menu string"


def test_header_attachment(spark, monkeypatch):
    rows = [(0, False, "Login"), (1, True, "H1"), (2, False, "A"), (3, False, "B"), (4, True, "H2"), (5, False, "C")]
    for span in (ordered.SPAN, 2):
        monkeypatch.setattr(ordered, "SPAN", span)
        df = spark.createDataFrame([("k", *r) for r in rows] + [("none", 0, False, "X")], "k string, pos bigint, h boolean, t string")
        lead = tree.attach_leading_header(df, ["k"], "pos", F.col("h"), F.col("t"))
        assert {r["t"]: r["header"] for r in lead.collect()} == {"A": "H1", "B": "H1", "C": "H2"}
        trail = tree.attach_trailing_header(df, ["k"], "pos", F.col("h"), F.col("t"))
        want = {"Login": "H1", "A": "H2", "B": "H2", "C": "H2", "X": "API Documentation"}
        assert {r["t"]: r["header"] for r in trail.collect()} == want
        order = tree.document_order(df.filter("k = 'k'"), ["k"], "pos", F.col("h"))
        assert [r["position"] for r in order.orderBy("pos").collect()] == [0, 1, 1, 2, 3, 3]


def test_reference_map_and_duplicates(spark):
    rows = [(0, "a-1", "X"), (1, "_a-1", "Y"), (2, "b", "Z"), (3, "b", "Z"), (4, None, "N"), (5, "", "E")]
    items = spark.createDataFrame(rows, "pos bigint, id string, text string")
    assert {r["norm_id"]: r["item"]["text"] for r in resume.reference_map(items).collect()} == {"a-1": "Y", "b": "Z"}
    [bad] = resume.duplicate_ids(items).collect()
    assert bad["message"] == "Duplicate ID found: a-1 for item 'X'"


def test_resume(spark):
    items = resume.with_output_path(spark.createDataFrame([(i, f"n{i}", f"T{i}", "H", None) for i in range(4)], ITEM))
    done = items.filter("pos = 2").select("output_path")
    have, miss = (f(items, done) for f in (resume.existing_items, resume.pending_items))
    assert [r["pos"] for r in have.collect()] == [2] and sorted(r["pos"] for r in miss.collect()) == [0, 1, 3]
    row = resume.resume_summary(items, F.col("pos") == 2).first()
    assert (row["completion"], row["remaining"]) == (25.0, 3)
    assert row["report"] == "Resume Info: 1/4 complete (25.0%), 3 remaining"
    empty = resume.resume_summary(items.limit(0), F.lit(True)).first()
    assert (empty["total"], empty["completion"], empty["remaining_share"]) == (0, 0.0, 100.0)
    many = spark.createDataFrame([(i, None if i == 1 else f"n{i}", f"T{i}") for i in range(8)], "pos bigint, id string, text string")
    lines = [r["entry"] for r in resume.next_pending(many, "pos").orderBy("line").collect()]
    assert lines[1] == "2. T1 (ID: Unknown)" and lines[-1] == "... and 3 more items" and len(lines) == 6
    assert resume.next_pending(many.limit(0), "pos").collect() == []
    few = spark.createDataFrame([(2, "b", None), (None, "n", "N"), (1, None, "A")], "pos bigint, id string, text string").repartition(3)
    lines = [r["entry"] for r in resume.next_pending(few, "pos").orderBy("line").collect()]
    assert lines == ["1. N (ID: n)", "2. A (ID: Unknown)", "3. Unknown (ID: b)"]
    assert resume.next_pending(resume.pending_items(items, done), "pos")._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") == 1


def test_collisions_and_actions(spark):
    items = resume.with_output_path(spark.createDataFrame([(0, "a", "T", "H", None), (1, "b", "T", "H", None), (2, "c", "U", "H", None)], ITEM))
    assert sorted(r["pos"] for r in resume.path_collisions(items).collect()) == [0, 1]
    assert {r["action"] for r in resume.write_actions(items, items, force=True).collect()} == {"write"}


def contents(spark, *rows):
    return spark.createDataFrame(list(rows), "pos bigint, header string, menu string, text string, markdown string")


def test_publish(spark):
    folder = work_dir(spark, "test-publish")
    first = contents(spark, (0, "H", "M", "A", "#one"), (1, "H", "M", "A", "two"), (2, "H", None, "..x", "dots"), (3, "H", "H", "B", "b"))
    out = {r["output_path"]: r["markdown"] for r in writers.publish_markdown(first, folder).collect()}
    assert out == {"output/h/m/a.md": "# one", "output/h/x.md": "dots", "output/h/b.md": "b"}
    second = contents(spark, (4, "H", "M", "A", "new"), (5, "H", "M", "A", "newest"), (6, "H", "M", "C", "c"))
    out = {r["output_path"]: r["markdown"] for r in writers.publish_markdown(second, folder).collect()}
    assert out["output/h/m/a.md"] == "# one" and out["output/h/m/c.md"] == "c" and len(out) == 4
    out = {r["output_path"]: r["markdown"] for r in writers.publish_markdown(second, folder, overwrite=True).collect()}
    assert out["output/h/m/a.md"] == "newest" and len(out) == 4
    unsafe = writers.publish_markdown(first, work_dir(spark, "test-unsafe"), base="../out")
    assert unsafe.count() == 0


def test_structure_round_trip(spark, tmp_path):
    from pages import LEADING, page_table

    groups = tree.page_groups(tree.with_entries(nodes.with_nodes(page_table(spark, LEADING.replace("Login", "Lögin")))))
    folder = work_dir(spark, "test-structure")
    writers.save_structure(groups, folder)
    loaded = readers.load_structure(spark, folder, "page_id bigint, group_pos int")
    again = loaded.groupBy("page_id").agg(F.collect_list(F.struct("header_text", "children")).alias("structured_data"))
    flat = [(r["id"], r["text"], r["level"]) for r in tree.flatten(again, ["page_id"]).orderBy("pos").collect()]
    assert flat[0] == ("docs-node-123", "Lögin", 0) and len(flat) == 4
    assert readers.load_structure(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "good.json").write_text(json.dumps([{"header_text": "H", "children": []}], indent=4))
    (tmp_path / "bad.json").write_text("{not json")
    assert [r["header_text"] for r in readers.load_structure(spark, str(tmp_path), multi_line=True).collect()] == ["H"]


def test_text_scan_and_audit(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "pkg" / "a.py").write_text('# c\n\nx = 1\n"""doc"""\ny')
    (tmp_path / "b.py").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "c.txt").write_text("x")
    (tmp_path / ".git" / "d.py").write_text("x")
    files = readers.scan_text_files(spark, str(tmp_path))
    audit = {r["path"]: r for r in summaries.line_audit(files).collect()}
    assert set(audit) == {"pkg/a.py", "b.py"}
    a = audit["pkg/a.py"]
    assert (a["total_lines"], a["code_lines"], a["comment_lines"], a["blank_lines"]) == (5, 2, 2, 1)
    assert (audit["b.py"]["total_lines"], audit["b.py"]["size_bytes"]) == (0, 3)
    texts = spark.createDataFrame([("",), ("a\n",), ("a\r\nb\rc",)], "text string")
    assert sorted(r["total_lines"] for r in summaries.line_audit(texts).collect()) == [0, 1, 3]
    many = spark.createDataFrame([(1, "x\n" * 260), (2, "x\n" * 301), (3, "#x\n" * 400)], "i int, text string")
    assert [(r["i"], r["excess"]) for r in summaries.size_violations(many).collect()] == [(2, 1)]
    assert sorted(r["i"] for r in summaries.size_violations(many, strict=True).collect()) == [1, 2]


def test_rules(spark):
    assert summaries.max_items(spark.range(10), "id", 0).count() == 10
    assert summaries.max_items(spark.range(10), "id", 3).count() == 3
    paths = ["out/a.md", "/out/a.md", "a/../b", "~/x", "a//b", "a/.b/c", "a/" + "x" * 256, "a/"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    got = [r[0] for r in rows.orderBy("i").select(rules.path_safe(F.col("p"))).collect()]
    assert got == [True, True, False, False, False, False, False, False]


PAGE = """<div id="documentation"><app-api-doc-endpoint><div class="dds__mb-4"><app-show-http-method><span class="x http-method-get">GET</span>
</app-show-http-method><span class="dds__pl-3">List <b>all</b></span><button>Try It</button></div><markdown><pre>/v1/x</pre></markdown>
<div class="dds__mt-2"><markdown><p>What it does</p></markdown></div><app-api-doc-security><p>key</p></app-api-doc-security>
<app-api-doc-server>https://h</app-api-doc-server><app-show-parameters><p>one</p></app-show-parameters><app-show-parameters><p>two</p>
</app-show-parameters><app-api-doc-response><button role="tab">200</button><button role="tab">404</button><div role="tabpanel"><p>fine</p></div>
<div role="tabpanel"><table><tr><th>k</th></tr><tr><td> </td></tr></table></div></app-api-doc-response>
<app-api-doc-request-body><p>body</p></app-api-doc-request-body></app-api-doc-endpoint></div><markdown>outside</markdown>"""


def test_endpoint_page(spark):
    from pages import page_table

    plain = "<app-api-doc-endpoint><markdown><pre> </pre></markdown><app-api-doc-response><p>r</p></app-api-doc-response></app-api-doc-endpoint>"
    pages = page_table(spark, PAGE, plain, '<div id="documentation"><p>short</p></div>', "<p>" + "long " * 20 + "</p>")
    got = [(r["strategy"], r["markdown"]) for r in content.page_content(content.with_content(pages)).orderBy("page_id").collect()]
    want = [
        "### GET Listall Try It", "```\n/v1/x\n```", "What it does", "## Security\n\nkey", "https://h", "one", "two",
        "### Response 200\n\nfine", "### Response 404\n\n| k |\n| --- |", "body",
    ]
    assert got[0] == ("endpoint", "\n\n".join(want))
    assert got[1] == ("endpoint", "r") and got[2] == ("fallback", "") and got[3] == ("fallback", ("long " * 20).strip())


def test_streams_match_batch(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    schema = "pos bigint, header string, menu string, text string, markdown string"

    def push(*rows):
        contents(spark, *rows).coalesce(1).write.mode("append").parquet(source)
        jobs.incremental_publish(spark.readStream.schema(schema).parquet(source), out, marks).awaitTermination()
        return {r["output_path"]: r["markdown"] for r in spark.read.parquet(out).collect()}

    assert push((0, "H", None, "A", "a"), (1, "H", None, "A", "later")) == {"output/h/a.md": "a"}
    assert push((2, "H", None, "A", "again"), (3, "H", None, "B", "b")) == {"output/h/a.md": "a", "output/h/b.md": "b"}
    assert push() == {"output/h/a.md": "a", "output/h/b.md": "b"}


def test_menu_groups_are_whole(spark):
    items = spark.range(3000).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("id"), F.lit("t").alias("text"), F.lit("").alias("menu"))
    placed = summaries.group_by_menu(items, "pos").orderBy("index_in_menu").collect()
    assert {p["menu_key"] for p in placed} == {"no_menu"} and {p["group_size"] for p in placed} == {3000}
    assert [(p["index_in_menu"], p["pos"]) for p in placed] == [(k, k) for k in range(3000)]


def test_null_keys_are_groups(spark):
    rows = [(None, 0, True, "H"), (None, 1, False, "A"), ("k", 0, True, "J"), ("k", 1, False, "B"), (None, 2, False, "C")]
    df = spark.createDataFrame(rows, "k string, pos bigint, h boolean, t string")
    lead = tree.attach_leading_header(df, ["k"], "pos", F.col("h"), F.col("t"))
    assert {r["t"]: r["header"] for r in lead.collect()} == {"A": "H", "B": "J", "C": "H"}
    trail = tree.attach_trailing_header(df, ["k"], "pos", F.col("h"), F.col("t"))
    assert {r["t"]: r["header"] for r in trail.collect()} == {"A": "H", "B": "J", "C": "H"}
    shards = ordered.round_robin(df, ["k"], "pos", 2).collect()
    assert {r["t"]: r["shard"] for r in shards} == {"H": 0, "A": 1, "C": 0, "J": 0, "B": 1}
    assert tree.document_order(df, ["k"], "pos", F.col("h")).count() == 5


def test_nesting_of_any_depth(spark, tmp_path):
    """Menus in menus, four levels down, and a group without a header position."""
    schema = "page_id bigint, header_pos bigint, header string, pos bigint, id string, text string, type string, is_expandable boolean, menu_pos bigint"
    rows = []
    for head in (0, None):
        for pos, (text, parent) in enumerate([("M0", None), ("M1", 0), ("M2", 1), ("M3", 2), ("leaf", 3), ("other", 1), ("last", None)]):
            menu = text.startswith("M")
            rows.append((1, head, f"h{head}", pos, f"{head}-{text}", text, "menu" if menu else "item", menu, parent))
    nested = tree.nest(spark.createDataFrame(rows, schema), ["page_id"])
    flat = tree.flatten(nested, ["page_id"]).orderBy("pos").collect()
    once = [("M0", None, 0), ("M1", "M0", 1), ("M2", "M1", 2), ("M3", "M2", 3), ("leaf", "M3", 4), ("other", "M1", 2), ("last", None, 0)]
    assert [(r["text"], r["menu"], r["level"]) for r in flat] == once * 2
    folder = str(tmp_path / "deep")
    writers.save_structure(nested, folder)
    loaded = readers.load_structure(spark, folder, "page_id bigint, group_pos int")
    assert loaded.count() == 2
    again = loaded.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("group_pos", "header_text", "children"))).alias("structured_data"))
    assert [r["text"] for r in tree.flatten(again, ["page_id"]).orderBy("pos").collect()] == [t for t, _, _ in once] * 2


def test_text_files_are_whole(spark, tmp_path):
    names = ["__init__.py", "_x.py", "_priv/d.py", "src/lib/src/c.py", ".hid/a.py", ".b.py", "venv/e.py", "x/node_modules/f.py", "a.txt"]
    for name in names:
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_bytes(b"\xff" if name == "_x.py" else b"1\n2\n")
    found = {r["path"]: (r["size_bytes"], r["text"]) for r in readers.scan_text_files(spark, str(tmp_path / "src")).collect()}
    assert found == {n: (1, None) if n == "_x.py" else (4, "1\n2\n") for n in names[:4]}
    assert readers.scan_text_files(spark, str(tmp_path / "none")).count() == 0


def test_log_fields_and_broken_lines(spark, tmp_path):
    lines = ['{"level": "INFO", "event": "a", "user": 7, "tags": [1]}', '{"level": "INF', "", "[]x"]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    [row] = readers.read_log(spark, str(tmp_path)).collect()
    assert (row["event"], row["fields"]) == ("a", {"user": "7", "tags": "[1]"})
    assert [r["value"] for r in readers.broken_log_lines(spark, str(tmp_path)).collect()] == [lines[1], lines[3]]


def test_work_folder_must_be_shared(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        work_dir(Session(), "x")


def test_publishing_stopped_between_rows_and_commit(spark, tmp_path, monkeypatch):
    """Rows whose commit never came are not there; the next run publishes as if nothing had happened."""
    path = str(tmp_path / "pub")
    writers.publish_markdown(contents(spark, (0, "H", None, "A", "old"), (1, "H", None, "B", "b")), path, verify=True)
    new = contents(spark, (2, "H", None, "A", "newest"), (3, "H", None, "C", "c"))

    def texts():
        return {r["output_path"]: r["markdown"] for r in writers.published(spark, path).collect()}

    with monkeypatch.context() as stopped:
        stopped.setattr(versioned.VersionedTable, "_point", lambda self, head: 1 / 0)
        for overwrite in (False, True):
            with pytest.raises(ZeroDivisionError):
                writers.publish_markdown(new, path, overwrite=overwrite)
            assert texts() == {"output/h/a.md": "old", "output/h/b.md": "b"}
    writers.publish_markdown(new, path, overwrite=True, verify=True)
    assert texts() == {"output/h/a.md": "newest", "output/h/b.md": "b", "output/h/c.md": "c"}
    writers.publish_markdown(contents(spark, (9, "H", None, "A", "late"), (9, "I", None, "D", "d")), path)
    assert texts() == {"output/h/a.md": "newest", "output/h/b.md": "b", "output/h/c.md": "c", "output/i/d.md": "d"}
    assert writers.damaged(spark, path).isEmpty()


def test_versioned_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versioned, "MOST_FOLDERS", 3)
    table = versioned.VersionedTable(spark, str(tmp_path / "t"), "k string, v long", ["k"])
    assert table.read() is None and table.head().version == 0

    def rows(*pairs):
        return spark.createDataFrame(list(pairs), "k string, v long")

    heads = [table.add(rows(("a", 1), (None, 1)), mark=0), table.add(rows((None, 2)), replaces=True, mark=1), table.add(rows(("a", 9)), replaces=True, mark=1)]
    assert heads[2] == heads[1]  # a mark that is committed is not written again
    assert sorted(map(tuple, table.read().collect()), key=str) == [("a", 1), (None, 2)]
    before = table.read()  # a reader that started before the next commits keeps its rows
    for n in range(3, 7):
        table.add(rows(("b", n)), replaces=True)
    assert sorted(map(tuple, before.collect()), key=str) == [("a", 1), (None, 2)]
    assert sorted(map(tuple, table.read().collect()), key=str) == [("a", 1), ("b", 6), (None, 2)]
    assert len(table.head().folders) <= 3 and table.add(rows()).version == 7


def test_running_tally_writes_changed_keys_only(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    schema = "user string, ok boolean"

    def push(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        runs = spark.readStream.schema(schema).parquet(source)
        jobs.running_tally(runs, F.col("ok"), F.lit(False), ["user"], out, marks).awaitTermination()
        return runs, {r["user"]: tuple(r)[1:] for r in jobs.tally_so_far(runs, out, ["user"]).collect()}

    _, first = push(("a", True), ("a", None), (None, False))
    assert first == {"a": (1, 0, 1), None: (0, 1, 0)}
    runs, second = push((None, True), ("b", True))
    assert second == {"a": (1, 0, 1), None: (1, 1, 0), "b": (1, 0, 0)}
    table = versioned.VersionedTable(spark, out, "user string, processed long, failed long, skipped long", ["user"])
    last = table.head().folders[-1][0]
    assert {r["user"] for r in spark.read.parquet(f"{out}/{last}").collect()} == {None, "b"}


def test_first_seen_takes_the_least_position(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))

    def push(*rows):
        spark.createDataFrame(list(rows), "k string, pos long, t string").repartition(3).write.mode("append").parquet(source)
        found = jobs.first_seen(spark.readStream.schema("k string, pos long, t string").parquet(source), "k", "pos")
        writer = found.writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True)
        writer.start(out).awaitTermination()
        return {(r["k"], r["pos"]) for r in spark.read.parquet(out).collect()}

    many = [("hot", n, "x") for n in range(4000, 100, -1)]
    assert push(*many, ("null", None, "x"), ("null", 5, "x"), (None, 7, "x"), (None, 3, "x"), ("only", None, "x")) == {
        ("hot", 101), ("null", 5), (None, 3), ("only", None)}
    assert push(("hot", 1, "x"), ("new", 2, "x"), (None, 1, "x")) == {("hot", 101), ("null", 5), (None, 3), ("only", None), ("new", 2)}


def test_description_blocks_are_compared_as_elements(spark):
    from pages import page_table

    def page(first, second):
        return f'<app-api-doc-endpoint>{first}<div class="dds__mt-2">{second}</div></app-api-doc-endpoint>'

    pre = "<markdown><pre>/x</pre></markdown>"
    others = [pre, "<markdown><p>/x</p></markdown>", '<markdown id="m"><pre>/x</pre></markdown>', "<markdown><pre><!-- c -->/x</pre></markdown>",
              "<markdown> <pre>/x</pre></markdown>", "<markdown><pre>/y</pre></markdown>"]
    pages = page_table(spark, *[page(pre, other) for other in others], page("", "<markdown>alone</markdown>"))
    got = [r["description"] for r in content.endpoint_parts(content.with_content(pages)).orderBy("page_id").collect()]
    assert got == [None, "/x", "/x", "/x", "/x", "/y", None]
