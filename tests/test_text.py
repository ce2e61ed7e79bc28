import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from docengine.functions import text as X
from docengine.functions.folding import ascii_fold


def run(spark, make, *inputs):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(inputs)], "i int, t string")
    out = rows.select("i", make(F.col("t")).alias("r")).collect()
    return [r["r"] for r in sorted(out, key=lambda r: r["i"])]


def test_slugify(spark):
    given = {
        "Query System's SDCs": "query-systems-sdcs", "Header with / and (special)": "header-with-and-special",
        "Über_Straße ½": "uber-strae-12", "Extra --- Spaces": "extra-spaces", "a.b..": "a.b",
        "v1.2 Notes.md": "v1.2-notes.md", "x" * 120: "x" * 100, "  ": "", "日本語": "", "": "",
    }
    assert run(spark, X.slugify, *given) == list(given.values())
    slugs = [s for s in given.values()]
    assert run(spark, X.slugify, *slugs) == slugs
    assert run(spark, lambda c: X.slugify(c, True), "Über_Straße ½", "日本 語") == ["über-straße-1⁄2".replace("⁄", ""), "日本-語"]


def test_fold_matches_unicode_data(spark):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.decomposition(chr(c))]
    blocks = ["x".join(chars[i : i + 50]) for i in range(0, len(chars), 50)] + ["é", "\U0001f600a"]
    want = [unicodedata.normalize("NFKD", b).encode("ascii", "ignore").decode() for b in blocks]
    assert run(spark, ascii_fold, *blocks) == want


def test_ids_and_names(spark):
    assert run(spark, X.synthetic_id, "Get All (GET) Items", "Create  User -- v2", "!!!") == [
        "synthetic-get-all-get-items", "synthetic-create-user-v2", "synthetic-",
    ]
    assert run(spark, X.normalize_id, " _docs-node-1- ") == ["docs-node-1"]
    assert run(spark, lambda c: X.output_filename(c, F.lit("n1")), "Get (All) Items!") == ["Get_All_Items_n1.md"]
    paths = lambda c: X.output_path(F.lit("H"), F.lit("H"), c, "out/")
    assert run(spark, paths, "A b", "v1.2 Notes.md", "日本") == ["out/h/a-b.md", "out/h/v1.2-notes.md", "out/h/untitled.md"]
    assert run(spark, lambda c: X.output_path(c, F.lit("M"), F.lit("t")), " ", None) == ["output/m/t.md"] * 2


def test_cleanup(spark):
    given = {
        "“hi”—x": '"hi"--x', "a b": "ab", "&amp;lt;": "<", "[t]( )": "t",
        "**bold** and a***b": "bold and a*b", "__init__ a_b": "init a_b", "x​y &nbsp;&quot;": 'xy  "',
    }
    assert run(spark, X.cleanup_patterns, *given) == list(given.values())


def test_tables_and_lines(spark):
    given = {
        "| --- | --- | --- |": "|-----| --- |-----|", "|---|---|": "|---|---|", "x\n|a|\ny\nz": "x\n\n|a|\ny\n\nz",
        "|a|\nx\n|b|\n\n|c|\nend": "|a|\nx\n\n|b|\n\n\n|c|\nend",
    }
    assert run(spark, X.clean_md_tables, *given) == list(given.values())
    assert run(spark, X.normalize_ws, "a\tb", "abc\td", "x \t\ny ") == ["a   b", "abc d", "x\ny"]
    assert run(spark, X.setext_to_atx, "a\n==\n==\n==", "T\n--\nx", "#T\n--", "==") == ["# ==", "## T\nx", "#T\n--", "=="]
    assert run(spark, X.fix_headers, "#Title", "  ##\tx", "# ok", "##", "a #b", "#\tx\n##y") == [
        "# Title", "  ## x", "# ok", "##", "a #b", "# x\n## y",
    ]
    assert run(spark, X.squeeze_blank, "a\n\n\n\nb") == ["a\n\nb"]
    assert run(spark, X.fix_code_blocks, "a\n```py\nx\n```\nb") == ["a\n\n```py\nx\n\n```\n\nb"]
    assert run(spark, X.strip_comments, "a<!-- b\nc -->d") == ["ad"]
    assert run(spark, X.sanitize, " \n", None, "#T\n\n\n\nx  ") == ["", "", "# T\n\nx"]


def brute_force_lines(text):
    """Blank lines around tables, one line at a time."""
    out, inside = [], False
    lines = text.split("\n")
    for i, line in enumerate(lines):
        row = line.strip().startswith("|") and line.strip().endswith("|")
        if row and not inside and out and out[-1].strip():
            out.append("")
        out.append(line)
        if inside and not row and any(n.strip() for n in lines[i + 1 : i + 2]):
            out.append("")
        inside = row
    return "\n".join(out)


def test_line_rules_against_brute_force(spark):
    dice = random.Random(7)
    texts = ["\n".join(dice.choice(["|a|", " |b| ", "", "x", " ", "|", "y|", "a\tb\t", "\tq \t"]) for _ in range(dice.randint(1, 9))) for _ in range(400)]
    assert run(spark, X._table_spacing, *texts) == [brute_force_lines(t) for t in texts]
    tabbed = ["\n".join(line.rstrip() for line in t.expandtabs(4).split("\n")) for t in texts]
    assert run(spark, X.normalize_ws, *texts) == tabbed
    dashed = [re.sub(r"\|\s*-+\s*\|", lambda m: "|" + "-" * (len(m[0]) - 2) + "|", t.replace("x", "| - |--|\n-|")) for t in texts]
    assert run(spark, X._table_separators, *[t.replace("x", "| - |--|\n-|") for t in texts]) == dashed


def test_md_checks(spark):
    given = {"# T\n\ntext": "TTTTT", "a | b": "FTTTF", "```\nx": "FFTTT", "**a**": "FTTTT", "*a": "FTFTT", "[x]()": "FTTFT"}
    found = run(spark, X.md_checks, *given)
    assert ["".join("FT"[v] for v in r) for r in found] == list(given.values())


def test_checksum_and_times(spark):
    assert run(spark, X.checksum, "hello") == ["2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"]
    times = run(spark, X.iso_time, "2025-06-01T10:00:00.5Z", "not a time")
    assert times[0] is not None and times[1] is None
    assert run(spark, X.endpoint_version, "https://h/versions/3.6/docs", "https://h/docs") == ["3.6", "4.6"]


def test_one_decimal_prints_like_python(spark):
    values = [p / q * 100 for q in (7, 8, 16, 80, 97, 1024) for p in range(0, q + 1)] + [k / 1024 for k in range(0, 90000, 128)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    out = rows.select("i", X.one_decimal(F.col("v")).alias("r")).collect()
    assert [r["r"] for r in sorted(out, key=lambda r: r["i"])] == [f"{v:.1f}" for v in values]


@pytest.mark.parametrize("parts", [1, 8])
def test_same_result_at_any_partitioning(spark, parts):
    rows = spark.range(500).select(F.concat(F.lit("#T"), F.col("id").cast("string"), F.lit("\n|a|\nx\ty")).alias("t"))
    got = sorted(r[0] for r in rows.repartition(parts).select(X.sanitize(F.col("t"))).collect())
    assert got == sorted(f"# T{i}\n\n|a|\nx   y" for i in range(500))
