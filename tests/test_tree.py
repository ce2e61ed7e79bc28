import pytest
from pages import LEADING, TRAILING, header, item, listing, menu, page_table, sidebar

from docengine.functions.html import node_markdown, parse_page
from docengine.operators import navigation, nodes, tree
from docengine.operators.nodes import FLAT, HIERARCHICAL


def entries(spark, *pages):
    return tree.with_entries(nodes.with_nodes(page_table(spark, *pages)))


def flat_rows(df):
    names = ["id", "text", "type", "header", "menu", "parent_menu_text", "level"]
    return [tuple(r[n] for n in names) for r in sorted(df.collect(), key=lambda r: (r["page_id"], r["pos"]))]


LEADING_FLAT = [
    ("docs-node-123", "Login", "item", "Authentication", None, None, 0),
    (None, "Users", "menu", "Authentication", None, None, 0),
    ("docs-node-456", "Create User", "item", "Authentication", "Users", "Users", 1),
    ("docs-node-789", "Delete User", "item", "Authentication", "Users", "Users", 1),
]
TRAILING_FLAT = [
    ("docs-node-100", "Get All Items", "item", "API Resources", None, None, 0),
    ("docs-node-200", "Create Item", "item", "API Resources", None, None, 0),
    (None, "Resources", "menu", "API Resources", None, None, 0),
]


def test_golden_leading(spark):
    page = entries(spark, LEADING)
    assert flat_rows(tree.page_items(page)) == LEADING_FLAT
    [row] = tree.page_groups(page).collect()
    [group] = row["structured_data"]
    assert group["header_text"] == "Authentication"
    login, users = group["children"]
    assert (login["id"], login["is_expandable"], login["children"]) == ("docs-node-123", False, None)
    assert [c["id"] for c in users["children"]] == ["docs-node-456", "docs-node-789"]
    assert flat_rows(tree.flatten(tree.page_groups(page), ["page_id"])) == LEADING_FLAT


def test_golden_trailing(spark):
    page = entries(spark, TRAILING)
    assert page.first()["structure"] == HIERARCHICAL
    assert flat_rows(tree.page_items(page, FLAT)) == TRAILING_FLAT
    [group] = tree.page_groups(page, FLAT).first()["structured_data"]
    assert (group["header_text"], group["position"], group["children"][2]["children"]) == ("API Resources", 7, [])


@pytest.mark.parametrize("html", ["", "<div><ul><li>Incomplete", "<ul><li>No wrapper</li></ul>"])
def test_pages_without_navigation(spark, html):
    assert tree.parse_sidebar(page_table(spark, html)).count() == 0


def test_flat_reading(spark):
    deep = sidebar(
        menu("Outer"), listing(menu("Inner"), listing(item("Leaf", "n1")), item("Retrieve x"), item("plain")),
        menu("Nest", '<ul><li class="toc-item-highlight" id="n2"><span>Deep</span></li><li class="toc-item-highlight">no id</li></ul>'),
        item("Overview", "n3"), item("a", "n4"), header("H"), item("late", "n5"),
    )
    got = flat_rows(tree.page_items(entries(spark, deep, sidebar(item("Only", "o1"))), FLAT))
    assert got == [
        (None, "Outer", "menu", "H", None, None, 0),
        (None, "Inner", "menu", "H", "Outer", "Outer", 1),
        ("n1", "Leaf", "item", "H", "Inner", "Inner", 2),
        ("synthetic-retrieve-x", "Retrieve x", "item", "H", "Outer", "Outer", 1),
        (None, "Nest", "menu", "H", None, None, 0),
        ("n2", "Deep", "item", "H", "Nest", "Nest", 1),
        ("n4", "a", "item", "H", None, None, 0),
        ("n5", "late", "item", "H", None, None, 0),
        ("o1", "Only", "item", "API Documentation", None, None, 0),
    ]


def test_leading_reading_needs_header_and_id(spark):
    page = sidebar(item("early", "n0"), header("H"), item("no id"), item("Get it"), menu("M", node_id="m1"), "<ul></ul>", item("x", "n1"))
    got = flat_rows(tree.page_items(entries(spark, page), HIERARCHICAL))
    assert got == [("m1", "M", "menu", "H", None, None, 0), ("n1", "x", "item", "H", None, None, 0)]


def test_lenient_parser():
    found, error = parse_page('<p>a<br>b<p>c</P><div/>d</p>e<li><li x="1" x="2">f<script>"</p>"</script><!-- z -->')
    assert error is None
    shape = [(n.tag, n.parent_id, n.child_ord) for n in found]
    assert shape == [
        ("p", -1, 0), ("#text", 0, 0), ("br", 0, 1), ("#text", 0, 2), ("p", 0, 3), ("#text", 4, 0), ("div", 0, 4),
        ("#text", 0, 5), ("#text", -1, 1), ("li", -1, 2), ("li", 9, 0), ("#text", 10, 0), ("script", 10, 1), ("#data", 12, 0),
    ]
    assert found[10].attrs == {"x": "2"} and found[0].last_id == 7 and found[4].prev_id == 2


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<h2>A <b>x</b>\n y</h2><p>one<br>two</p>", "## A **x** y\n\none  \ntwo"),
        ("<p><b>open<br><p>para</p>", "open\n\npara"),
        ("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>", "* a\n  * b\n* c"),
        ("<ol><li>a</li><li>b</li></ol>", "1. a\n2. b"),
        ("<table><tr><th>h</th></tr><tr><td>a|b</td></tr></table>", "| h |\n| --- |\n| a\\|b |"),
        ("<pre>x\n  y</pre>", "```\nx\n  y\n```"),
        ('<a href="/z">Z</a> <img src="a" alt="b"> <code>c</code> <i> d</i>', "[Z](/z) ![b](a) `c`  *d*"),
        ("<style>s</style>t<script>u</script>", "t"),
        ("<blockquote>q<br>r</blockquote><hr>", "> q\n> r\n\n---"),
    ],
)
def test_markdown_dialect(html, want):
    found, _ = parse_page(html)
    assert node_markdown(found, 0, len(found) - 1) == want


def test_navigation(spark):
    inner = '<ul><li class="toc-item-highlight" id="t1"><span>Target</span></li></ul>'
    outer = f'<ul>{menu("Closed", inner)}</ul>'
    parsed = nodes.with_nodes(page_table(spark, sidebar(header("H"), menu("Open", outer, icon="down"))))
    from pyspark.sql import functions as F

    for how in ((F.lit("t1"), F.lit("none")), (F.lit("gone"), F.lit("Targ"))):
        row = navigation.expansion_path(parsed, *how).first()["path"]
        assert row["found"] and [e["menu_text"] for e in row["expansions"]][-1] == "Closed"
    assert navigation.ancestor_menus(parsed, F.lit("t1"), F.lit("")).first()["ancestors"] == ["Open", "Closed"]
    assert navigation.ancestor_menus(parsed, F.lit("no"), F.lit("no such")).first()["ancestors"] == []
    [hit] = navigation.menu_by_text(parsed, "Closed").filter("is_collapsed").collect()
    assert hit["menu_text"] == "Closed" and navigation.menu_by_text(parsed, "it's").count() == 0
    assert [r["menu_text"] for r in navigation.collapsed_menus(parsed).collect()] == ["Closed"]


def test_structure_type_live(spark):
    from pyspark.sql import functions as F

    cases = [((1, 1, 3, 1), FLAT), ((1, 3, 1, 0), HIERARCHICAL), ((0, 3, 1, 0), "mixed"), ((1, 1, 3, 0), "mixed")]
    rows = spark.createDataFrame([c[0] for c in cases], "a int, b int, c int, d int")
    assert [r[0] for r in rows.select(nodes.structure_type_live(*[F.col(x) for x in "abcd"])).collect()] == [c[1] for c in cases]


def test_sql_registration(spark):
    from docengine.functions import html

    html.register(spark)
    page_table(spark, LEADING).createOrReplaceTempView("test_pages")
    spark.sql("SELECT page_id, html_nodes(html) AS page FROM test_pages").createOrReplaceTempView("test_nodes")
    tags = spark.sql("SELECT tag FROM (SELECT inline(page.nodes) FROM test_nodes) WHERE dom_id LIKE '%-sp'").collect()
    assert [r["tag"] for r in tags] == ["span"] * 3


def test_unclosed_tags_stay_linear(spark):
    """Elements carry their own text only, so a page of unclosed tags doubles with its input."""
    from docengine.functions.html import parse_page

    sizes = []
    for count in (2000, 4000):
        page = spark.createDataFrame([(1, "".join(f"<p> text {k} " for k in range(count)))], "page_id long, html string")
        rows = nodes.html_nodes(nodes.with_nodes(page)).collect()
        assert [r["own_text"] for r in rows[:2]] == ["text 0", "text 1"]
        sizes.append(sum(len(r["own_text"]) for r in rows))
    assert len(rows) == 4000 and sizes[1] < 2.2 * sizes[0]
    assert [n.data for n in parse_page("<div> a <b>x</b> c </div>")[0] if n.tag == "div"] == ["ac"]
