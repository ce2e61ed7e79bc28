"""Queries that once covered a part of the pages: all shapes, all items, all selectors."""

from pages import header, item, menu, page_table, sidebar

from docengine.operators import nodes
from docengine.plans import registry

FOLDER = "/root/testdata/sf0.001"
registry.load_all()


def rows(spark, name):
    return registry.QUERIES[name](spark, FOLDER).collect()


def test_structures_of_all_shapes_are_saved_and_loaded(spark):
    assert {r["page_id"] % 4 for r in rows(spark, "s2_load_structure_all")} == {0, 1, 2}  # shape 3 has no list to read


def test_every_item_has_a_path(spark):
    items = spark.read.parquet(f"{FOLDER}/customer.parquet").count()
    assert len({r["item_id"] for r in rows(spark, "n5_expansion_path_all")}) == items


def test_every_selector_gives_its_rows(spark):
    html = sidebar(header("H"), menu("M"), menu("O", icon="down"), item("I", "x")) + (
        '<a class="toc-link">L</a><p id="loaderActive">W</p><p id="documentation">D</p><div role="tabpanel" aria-hidden="false">T</div>'
    )
    found = nodes.select_all(nodes.with_nodes(page_table(spark, html))).collect()
    assert {r["selector"] for r in found} == set(nodes.selectors())
    named = {r["selector"]: r["dom_id"] or r["text"] for r in found}
    assert [named[s] for s in ("item_link", "loader", "content_pane", "active_tab_panel")] == ["L", "loaderActive", "documentation", "T"]
