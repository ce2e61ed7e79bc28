"""Pages are parsed once and not copied for their targets."""

from pages import page_table
from pyspark.sql import functions as F

from docengine.operators import navigation, nodes
from docengine.plans import registry

registry.load_all()


def test_targets_of_a_page_are_rows_and_the_page_is_parsed_once(spark):
    item = '<li class="toc-item-highlight" id="a"><span>Alpha</span></li><li class="toc-item-highlight" id="b"><span>Beta</span></li>'
    menu = f'<li class="toc-item-highlight"><i class="dds__icon--chevron-right"></i><div class="align-middle dds__text-truncate">M</div><ul>{item}</ul></li>'
    targets = [("b", "x"), (None, "lph"), ("no", None), ("b", "x")]
    listed = F.array(*[F.struct(F.lit(i).cast("string").alias("i"), F.lit(t).cast("string").alias("t")) for i, t in targets])
    pages = page_table(spark, f"<ul>{menu}</ul>", "<p>nothing</p>").withColumn("goal", F.when(F.col("page_id") == 0, listed).otherwise(F.slice(listed, 1, 0)))
    ids, texts = F.transform("goal", lambda g: g["i"]), F.transform("goal", lambda g: g["t"])
    found = navigation.expansion_path(nodes.with_nodes(pages), ids, texts, each="goal")
    menus = [(r["page_id"], r["goal"]["i"], r["path"]["found"], [e["menu_text"] for e in r["path"]["expansions"] or []]) for r in found.collect()]
    assert menus == [(0, "b", True, ["M"]), (0, None, True, ["M"]), (0, "no", False, []), (0, "b", True, ["M"])]


def test_no_join_copies_parsed_pages(spark):
    found = registry.QUERIES["n5_expansion_path"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and plan.rindex("parse_html(") < plan.index("Join")  # parsed above all joins
