"""Selector text against a plain tree walk, and the sweeps of a page against comparing all pairs."""

import random

import pytest
from pages import page_table
from pyspark.sql import functions as F

from docengine.functions import page_index, selectors
from docengine.functions.html import parse_page
from docengine.operators import navigation, nodes

PAGE = """<div id="top" class="a b"><ul data-k="x-1"><li class="b">one<ul><li id="in" class="a">two</li></ul></li><li>three</li></ul>
<p class="a">four</p><section><div><ul><li class="a" data-k="y">five</li></ul></div></section><a href="/x/y.md" title="it's, [odd] > all">six</a></div>"""


def walked(tree, test):
    """Ids of the elements for which ``test(node, parents)`` holds, parents from the nearest on."""
    found = []
    for n in tree:
        if not n.tag.startswith("#"):
            above, at = [], n.parent_id
            while at >= 0:
                above.append(tree[at])
                at = tree[at].parent_id
            if test(n, above):
                found.append(n.node_id)
    return found


def has(n, name):
    return name in (n.attrs.get("class") or "").split()


CASES = {
    "li": lambda n, up: n.tag == "li",
    "*": lambda n, up: True,
    "#in": lambda n, up: n.attrs.get("id") == "in",
    "li.a": lambda n, up: n.tag == "li" and has(n, "a"),
    ".a.b": lambda n, up: has(n, "a") and has(n, "b"),
    "li[id]": lambda n, up: n.tag == "li" and "id" in n.attrs,
    "li:not([id])": lambda n, up: n.tag == "li" and "id" not in n.attrs,
    "li:not(.a)": lambda n, up: n.tag == "li" and not has(n, "a"),
    "*:not(li)": lambda n, up: n.tag != "li",
    "[data-k='y']": lambda n, up: n.attrs.get("data-k") == "y",
    "[data-k^=x], a[href$='.md']": lambda n, up: (n.attrs.get("data-k") or "").startswith("x") or (n.tag == "a" and n.attrs["href"].endswith(".md")),
    "[href*='/x/']": lambda n, up: "/x/" in (n.attrs.get("href") or ""),
    "[class~=b]": lambda n, up: has(n, "b"),
    "[data-k^='']": lambda n, up: False,
    "a[title=\"it's, [odd] > all\"]": lambda n, up: n.tag == "a",
    "ul > li": lambda n, up: n.tag == "li" and bool(up) and up[0].tag == "ul",
    "ul li li": lambda n, up: n.tag == "li" and any(x.tag == "li" and any(y.tag == "ul" for y in up[k + 1 :]) for k, x in enumerate(up)),
    "div > ul li": lambda n, up: n.tag == "li" and any(x.tag == "ul" and up[k + 1 : k + 2] and up[k + 1].tag == "div" for k, x in enumerate(up)),
    "section>div  >ul>li.a": lambda n, up: n.tag == "li" and has(n, "a") and [x.tag for x in up[:3]] == ["ul", "div", "section"],
    "li li[id], #top > p": lambda n, up: (n.tag == "li" and "id" in n.attrs and any(x.tag == "li" for x in up)) or (n.tag == "p" and up[0].node_id == 0),
}


def test_selector_texts(spark):
    tree, _ = parse_page(PAGE)
    parsed = nodes.with_nodes(page_table(spark, PAGE)).cache()
    names = {f"s{k}": text for k, text in enumerate(CASES)}
    found = nodes.select_all(parsed, named=names).collect()
    for name, text in names.items():
        assert sorted(r["node_id"] for r in found if r["selector"] == name) == walked(tree, CASES[text]), text
    alone = [r["node_id"] for r in nodes.select_nodes(parsed, "ul > li").collect()]
    assert sorted(alone) == walked(tree, CASES["ul > li"])
    other = nodes.Profile(selectors=(("row", "ul[data-k] > li"),))
    assert nodes.select_nodes(parsed, "row", profile=other).count() == 2
    assert nodes.select_nodes(parsed, lambda ns, n: n["tag"] == "p").count() == 1


@pytest.mark.parametrize("text", ["", " , a", "a >", "> a", "a > > b", "a[", "a:hover", "a::b", ".1", "a b,", ":not()", "li a.b#"])
def test_texts_that_are_no_selectors(text):
    with pytest.raises(ValueError):
        selectors.parse(text)


def random_ranges(rng, n):
    lasts, stack = [0] * n, []
    for i in range(n):
        while stack and rng.random() < 0.4:
            lasts[stack.pop()] = i - 1
        stack.append(i)
    for i in stack:
        lasts[i] = n - 1
    return lasts


def test_ranges_around():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 40)
        lasts = random_ranges(rng, n)
        marked = sorted(rng.sample(range(n), rng.randint(0, n)))
        wanted = [rng.choice([None, *range(n)]) for _ in range(rng.randint(0, 12))]
        expected = [None if w is None else [k for k, m in enumerate(marked) if m < w <= lasts[m]] for w in wanted]
        assert page_index.open_ranges(marked, [lasts[m] for m in marked], wanted) == expected


def test_located():
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.choice([None, "a", "b", "c", "d"]) for _ in range(rng.randint(0, 8))]
        texts = [rng.choice([None, "", "x", "xy y", "zx", "y"]) for _ in range(rng.randint(0, 6))]
        wanted = [{"id": rng.choice([None, "a", "e"]), "text": rng.choice([None, "", "x", "y", "y y", "q", ""])} for _ in range(5)]
        expected = []
        for w in wanted:
            by_id = next((k for k, i in enumerate(ids) if i is not None and i == w["id"]), None)
            by_text = next((k for k, t in enumerate(texts) if w["text"] is not None and w["text"] in (t or "")), None)
            expected.append((by_id, by_text if by_id is None else None))
        assert page_index.located(ids, texts, wanted) == expected


def test_nested_menus_and_missing_targets(spark):
    def menu(name, inner, closed=True):
        icon = "right" if closed else "down"
        return f'<li class="toc-item-highlight"><i class="dds__icon--chevron-{icon}"></i><div class="align-middle dds__text-truncate">{name}</div><ul>{inner}</ul></li>'

    item = '<li class="toc-item-highlight" id="deep"><span>Deep one</span></li>'
    page = f"<ul>{menu('A', menu('B', menu('C', item), False))}</ul>"
    parsed = nodes.with_nodes(page_table(spark, page, "<p>nothing</p>"))
    pairs = [("deep", "x"), ("no", "ep on"), ("no", "no")]
    targets = F.array(*[F.struct(F.lit(i).alias("item_id"), F.lit(t).alias("text")) for i, t in pairs])
    found = navigation.expansion_paths(parsed, targets).collect()
    assert [(r["page_id"], r["found"], r["expansions"] and [e["menu_text"] for e in r["expansions"]]) for r in sorted(found, key=lambda r: r["page_id"])] == [
        (0, True, ["A", "B", "C"]), (0, True, ["A", "B", "C"]), (0, False, None), (1, False, None), (1, False, None), (1, False, None)]
    # An open menu around a closed one counts as closed: the first closed icon anywhere inside is taken.
    assert found[0]["expansions"][1]["xpath"] == found[0]["expansions"][2]["xpath"] == "/ul[1]/li[1]/ul[1]/li[1]/ul[1]/li[1]/i[1]"


def test_a_page_is_parsed_once(spark):
    from docengine.operators import content

    pages = page_table(spark, PAGE)
    plan = content.page_content(content.with_content(pages))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
