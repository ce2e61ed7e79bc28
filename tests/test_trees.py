"""Trees of any depth: nested and flat forms of adjacency rows, paths by recursive SQL."""

import random

import pytest

from docengine.operators import tree

SCHEMA = "page_id bigint, header_pos bigint, header string, pos bigint, id string, text string, type string, is_expandable boolean, menu_pos bigint"


def random_items(seed):
    rng, rows = random.Random(seed), []
    for page in (1, 2, None):
        for head in (0, 1, None):
            name = rng.choice(["H", None])
            if rng.random() < 0.2:
                rows.append((page, head, name, None, None, None, None, None, None))
                continue
            for pos in range(rng.randint(1, 14)):
                menu = rng.random() < 0.6
                kind = "menu" if menu else rng.choice(["item", None])
                parent = rng.choice([None, *range(pos), 77, pos])  # 77 is not there, pos is the row itself
                rows.append((page, head, name, pos, rng.choice(["i", "", None]), rng.choice([" t ", f"m{pos}", f"m{pos}", None]), kind, menu and rng.random() < 0.8, parent))
    return rows


def brute(rows):
    found = []
    for page in {r[0] for r in rows}:
        at = 0
        heads = sorted({r[1] for r in rows if r[0] == page}, key=lambda h: (h is not None, h or 0))
        for head in heads:
            own = [r for r in rows if r[:2] == (page, head)]

            def walk(parent, above, level):
                nonlocal at
                for r in own:
                    if r[3] is None or r[8] != parent or not (r[5] and r[6] and (r[6] == "menu" or r[4])) or r[3] == parent:
                        continue
                    found.append((page, at, r[4], r[5].strip(), r[6], r[2] or "Unknown Header", above, above, level))
                    at += 1
                    if r[6] == "menu" and r[7]:
                        walk(r[3], r[5], level + 1)

            walk(None, None, 0)
    return sorted(found, key=str)


@pytest.mark.parametrize("seed", range(6))
def test_flat_forms(spark, seed):
    rows = random_items(seed)
    items = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), SCHEMA)
    expected = brute(rows)
    assert sorted(map(tuple, tree.flatten_items(items, ["page_id"]).collect()), key=str) == expected
    nested = tree.flatten(tree.nest(items, ["page_id"]), ["page_id"])
    assert sorted(map(tuple, nested.collect()), key=str) == expected


def test_no_items(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert tree.nest(nothing, ["page_id"]).count() == 0 and tree.flatten_items(nothing, ["page_id"]).count() == 0


def test_paths(spark):
    links = [("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("d", "c", "D"), ("e", "a", "E"), ("lost", "gone", "L"),
             ("r", "s", "R"), ("s", "r", "S"), ("self", "self", "X"), (None, "a", "N"), ("a", "c", "again"), ("z", None, None)]
    paths = tree.item_paths(spark.createDataFrame(links, "key string, parent string, text string"), "key", "parent", "text")
    found = {(r["key"], r["text"], tuple(r["texts"]), r["level"]) for r in paths.collect()}
    assert found == {("a", "A", (), 0), ("z", None, (), 0), ("b", "B", ("A",), 1), ("e", "E", ("A",), 1), ("c", "C", ("A", "B"), 2), ("d", "D", ("A", "B", "C"), 3)}
    below = {(r["menu"], r["key"], r["level"]) for r in tree.flat_children(paths).collect()}
    assert below == {("a", "b", 1), ("a", "e", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 3), ("b", "d", 2), ("c", "d", 1)}
    deep = spark.createDataFrame([(str(k), str(k - 1) if k else None, "t") for k in range(9)], "key string, parent string, text string")
    assert tree.item_paths(deep, "key", "parent", "text", levels=20).count() == 9
    with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT"):
        tree.item_paths(deep, "key", "parent", "text", levels=5).count()
