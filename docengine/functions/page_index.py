"""Sweeps over the nodes of one page that need a stack or a lookup table: Arrow functions on thin arrays.

Nested elements are ranges of node ids, so one pass in document order with a stack of open ranges answers "what lies around
this node" for any number of nodes; Spark's own array functions would compare every node with every range.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import types as T

from docengine.functions.parts import part_udf


def open_ranges(firsts: list[int], lasts: list[int], wanted: list[int | None]) -> list[list[int] | None]:
    """For each wanted node the places, in ``firsts``, of the ranges that strictly hold it, outermost first; null for null.

    Ranges run from a node to the last node inside it, are nested or apart, and come in document order.
    """
    found: list[list[int] | None] = [None] * len(wanted)
    stack: list[int] = []
    at = 0
    for k in sorted((k for k, node in enumerate(wanted) if node is not None), key=wanted.__getitem__):
        node = wanted[k]
        while at < len(firsts) and firsts[at] < node:
            while stack and lasts[stack[-1]] < firsts[at]:
                stack.pop()
            stack.append(at)
            at += 1
        while stack and lasts[stack[-1]] < node:
            stack.pop()
        found[k] = list(stack)
    return found


@part_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def ranges_around(firsts: pa.Array, lasts: pa.Array, wanted: pa.Array) -> pa.Array:
    rows = zip(firsts.to_pylist(), lasts.to_pylist(), wanted.to_pylist(), strict=True)
    return pa.array([None if w is None else open_ranges(a or [], b or [], w) for a, b, w in rows], pa.list_(pa.list_(pa.int32())))


def located(ids: list[str | None], texts: list[str | None], wanted: list[dict]) -> list[tuple[int | None, int | None]]:
    """For each wanted (id, text): the first place of the id in ``ids``; if there is none, the first text that holds the text."""
    places: dict[str, int] = {}
    for place, name in enumerate(ids):
        if name is not None:
            places.setdefault(name, place)
    # All texts as one string, each with a mark before it that no text holds, so a search finds the first text at once.
    joined, starts = "", []
    found: list[tuple[int | None, int | None]] = []
    for one in wanted:
        by_id, by_text = places.get(one["id"]), None
        if by_id is None and one["text"] is not None:
            if not starts:
                mark = next(c for c in map(chr, range(0xE000, 0x10FFFE)) if not any(c in (t or "") for t in texts))
                joined = mark + mark.join(t or "" for t in texts)
                starts = [k for k, c in enumerate(joined) if c == mark]
            at = -1 if mark in one["text"] else joined.find(one["text"], 1) if one["text"] else 0
            by_text = bisect_right(starts, at) - 1 if at >= 0 and texts else None
        found.append((by_id, by_text))
    return found


LOCATED = T.ArrayType(T.StructType([T.StructField("by_id", T.IntegerType()), T.StructField("by_text", T.IntegerType())]))


@part_udf(LOCATED)
def locate(ids: pa.Array, texts: pa.Array, wanted: pa.Array) -> pa.Array:
    rows = zip(ids.to_pylist(), texts.to_pylist(), wanted.to_pylist(), strict=True)
    found = [None if w is None else [{"by_id": a, "by_text": b} for a, b in located(i or [], t or [], w)] for i, t, w in rows]
    return pa.array(found, pa.list_(pa.struct([("by_id", pa.int32()), ("by_text", pa.int32())])))


def preorder(groups: list, places: list, parents: list) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """Entries in pre-order as (row, level, entry of the parent or -1, last entry inside) and groups as (row, first entry, number of entries).

    Rows come sorted by group, then place; a parent is a place of the same group or None. A row without place stands for its
    group only; rows that no top row leads to are left out.
    """
    entries: list[tuple[int, int, int, int]] = []
    found: list[tuple[int, int, int]] = []
    start = 0
    while start < len(groups):
        end = start
        below: dict = {}
        while end < len(groups) and groups[end] == groups[start]:
            if places[end] is not None:
                below.setdefault(parents[end], []).append(end)
            end += 1
        first = len(entries)
        stack = [(row, 0) for row in reversed(below.pop(None, []))]
        open_: list[int] = []
        while stack:
            row, level = stack.pop()
            while len(open_) > level:
                at = open_.pop()
                entries[at] = (*entries[at][:3], len(entries) - 1)
            up = open_[-1] if open_ else -1
            open_.append(len(entries))
            entries.append((row, level, up, 0))
            # Taken out when used: a place that names itself, directly or in a ring, ends there.
            stack += [(child, level + 1) for child in reversed(below.pop(places[row], []))]
        for at in open_:
            entries[at] = (*entries[at][:3], len(entries) - 1)
        found.append((start, first, len(entries) - first))
        start = end
    return entries, found


_FIELDS = ("row", "level", "up", "last"), ("row", "first", "size")
TREE = T.StructType([T.StructField(n, T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in cs]))) for n, cs in zip(("entries", "groups"), _FIELDS)])


@part_udf(TREE)
def tree_order(groups: pa.Array, places: pa.Array, parents: pa.Array) -> pa.Array:
    rows = zip(groups.to_pylist(), places.to_pylist(), parents.to_pylist(), strict=True)
    trees = [preorder(*row) for row in rows]
    kinds = [pa.list_(pa.struct([(c, pa.int32()) for c in cs])) for cs in _FIELDS]
    lists = [pa.array([[dict(zip(cs, x)) for x in tree[k]] for tree in trees], kinds[k]) for k, cs in enumerate(_FIELDS)]
    return pa.StructArray.from_arrays(lists, ["entries", "groups"])


# Called once a page, not once for each use of the result.
ranges_around, locate, tree_order = (f.asNondeterministic() for f in (ranges_around, locate, tree_order))
