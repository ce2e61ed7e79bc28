"""Selector text (CSS) compiled to node predicates and one sweep over a page.

A selector is compounds (``tag``, ``*``, ``#id``, ``.class``, ``[attr]``, ``[attr='v']`` with ``=``, ``^=``, ``$=``, ``*=`` or ``~=``,
``:not(compound)``) joined by blanks (inside) or ``>`` (child), and a comma joins alternatives. Compounds are Spark
predicates, evaluated once per node whatever number of selectors use them; what combines them is a sweep from parents to
children over two integers per node.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.functions.parts import part_udf

BLANKS = " \t\n\r\f"
MOST = 62  # selectors, steps or compounds at once: bits of a number
_NAME = r"-?[A-Za-z_][\w-]*"
_VALUE = r"\"[^\"]*\"|'[^']*'|[\w-]+"
_PART = re.compile(
    rf"(?P<tag>{_NAME}|\*)|#(?P<id>[\w-]+)|\.(?P<cls>{_NAME})|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~^$*]?=)\s*(?P<value>{_VALUE})\s*)?\]"
    r"|:not\((?P<inner>[^()]*)\)"
)


class Test(NamedTuple):
    """One condition of a compound: kind, name, operator, value; ``inner`` holds what a ``:not`` excludes."""

    kind: str
    name: str = ""
    op: str = ""
    value: str = ""
    inner: tuple["Test", ...] = ()


class Step(NamedTuple):
    """A compound and how it hangs on the step before: ``""`` (the first), ``" "`` or ``">"``."""

    compound: tuple[Test, ...]
    how: str


def parse_compound(text: str) -> tuple[Test, ...]:
    tests, at = [], 0
    while at < len(text):
        part = _PART.match(text, at)
        if not part or (part["tag"] and at):
            raise ValueError(f"not a selector: {text!r}, at {text[at:]!r}")
        at = part.end()
        if part["tag"]:
            tests.append(Test("tag", part["tag"].lower()))
        elif part["id"]:
            tests.append(Test("attr", "id", "=", part["id"]))
        elif part["cls"]:
            tests.append(Test("class", part["cls"]))
        elif part["attr"]:
            value = part["value"] or ""
            tests.append(Test("attr", part["attr"].lower(), part["op"] or "", value[1:-1] if value[:1] in "\"'" else value))
        else:
            tests.append(Test("not", inner=parse_compound(part["inner"].strip())))
    if not tests:
        raise ValueError("an empty selector")
    return tuple(tests)


def _pieces(text: str, separators: str) -> list[str]:
    """Text cut at separators that are outside brackets, parentheses and quotes; the separators are pieces too."""
    found, depth, quote = [""], 0, ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        else:
            depth += (c in "[(") - (c in "])")
            if not depth and c in separators:
                found += [c, ""]
                continue
        found[-1] += c
    return found


def parse(text: str) -> list[list[Step]]:
    """The alternatives of a selector, each as steps from the outermost compound on."""
    alternatives = []
    for alternative in _pieces(text, ",")[::2]:
        steps, how = [], ""
        for piece in _pieces(alternative.strip(), BLANKS + ">"):
            if piece == ">":
                if how == ">" or not steps:
                    raise ValueError(f"not a selector: {text!r}")
                how = ">"
            elif piece and piece in BLANKS:
                how = how or " "
            elif piece:
                steps.append(Step(parse_compound(piece), how if steps else ""))
                how = ""
        if not steps or how == ">":
            raise ValueError(f"not a selector: {text!r}")
        alternatives.append(steps)
    return alternatives


def _holds(test: Test, node: Column) -> Column:
    if test.kind == "tag":
        return ~node["tag"].startswith("#") if test.name == "*" else node["tag"] == test.name
    if test.kind == "class":
        return F.array_contains(node["classes"], test.name)
    if test.kind == "not":
        return ~node["tag"].startswith("#") & ~matches(test.inner, node)
    value = node["dom_id"] if test.name == "id" else F.try_element_at(node["attrs"], F.lit(test.name))
    if not test.op:
        return value.isNotNull()
    if test.op == "~=":
        return F.array_contains(F.split(value, r"[ \t\n\r\f]+"), test.value) & F.lit(bool(test.value))
    if test.op == "=":
        return value == test.value
    compare = {"^=": value.startswith, "$=": value.endswith, "*=": value.contains}[test.op]
    return compare(test.value) & F.lit(bool(test.value))


def matches(compound: tuple[Test, ...], node: Column) -> Column:
    """True or false for every node."""
    return F.coalesce(reduce(lambda a, b: a & b, [_holds(t, node) for t in compound]), F.lit(False))


class Compiled:
    """Named selectors ready for a pass over the nodes of a page."""

    def __init__(self, selectors: Mapping[str, str]):
        self.names = list(selectors)
        self.compounds: list[tuple[Test, ...]] = []
        # Per step: bit of its compound, how it hangs on the step before, that step's bit, and the selector it completes.
        self.program: list[tuple[int, str, int, int]] = []
        for k, text in enumerate(selectors.values()):
            for steps in parse(text):
                for j, step in enumerate(steps):
                    if step.compound not in self.compounds:
                        self.compounds.append(step.compound)
                    last = k if j == len(steps) - 1 else -1
                    self.program.append((self.compounds.index(step.compound), step.how, len(self.program) - 1, last))
        if max(len(self.names), len(self.compounds), len(self.program)) > MOST:
            raise ValueError(f"over {MOST} selectors, compounds or steps; use several passes")

    def own(self, nodes: Column) -> Column:
        """Per node the bits of the compounds that it matches."""
        bits = lambda n: reduce(
            lambda a, b: a.bitwiseOR(b), [F.when(matches(c, n), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, c in enumerate(self.compounds)]
        )
        return F.transform(nodes, bits)

    def selected(self, nodes: Column) -> Column:
        """Per node the bits of the selectors that pick it."""
        return _sweep(tuple(self.program))(F.transform(nodes, lambda n: n["parent_id"]), self.own(nodes))


def swept(parents: list[int], own: list[int], program: tuple) -> list[int]:
    """Bits of the selectors that pick each node; a node's parent comes before it, -1 is none."""
    steps_of: dict[int, list] = {}
    done, above, picked = [0] * len(own), [0] * len(own), [0] * len(own)
    for i, (parent, bits) in enumerate(zip(parents, own, strict=True)):
        direct = done[parent] if parent >= 0 else 0
        around = above[parent] | direct if parent >= 0 else 0
        above[i] = around
        if not bits:
            continue
        if bits not in steps_of:
            steps_of[bits] = [(1 << k, how, 1 << before, last) for k, (c, how, before, last) in enumerate(program) if bits >> c & 1 for before in [max(before, 0)]]
        for bit, how, before, last in steps_of[bits]:
            if not how or before & (direct if how == ">" else around):
                done[i] |= bit
                if last >= 0:
                    picked[i] |= 1 << last
    return picked


def _sweep(program: tuple) -> Callable[[Column, Column], Column]:
    @part_udf(T.ArrayType(T.LongType()))
    def sweep(parents: pa.Array, own: pa.Array) -> pa.Array:
        rows = zip(parents.to_pylist(), own.to_pylist(), strict=True)
        return pa.array([None if p is None else swept(p, o, program) for p, o in rows], pa.list_(pa.int64()))

    return sweep.asNondeterministic()
