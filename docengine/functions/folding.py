"""Unicode folding.

Folding to ASCII needs no Python worker: compatibility decomposition maps every
code point on its own, and all that is not ASCII is dropped afterwards, so only
code points whose decomposition holds ASCII characters matter. The two tables
below come from that rule: one character to one character goes to ``translate``,
one to several (such as one half) goes to a small map that is only consulted
for text that holds such a character.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[dict[str, str], dict[str, str]]:
    single: dict[str, str] = {}
    several: dict[str, str] = {}
    for point in range(0x80, sys.maxunicode + 1):
        char = chr(point)
        if not unicodedata.decomposition(char):
            continue
        ascii_part = "".join(c for c in unicodedata.normalize("NFKD", char) if c < "\x80")
        if len(ascii_part) == 1:
            single[char] = ascii_part
        elif ascii_part:
            several[char] = ascii_part
    return single, several


@lru_cache(maxsize=1)
def _fold_literals() -> tuple[str, str]:
    """The several-character table as one string, and its characters as a regex class."""
    _, several = _fold_tables()
    entries = "\x01".join(f"{char}\x02{spelled}" for char, spelled in several.items())
    return entries, f"[{_ranges([ord(c) for c in several])}]"


def _ranges(points: list[int]) -> str:
    """Sorted code points as regex class members."""
    runs: list[list[int]] = []
    for point in points:
        if runs and point == runs[-1][1] + 1:
            runs[-1][1] = point
        else:
            runs.append([point, point])
    return "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in runs)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_fold(text: Column) -> Column:
    """Decompose (NFKD) and drop everything outside ASCII."""
    single, _ = _fold_tables()
    entries, several_class = _fold_literals()
    mapping = F.str_to_map(F.lit(entries), F.lit("\x01"), F.lit("\x02"))

    # A place is held against the long class only if it is outside ASCII.
    several = rf"(?=[^\x00-\x7f]){several_class}"

    def spell(t: Column) -> Column:
        """The text between the characters of the class, with what each of them stands for."""
        between, found = F.split(t, several, -1), F.regexp_extract_all(t, F.lit(f"({several})"), F.lit(1))
        pairs = F.zip_with(between, found, lambda a, c: F.concat(a, F.coalesce(F.try_element_at(mapping, c), F.lit(""))))
        return F.array_join(pairs, "")

    def fold(t: Column) -> Column:
        wide = F.regexp_replace(t, r"[\x00-\x7f]+", "").rlike(several_class)
        folded = F.translate(F.when(wide, spell(t)).otherwise(t), "".join(single), "".join(single.values()))
        return F.when(t.rlike(r"[^\x00-\x7f]"), F.regexp_replace(folded, r"[^\x00-\x7f]+", "")).otherwise(t)

    return let(text, fold)


@F.arrow_udf(T.StringType())
def ascii_text(text: pa.Array) -> pa.Array:
    """``ascii_fold`` as a function that SQL can call."""
    folded = (None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in text.to_pylist())
    return pa.array(folded, pa.string())


@F.arrow_udf(T.StringType())
def compat_fold(text: pa.Array) -> pa.Array:
    """Compose (NFKC); the unicode-keeping slug is the only user."""
    return pa.array(
        [None if t is None else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string()
    )
