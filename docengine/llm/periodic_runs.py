"""Runs of repeated words: maximal stretches with a period, by Lyndon roots.

The longest Lyndon word at each place comes from phase one of Baier's suffix sorter: suffixes start in groups by first
word; from the greatest group down, each suffix of a group extends the context of the nearest place before it that is
still in a lower group, and places extended more often move to higher groups. The length of a group's context, when its
turn comes, is the length of the longest Lyndon word there. Done under the order of words and under its reverse, this
gives a root of every run; roots are extended to both sides by longest common extensions, and each run is then
verified word by word.

Only runs of length max(6, 4 periods) count. In such a run every three words in a row occur three times or more, so
places where that fails are cut away first; what is cut can neither lie in a run nor extend one. A document is worked on
whole and by one task, no two documents meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from docengine.llm.common import id_and_text, slices, split_words

LEAST_LENGTH = 6
LEAST_PERIODS = 4
SHARE_WORDS = 300_000
PRIME = np.int64(2**31 - 1)
BASES = ((48_271, 69_621), (16_807, 630_360_016), (950_706_376, 742_938_285))
RUNS = "array<struct<start:long,length:long,period:long>>"


def lyndon_lengths(codes: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place; a place with code 0 ends what comes before it."""
    n = len(codes)
    order = sorted(set(codes))
    number = {code: g for g, code in enumerate(order)}
    group = [number[c] for c in codes]
    members = [[] for _ in order]
    for i, g in enumerate(group):
        members[g].append(i)
    context = [1] * len(order)
    below, above = list(range(-1, len(order) - 1)), [*range(1, len(order)), -1]
    lengths = [0] * n
    left = list(range(n + 1))  # place i has number i + 1; 0 stands for "none"
    g = len(order) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = None
        size = context[g]
        for i in own:
            lengths[i] = size
            left[i + 1] = i
        times = {}
        for i in own:
            while left[i] != i:
                left[i] = left[left[i]]
                i = left[i]
            if i:
                times[i - 1] = times.get(i - 1, 0) + 1
        moved = {}
        for p, k in times.items():
            moved.setdefault((group[p], k), []).append(p)
        for h, k in sorted(moved, reverse=True):
            new = len(members)
            for p in moved[h, k]:
                group[p] = new
            members.append(moved[h, k])
            context.append(context[h] + k * size)
            over = above[h]
            below.append(h)
            above.append(over)
            above[h] = new
            below[over] = new  # ``over`` is a group: the one at work lies above all that move
        g = below[g]
    return lengths


class Extensions:
    """Equality of stretches of ``codes`` by polynomial hashes, and longest common extensions by doubling steps."""

    def __init__(self, codes: np.ndarray, bases: tuple[int, int]):
        self.n = len(codes)
        self.powers, self.sums = [], []
        for base in bases:
            powers = np.ones(1, np.int64)
            while len(powers) <= self.n:
                powers = np.concatenate([powers, powers * pow(base, len(powers), int(PRIME)) % PRIME])
            self.powers.append(powers)
            self.sums.append(np.concatenate([[0], np.cumsum((codes + 1) * powers[: self.n] % PRIME)]) % PRIME)

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches at ``i`` and at ``j`` (not before ``i``) agree."""
        same = np.ones(len(i), bool)
        for powers, sums in zip(self.powers, self.sums, strict=True):
            same &= (sums[i + length] - sums[i]) % PRIME * powers[j - i] % PRIME == (sums[j + length] - sums[j]) % PRIME
        return same

    def reach(self, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        """Number of equal words from ``i`` and ``j`` on, or of those before them."""
        found = np.zeros(len(i), np.int64)
        step = 1 << max(self.n.bit_length() - 1, 0)
        while step:
            room = (found + step <= i) if back else (j + found + step <= self.n)
            at = np.flatnonzero(room)
            shift = -(found[at] + step) if back else found[at]
            good = at[self.equal(i[at] + shift, j[at] + shift, np.full(len(at), step))]
            found[good] += step
            step >>= 1
        return found


def runs_of(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all counted runs of ``codes`` by start, then period; ``ends`` marks places that end a stretch."""
    ranks = np.unique(codes, return_inverse=True)[1] + 1
    top = int(ranks.max()) if len(ranks) else 0
    starts, periods = [], []
    for ordered in (ranks, top + 1 - ranks):
        lengths = np.array(lyndon_lengths(np.where(ends, 0, ordered).tolist()), np.int64)
        inside = np.flatnonzero(~ends)
        starts.append(inside)
        periods.append(lengths[inside])
    apart = np.where(ends, top + np.cumsum(ends), ranks).astype(np.int64)
    pairs = np.unique(np.concatenate(starts) * (len(codes) + 1) + np.concatenate(periods))
    i, p = np.divmod(pairs, len(codes) + 1)
    for bases in BASES:
        found = _extended(apart, i, p, Extensions(apart, bases))
        if _verified(apart, *found):
            return found
    raise ArithmeticError("no pair of hash bases gives runs that hold")


def _extended(codes, i, p, extensions):
    n = len(codes)
    after, before = i + 2 * p <= n, i >= p
    after[after] = extensions.equal(i[after], i[after] + p[after], p[after])
    before[before] = extensions.equal(i[before] - p[before], i[before], p[before])
    i, p = i[after | before], p[after | before]
    back = extensions.reach(i, i + p, True)
    length = back + p + extensions.reach(i, i + p, False)
    counted = length >= np.maximum(LEAST_LENGTH, LEAST_PERIODS * p)
    start, length, p = (i - back)[counted], length[counted], p[counted]
    first = np.unique(start * (n + 1) + p, return_index=True)[1]
    return start[first], length[first], p[first]


def _verified(codes, starts, lengths, periods) -> bool:
    for s, length, q in zip(starts.tolist(), lengths.tolist(), periods.tolist(), strict=True):
        e = s + length
        if not np.array_equal(codes[s : e - q], codes[s + q : e]):
            return False
        if (s and codes[s - 1] == codes[s + q - 1]) or (e < len(codes) and codes[e] == codes[e - q]):
            return False
    return True


def repeated_stretches(offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of the stretches in which every three words in a row may occur three times in their row.

    The counts are of hashes: equal hashes of unequal words only keep more.
    """
    n = len(codes)
    if n < LEAST_LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    mixed = rows[:-2].astype(np.uint64)
    for k in range(3):
        mixed = (mixed ^ codes[k : n - 2 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    bits = max(10, int(n).bit_length() + 2)
    places = (mixed >> np.uint64(64 - bits)).astype(np.int64)
    inner = rows[:-2] == rows[2:]
    often = np.bincount(places[inner], minlength=1 << bits)[places] >= 3
    edges = np.diff(np.concatenate([[0], (often & inner).astype(np.int8), [0]]))
    # Neighbouring rows lie at least two cut places apart, so no stretch crosses a row.
    first, past = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = past - first + 2 >= LEAST_LENGTH
    return first[long], (past - first + 2)[long]


def find(offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in ``codes``), length and period of the runs of all rows."""
    first, sizes = repeated_stretches(offsets, codes)
    found, k = [], 0
    while k < len(first):
        last = k + max(1, int(np.searchsorted(np.cumsum(sizes[k:]), SHARE_WORDS, side="right")))
        spans = [np.arange(a, a + m) for a, m in zip(first[k:last], sizes[k:last], strict=True)]
        places = np.concatenate([np.append(span, -1) for span in spans])
        starts, lengths, periods = runs_of(codes[places], places < 0)
        found.append((places[starts], lengths, periods))
        k = last
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (start, length, period in words; by start, then period), collapsed; one row per input row.

    ``collapsed`` is the words of the text, joined by one blank, without those that a run contains after its first period.
    Null text is empty; texts without words have no runs and an empty ``collapsed``. Repeated and null ids stay rows
    of their own, other columns are not read.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                offsets, codes, words = split_words(part.column(1))
                start, length, period = find(offsets, codes)
                change = np.zeros(len(codes) + 1, np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, start + length, -1)
                kept = np.cumsum(change[:-1]) == 0
                ends = np.concatenate([[0], np.cumsum(kept)])[offsets]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(codes[kept])))
                row = np.searchsorted(offsets, start, side="right") - 1
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                fields = [pa.array(x, pa.int64()) for x in (start - offsets[row], length, period)]
                runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([part.column(0), runs, pc.binary_join(lists, " ")], names=["doc_id", "runs", "collapsed"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed string")
