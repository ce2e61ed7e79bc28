"""Benchmark passages in documents, exact or edited, none lost.

An item of n bytes may differ from a part of the text by ``most_edits(n)`` edits. Cut into seeds of ``seed_length(n)``
bytes, it has more seeds than that, and an edit spoils one seed at most, so a known number of them stands unchanged in
the text, on diagonals (place in the text less place in the item) that differ by the number of edits at most. Parts of
the text with so many seeds of an item on so narrow a band are candidates; then a part needs as many of the item's grams
as the edits can leave, and what passes is verified by the exact edit distance. All three tests are necessary conditions:
the result is that of comparing each item with each text in full.

Of each item the seeds most frequent in the first texts are left out, and as many fewer are asked for.
Items are compared in blocks of at most ``BLOCK_BYTES``, each sent to all tasks; the documents are read once per block.
Texts are lower-cased and white space is squeezed; distances count bytes of UTF-8.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import free_name, gather, id_and_text, keyed, slices

MOST_EDITS = 0.15
SHORT, SEED, GRAM = 12, 5, 4
FEW_SEEDS = 4
PAIRS = 500_000
BLOCK_BYTES = 32_000_000
MIX, SLOT_BITS = np.uint64(0x9E3779B97F4A7C15), 20


def normal(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode("utf-8", "replace")


def most_edits(length: int) -> int:
    return int(MOST_EDITS * length)


def seed_length(length: int) -> int:
    """Bytes of an item's seeds: at most ``SEED``, and short enough for one seed more than edits are allowed."""
    return min(SEED, length // (most_edits(length) + 1))


def seed_keys(data: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` (at most 7) bytes from each position on, as one number."""
    keys = np.zeros(max(0, len(data) - size + 1), np.uint64)
    for k in range(size):
        keys = (keys << np.uint64(8)) | data[k : k + len(keys)]
    return keys


def slots(keys: np.ndarray) -> np.ndarray:
    """Place of each key in a bit table."""
    return ((keys * MIX) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def best_fit(item: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance between ``item`` and any part of ``text``, and the end of the first such part.

    One column of the distance table at a time, its differences as the bits of two integers.
    """
    same: dict[int, int] = {}
    for k, c in enumerate(item):
        same[c] = same.get(c, 0) | 1 << k
    full, last = (1 << len(item)) - 1, 1 << (len(item) - 1)
    more, less = full, 0
    score = least = len(item)
    end = 0
    for at, c in enumerate(text, 1):
        eq = same.get(c, 0)
        flat = (((eq & more) + more) ^ more) | eq | less
        up = less | (full & ~(flat | more))
        down = more & flat
        if up & last:
            score += 1
        elif down & last:
            score -= 1
            if score < least:
                least, end = score, at
        up = up << 1
        more = full & ((down << 1) | ~((eq | less) | up))
        less = up & (eq | less) & full
    return least, end


class Seeds:
    """The seeds of one length: sorted keys, the item and the place in it of each."""

    def __init__(self, size: int, items: list[tuple[int, np.ndarray]]):
        self.size = size
        keys, owner, offset = [], [], []
        for number, body in items:
            at = np.arange(0, len(body) - size + 1, size)
            keys.append(seed_keys(body, size)[at])
            owner.append(np.full(len(at), number))
            offset.append(at)
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        self.hold(flat[order], np.concatenate(owner)[order], np.concatenate(offset)[order])

    def hold(self, flat: np.ndarray, owner: np.ndarray, offset: np.ndarray) -> None:
        self.flat, self.owner, self.offset = flat, owner, offset
        self.keys, self.first, self.count = np.unique(flat, return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << SLOT_BITS, bool)
        self.maybe[slots(self.keys)] = True

    def places(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a seed lies in the text, and the number of its key."""
        keys = seed_keys(data, self.size)
        at = np.flatnonzero(self.maybe[slots(keys)])
        found = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        right = self.keys[found] == keys[at]
        return at[right], found[right]

    def drop_frequent(self, data: np.ndarray, spare: np.ndarray) -> None:
        """Do without the ``spare`` seeds of each item that are the most frequent in the text."""
        often = np.repeat(np.bincount(self.places(data)[1], minlength=len(self.keys)), self.count)
        order = np.lexsort((-often, self.owner))
        owner = self.owner[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        kept = np.sort(order[rank >= spare[owner]])
        self.hold(self.flat[kept], self.owner[kept], self.offset[kept])


class Matcher:
    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = [(i, x) for i, x in items if len(x) >= SHORT]
        self.short = [(i, x) for i, x in items if 0 < len(x) < SHORT]
        self.lengths = np.array([len(x) for _, x in self.items], np.int64)
        self.most = np.array([most_edits(len(x)) for _, x in self.items], np.int64)
        sizes = np.array([seed_length(len(x)) for _, x in self.items], np.int64)
        self.least = self.lengths // np.maximum(sizes, 1) - self.most
        self.settled = False
        self.grams: dict[int, np.ndarray] = {}
        self.reach = int((self.lengths + self.most).max()) if self.items else 0
        self.seeds = [
            Seeds(size, [(k, np.frombuffer(self.items[k][1], np.uint8)) for k in np.flatnonzero(sizes == size).tolist()])
            for size in np.unique(sizes).tolist()
        ]

    def settle(self, data: np.ndarray) -> None:
        """Leave out frequent seeds; an item then asks for fewer by as many, so no match is lost whatever the text."""
        asked = np.minimum(self.least, np.maximum(FEW_SEEDS, self.least // 2))
        for seeds in self.seeds:
            seeds.drop_frequent(data, self.least - asked)
        self.least, self.settled = asked, True

    def regions(self, data: np.ndarray, ends: np.ndarray):
        """Item, text row and the part of ``data`` (first and last diagonal) where enough of its seeds lie."""
        gap = 2 * self.reach + 1  # texts are set apart by this much, so that no diagonals of two texts are near
        span = (len(data) + (len(ends) + 2) * gap).bit_length()
        for seeds in self.seeds:
            at, key = seeds.places(data)
            pairs = np.cumsum(seeds.count[key])
            begin = 0
            while begin < len(at):
                done = pairs[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(pairs, done + PAIRS, side="right")))
                low = int(np.searchsorted(at, at[begin] - self.reach))
                which, each = gather(np.arange(len(seeds.owner)), seeds.first, seeds.count, key[low:end])
                row = np.searchsorted(ends, at[low:end], side="right")
                item = seeds.owner[which]
                placed = np.sort((item << span) + np.repeat(at[low:end] + (row + 1) * gap, each) - seeds.offset[which])
                yield from self.dense(placed, span, gap, ends)
                begin = end

    def dense(self, placed: np.ndarray, span: int, gap: int, ends: np.ndarray):
        item = placed >> span
        ahead = np.arange(len(placed)) + self.least[item] - 1
        inside = ahead < len(placed)
        first = np.flatnonzero(inside)
        first = first[placed[ahead[first]] - placed[first] <= self.most[item[first]]]
        if not len(first):
            return
        low, high, item = placed[first], placed[ahead[first]], item[first]
        new = np.ones(len(first), bool)
        new[1:] = (item[1:] != item[:-1]) | (low[1:] - high[:-1] > self.lengths[item[1:]] + 2 * self.most[item[1:]])
        begin = np.flatnonzero(new)
        high = high[np.append(begin[1:], len(first)) - 1]
        low, item = low[begin], item[begin]
        starts = np.concatenate([[0], ends[:-1]]) + (np.arange(len(ends)) + 1) * gap
        row = np.searchsorted(starts - self.reach, low & ((1 << span) - 1), side="right") - 1
        shift = (item << span) + (row + 1) * gap
        yield from zip(item.tolist(), row.tolist(), (low - shift).tolist(), (high - shift).tolist(), strict=True)

    def grams_shared(self, i: int, part: bytes) -> bool:
        """Whether the part has as many of the item's grams as are left by the most edits, each of which spoils ``GRAM``."""
        if i not in self.grams:
            self.grams[i] = seed_keys(np.frombuffer(self.items[i][1], np.uint8), GRAM)
        own = self.grams[i]
        shared = np.isin(own, seed_keys(np.frombuffer(part, np.uint8), GRAM))
        return np.count_nonzero(shared) >= len(own) - GRAM * self.most[i]

    def matches(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """Row, item id, distance and start of the best match of each item in each text."""
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        ends = np.cumsum([len(x) + 1 for x in texts])
        best: dict[tuple[int, int], tuple[int, int]] = {}
        if not self.settled:
            self.settle(data)
        for i, row, first, last in self.regions(data, ends):
            number, body = self.items[i]
            most, text = int(self.most[i]), texts[row]
            begin = int(ends[row]) - len(text) - 1
            low = max(0, first - begin - most)
            part = text[low : max(0, last - begin + len(body) + most)]
            exact = part.find(body)
            if exact < 0 and not self.grams_shared(i, part):
                continue
            distance, end = (0, exact + len(body)) if exact >= 0 else best_fit(body, part)
            if distance <= most:
                found = (distance, max(0, low + end - len(body)))
                best[row, number] = min(found, best.get((row, number), found))
        for number, body in self.short:
            for row, text in enumerate(texts):
                at = text.find(body)
                if at >= 0:
                    best[row, number] = min((0, at), best.get((row, number), (0, at)))
        return [(row, number, *x) for (row, number), x in sorted(best.items())]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """Distinct items with text, as bounded lists; rows with a null id or no text match nothing."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("i is not null and t is not null")
    for row in rows.distinct().orderBy("i", "t").toLocalIterator():
        body = normal(row["t"])
        if block and size + len(body) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        if body:
            block.append((row["i"], body))
            size += len(body)
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, start (byte in the normalised text); one row per document row and item found in it.

    Null or empty texts and items match nothing, an empty table on either side gives no rows; items shorter than
    ``SHORT`` bytes are looked up as they are. Rows repeated under one id are searched one by one.
    """
    schema = "doc_id long, item_id long, distance long, start long"
    rows = id_and_text(docs, id_col, text_col)

    def one_block(items):
        def run(batches):
            matcher = Matcher(items)
            for batch in batches:
                for part in slices(batch):
                    ids = part.column(0).to_pylist()
                    found = matcher.matches([normal(x) for x in part.column(1).to_pylist()])
                    columns = [[ids[r[0]] for r in found]] + [[r[k] for r in found] for k in (1, 2, 3)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "distance", "start"])

        return rows.mapInArrow(run, schema)

    parts = [one_block(items) for items in item_blocks(benchmark, item_col, item_text_col)]
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; rows repeated under one id, or under none, are judged one by one."""
    key = free_name(docs, "row")
    rows, _ = keyed(docs, key)
    leaking = find_leaks(rows, benchmark, id_col=key).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(leaking, key, "left_anti").select(*docs.columns)
