"""Repeated byte strings across texts, found by merging sorted runs of suffixes.

A string of ``WINDOW`` bytes has one anchor: the leftmost place in it where a hash of ``RUN`` bytes is least. Equal
strings have their anchor at the same place, so a sparse set of suffixes, those that start at anchors, shows
every repeat: with the bytes to the left of the anchor they hold all strings that own it. Anchors whose ``RUN`` bytes
occur once in the corpus are left out first.

Each task sorts its suffixes and sends them as front-coded runs (common prefix with the one before, then the
rest), dealt out by a hash of the bytes that all members of a group share, and only with the bytes that the strings of the anchor
cover. Buckets come in as many turns as keep what is sent at a time below the size of the texts. A bucket merges its runs with a loser
tree that keeps, for every contender, the common prefix with the last suffix put out: unequal prefixes decide at
once, equal ones are compared only beyond them. The merged order and its common prefixes, with the same for
the bytes to the left, tell which strings are equal; all but the first of each are removed.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import SLICE_BYTES, one_row_per_id, shuffle_partitions, slices, small_batches, staged

WINDOW, RUN = 100, 32
LEFT = WINDOW - RUN
POWERS = {k: np.uint64(pow(0x100000001B3, k, 2**64)) for k in (1, 2, 4, 8, 16)}
BUCKETS = 2  # for each shuffle partition, to halve what one group holds
SHIFT, CHUNK = np.uint64(24), 1 << 20
SENT = 120  # bytes of an anchor's suffix in a run, for the number of turns


def run_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``RUN`` bytes from each position on."""
    code = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for k in (1, 2, 4, 8, 16):
        code = code[:-k] * POWERS[k] + code[k:]
    code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return code ^ (code >> np.uint64(32))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings inside one text: hash, position, and least and greatest distance to its strings' starts."""
    if len(data) < WINDOW:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    if len(data) > CHUNK + WINDOW - 1:  # for memory, and as positions share a word with hashes; an edge's anchor is told twice
        parts = []
        for base in range(0, len(data) - WINDOW + 1, CHUNK):
            inner = ends[(ends > base) & (ends < base + CHUNK + WINDOW - 1)] - base
            keys, at, low, high = anchors(data[base : base + CHUNK + WINDOW - 1], inner)
            parts.append((keys, at + base, low, high))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    code = run_hashes(data)
    least = (code >> SHIFT << SHIFT) | np.arange(len(code), dtype=np.uint64)
    for k in (1, 2, 4, 8, 16, 32):
        least = np.minimum(least[:-k], least[k:])
    rest = LEFT + 1 - 64
    least = np.minimum(least[:-rest], least[rest:])
    at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    start = np.arange(len(at))
    inside = np.ones(len(at), bool)
    for end in ends.tolist():
        inside[max(0, end - WINDOW + 1) : max(0, end)] = False
    at, start = at[inside], start[inside]
    if not len(at):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    return code[at[first]], at[first], at[first] - start[last], at[first] - start[first]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(x) for x in texts]).astype(np.int64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of anchors; hashed again, as anchors have the least hashes and would meet in the first buckets."""
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def by_bucket(bucket: np.ndarray, names: list[str], columns: list[tuple[np.ndarray, np.ndarray | None]]) -> pa.RecordBatch:
    """One row per bucket of columns sorted by it. A column comes with the end of each element's part of it, or None: one value each."""
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    edges = np.append(starts, len(bucket))
    values = [pa.array(bucket[starts], pa.int32())]
    for flat, ends in columns:
        cuts = edges * flat.itemsize if ends is None else np.concatenate([[0], ends])[edges]
        buffers = [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))]
        values.append(pa.Array.from_buffers(pa.binary(), len(starts), buffers))
    return pa.RecordBatch.from_arrays(values, names=names)


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """doc_id, at, bucket: positions of the anchors whose hash occurs more than once."""
    buckets = BUCKETS * shuffle_partitions(rows.sparkSession)

    def emit(batches):
        for batch in batches:
            for part in slices(batch, limit=3 * SLICE_BYTES):
                data, ends = joined(part.column(1).to_pylist())
                keys, at, _, _ = anchors(data, ends)
                row = np.searchsorted(ends, at, side="right")
                ids = part.column(0).to_numpy(zero_copy_only=False).astype("<i8")
                begins = np.concatenate([[0], ends[:-1]])
                bucket = bucket_of(keys, buckets)
                order = np.argsort(bucket, kind="stable")
                flat = [keys[order], ids[row[order]], (at - begins[row])[order].astype("<u4")]
                yield by_bucket(bucket[order], ["bucket", "keys", "docs", "at"], [(x, None) for x in flat])

    def meet(table):
        keys, docs, at = (np.concatenate([np.frombuffer(x, t) for x in table.column(n).to_pylist()]) for n, t in (("keys", "<u8"), ("docs", "<i8"), ("at", "<u4")))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        kept = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        bucket = pa.repeat(pa.scalar(table.column("bucket")[0].as_py(), pa.int32()), len(kept))
        return pa.table([pa.array(docs[kept]), pa.array(at[kept].astype(np.int64)), bucket], names=["doc_id", "at", "bucket"])

    packed = rows.mapInArrow(emit, "bucket int, keys binary, docs binary, at binary")
    return packed.groupBy("bucket").applyInArrow(meet, "doc_id long, at long, bucket int")


def words_of(block: np.ndarray) -> list[np.ndarray]:
    """Columns of big-endian numbers that order the rows of a byte matrix."""
    width = -(-block.shape[1] // 8) * 8
    padded = np.zeros((len(block), width), np.uint8)
    padded[:, : block.shape[1]] = block
    return list(padded.view(">u8").T.astype(np.uint64))


def common_prefixes(block: np.ndarray) -> np.ndarray:
    """Equal leading bytes of each row and the one before; 0 for the first."""
    found = np.zeros(len(block), np.int64)
    if len(block) > 1:
        unlike = block[1:] != block[:-1]
        found[1:] = np.where(unlike.any(1), unlike.argmax(1), block.shape[1])
    return found


def contexts(data: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes from each anchor on, and backwards from the one before it, as far as its strings reach; zero beyond."""
    padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(WINDOW, np.uint8)])
    window = np.lib.stride_tricks.sliding_window_view
    right = window(padded, WINDOW)[at + LEFT]
    right *= np.arange(WINDOW) < (WINDOW - low)[:, None]
    left = np.ascontiguousarray(window(padded, LEFT)[at][:, ::-1])
    left *= np.arange(LEFT) < high[:, None]
    return right, left


def send_runs(rows: DataFrame) -> DataFrame:
    """Sorted front-coded runs by bucket, from texts and the positions of their repeated anchors."""
    buckets = BUCKETS * shuffle_partitions(rows.sparkSession)

    def emit(batches):
        for batch in batches:
            for part in slices(batch, limit=2 * SLICE_BYTES):
                yield from one(part)
            pa.default_memory_pool().release_unused()

    def one(part):
        data, ends = joined(part.column(1).to_pylist())
        begins = np.concatenate([[0], ends[:-1]])
        keys, at, low, high = anchors(data, ends)
        flagged = np.zeros(len(data) + 1, bool)
        lists = part.column(2)
        owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
        flagged[begins[owner] + lists.flatten().to_numpy(zero_copy_only=False)] = True
        kept = flagged[at]
        keys, at, low, high = keys[kept], at[kept], low[kept], high[kept]
        row = np.searchsorted(ends, at, side="right")
        ids = part.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        if not len(at):
            return
        bucket, doc, place = bucket_of(keys, buckets), ids[row], at - begins[row]
        right, left = contexts(data, at, low, high)
        order = np.lexsort([place, doc, high, low, *words_of(left)[::-1], *words_of(right)[::-1], bucket])
        bucket, right, left, doc, place, low, high = (x[order] for x in (bucket, right, left, doc, place, low, high))
        again = np.zeros(len(order), bool)
        again[1:] = (right[1:] == right[:-1]).all(1) & (left[1:] == left[:-1]).all(1) & (low[1:] == low[:-1]) & (high[1:] == high[:-1])
        gone = [doc[again], (place - high)[again].astype("<u4"), (place - low + WINDOW)[again].astype("<u4")]
        gone_ends = np.cumsum(again)[~again]
        if len(gone_ends):  # of equal contexts the first comes first, so those gone belong to the row before
            gone_ends = np.append(gone_ends[1:], again.sum())
        bucket, right, left, doc, place, low, high = (x[~again] for x in (bucket, right, left, doc, place, low, high))
        shared = np.where(np.diff(bucket, prepend=-1) != 0, 0, common_prefixes(right))
        tails = right[np.arange(WINDOW) >= shared[:, None]]
        columns = [(shared.astype(np.uint8), None), (tails, np.cumsum(WINDOW - shared)), (left, LEFT * np.arange(1, len(left) + 1))]
        columns += [(x, None) for x in (doc, place.astype("<u4"), low.astype(np.uint8), high.astype(np.uint8))]
        yield by_bucket(bucket, names, columns + [(x, x.itemsize * gone_ends) for x in gone])

    names = ["bucket", "shared", "tails", "lefts", "docs", "places", "lows", "highs", "gone_docs", "gone_from", "gone_to"]
    return rows.mapInArrow(emit, "bucket int, " + ", ".join(f"{n} binary" for n in names[1:]))


class LoserTree:
    """Merges sorted runs of equal-length strings; ``shared[r][i]`` is the common prefix of string i and i - 1 of run r."""

    def __init__(self, runs: list[list[bytes]], shared: list[bytes] | list[list[int]]):
        self.runs, self.shared = runs, shared

    def merged(self) -> tuple[list[int], list[int], list[int]]:
        """Run and place of each string in order, and its common prefix with the one before."""
        size = 1
        while size < len(self.runs):
            size *= 2
        now = [r[0] if r else None for r in self.runs] + [None] * (size - len(self.runs))
        prefix, at, losers = [0] * size, [0] * size, [0] * size
        order_run, order_at, common = [], [], []

        def duel(a: int, b: int) -> tuple[int, int]:
            """Winner and loser; the loser's prefix becomes the one with the winner."""
            x, y = now[a], now[b]
            if x is None or y is None:
                return (b, a) if x is None else (a, b)
            p, q = prefix[a], prefix[b]
            if p != q:
                return (a, b) if p > q else (b, a)
            if x == y:
                prefix[b] = len(x)
                return a, b
            rest = len(x) - p
            unlike = int.from_bytes(x[p:], "big") ^ int.from_bytes(y[p:], "big")
            p += rest - (unlike.bit_length() + 7) // 8
            if x[p] < y[p]:
                prefix[b] = p
                return a, b
            prefix[a] = p
            return b, a

        winners = list(range(size))
        level = size // 2
        while level:
            winners_next = []
            for k in range(level):
                win, lose = duel(winners[2 * k], winners[2 * k + 1])
                losers[level + k] = lose
                winners_next.append(win)
            winners, level = winners_next, level // 2
        best = winners[0]
        while now[best] is not None:
            order_run.append(best)
            order_at.append(at[best])
            common.append(prefix[best])
            at[best] += 1
            run = self.runs[best]
            if at[best] < len(run):
                now[best], prefix[best] = run[at[best]], self.shared[best][at[best]]
            else:
                now[best] = None
            node, leaf = (size + best) // 2, best
            while node:
                leaf, losers[node] = duel(leaf, losers[node])
                node //= 2
            best = leaf
        return order_run, order_at, common


def unpack_run(shared: bytes, tails: bytes) -> list[bytes]:
    """Strings of a front-coded run."""
    found, last, at = [], b"", 0
    for p in shared:
        last = last[:p] + tails[at : at + WINDOW - p]
        at += WINDOW - p
        found.append(last)
    return found


def merge_bucket(table: pa.Table) -> pa.Table:
    """doc_id, start, stop of the bytes that repeated strings of one bucket cover."""
    read = lambda n, t: np.concatenate([np.frombuffer(x, t) for x in table.column(n).to_pylist()])
    shared = table.column("shared").to_pylist()
    runs = [unpack_run(s, t) for s, t in zip(shared, table.column("tails").to_pylist(), strict=True)]
    order_run, order_at, common = LoserTree(runs, shared).merged()
    first = np.cumsum([0] + [len(r) for r in runs])
    order = first[np.array(order_run, np.int64)] + np.array(order_at, np.int64)
    del runs, order_run, order_at
    common = np.array(common, np.int64)
    docs, places, lows, highs = read("docs", "<i8"), read("places", "<u4").astype(np.int64), read("lows", np.uint8), read("highs", np.uint8)
    lefts = read("lefts", np.uint8).reshape(-1, LEFT)
    n = len(docs)
    rank = np.lexsort((places, docs))
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(common < RUN)
    by_left = np.lexsort([*words_of(lefts)[::-1], group])
    left_common = np.where(np.diff(group[by_left], prepend=-1) != 0, -1, common_prefixes(lefts[by_left]))
    covered = np.zeros((n, LEFT + 1), bool)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for before in range(LEFT + 1):
        right_class[order] = np.cumsum(common < WINDOW - before)
        left_class[by_left] = np.cumsum(left_common < before)
        mine = rank[((lows <= before) & (highs >= before))[rank]]
        _, earliest = np.unique(right_class[mine] * (n + 1) + left_class[mine], return_index=True)
        later = np.ones(len(mine), bool)
        later[earliest] = False
        covered[mine[later], before] = True
    edges = np.diff(np.pad(covered, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    who, since = np.nonzero(edges == 1)
    _, until = np.nonzero(edges == -1)
    docs_out = np.concatenate([docs[who], read("gone_docs", "<i8")])
    start = np.concatenate([places[who] - until + 1, read("gone_from", "<u4").astype(np.int64)])
    stop = np.concatenate([places[who] - since + WINDOW, read("gone_to", "<u4").astype(np.int64)])
    return pa.table([pa.array(docs_out), pa.array(start), pa.array(stop)], names=["doc_id", "start", "stop"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (start, stop of the removed bytes, apart from each other), kept (remaining bytes).

    A byte goes if a string of ``WINDOW`` bytes that covers it also starts earlier, in a document with a smaller id or
    before in the same one. Null text is empty; shorter texts lose nothing. A null id counts as smaller than all others.
    Of rows repeated under one id the one with the least text counts. Texts are below 4 GB.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), text.alias("text"))
    rows = one_row_per_id(rows)
    flagged = staged(repeated_anchors(rows), "anchors")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    turns = max(1, -(-flagged.count() * SENT // max(size, 1)))
    parts = []
    for turn in range(turns):
        mine = flagged.filter(F.col("bucket") % turns == turn).groupBy("doc_id").agg(F.collect_list("at").alias("at"))
        runs = send_runs(rows.join(mine, "doc_id").select("doc_id", "text", "at"))
        parts.append(staged(runs.groupBy("bucket").applyInArrow(merge_bucket, "doc_id long, start long, stop long"), "repeats"))
    spans = reduce(DataFrame.union, parts).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                sizes, columns, kept = [], [], []
                for body, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    merged: list[list[int]] = []
                    for x in sorted((x["start"], x["stop"]) for x in found or ()):
                        if merged and x[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], x[1])
                        else:
                            merged.append(list(x))
                    edges = [0] + [e for x in merged for e in x] + [len(body)]
                    kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    sizes.append(len(body))
                    columns.append([{"start": a, "stop": b} for a, b in merged])
                values = [part.column(0), pa.array(sizes, pa.int64()), pa.array(columns, kind), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(values, names=["doc_id", "n_bytes", "spans", "kept"])

    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    done = rows.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    done = done.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
    return done.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))
