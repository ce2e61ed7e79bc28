"""Trie of conversation prefixes: one node for every distinct sequence of first turns.

A turn is known by an MD5 of its role and text, a prefix by two 64-bit digests of position-keyed sums over its turns, so
prefixes come from running sums. Conversations of equal turns are merged before anything else. Nodes are then
dealt to shards by subtree. A shard lists its distinct prefix digests and builds a minimal perfect hash over them: every digest has
an own slot, whose stored digest, parent, depth and word count are compared with each row that lands there. Counts are scattered into flat numpy
arrays by slot and added up through an array of parent slots, deepest nodes first.

A subtree is given to one shard only if its rows are at most ``SHARD_ROWS``. Nodes above such subtrees (a first turn that
a third of all conversations share, say) are never gathered: each conversation adds what it is the smallest
member of to the nodes on its path, in a plain aggregate. Running values over a conversation are cut into ranges of ``SPAN``
turns, so one very long conversation is many tasks' work. Lists of conversation ids are digested as a stream of chunks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import shuffle_partitions, small_batches, staged

SHARD_ROWS = 50_000
SPAN = 65_536
CHUNK_IDS = 4_096
LEVELS = 48
KEY, PARENT = ["k1", "k2"], ["p1", "p2"]
WORD = r"[^\x20\x09-\x0D]+"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, id, words; null role and text are empty, rows without conv_id belong to no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    identity = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        identity.alias("id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), id, words, in order of turn, null first; equal turns by role, then by id.

    The rows are sorted across the cluster, whatever share of them one conversation has; the numbers of a conversation that
    lies in several sorted parts go on from part to part.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("id")]
    parts = staged(turns.repartitionByRange(F.col("conv_id"), *order).withColumn("part", F.spark_partition_id()), "turns")
    within = Window.partitionBy("conv_id", "part").orderBy(*order)
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("conv_id", "part").count()
    offsets = sizes.select("conv_id", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    rows = parts.withColumn("local", F.row_number().over(within)).join(offsets, ["conv_id", "part"])
    return rows.select("conv_id", (F.col("local") + F.col("offset")).alias("pos"), "id", "words")


def rebuilt(rows: DataFrame, borrowed_turns: Column, lender: Column, most: int) -> DataFrame:
    """conv_id, len, depth (from 1; 0 is the root), id, words of conversations that take their first turns from a lender.

    Of ``conv_id``, ``borrowed_turns`` says how many first turns are taken (``most`` at most), ``lender`` from whom. They
    stand in place of as many own turns; a lender that is absent or shorter gives what it has.
    """
    rows = staged(rows, "numbered")
    first = rows.filter(F.col("pos") <= most).groupBy(F.col("conv_id").alias("lender"))
    first = first.agg(F.sort_array(F.collect_list(F.struct("pos", "id", "words"))).alias("first"))
    convs = rows.groupBy("conv_id").agg(F.max("pos").alias("own")).withColumn("h", borrowed_turns).withColumn("lender", lender)
    taken = F.slice(F.coalesce("first", F.array().cast("array<struct<pos:long,id:binary,words:long>>")), F.lit(1), F.col("h").cast("int"))
    convs = convs.join(first, "lender", "left").withColumn("taken", taken).withColumn("n", F.size("taken").cast("long"))
    convs = convs.select("conv_id", "h", "n", "taken", (F.col("n") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("len"))
    convs = staged(convs, "conversations")
    root = convs.select("conv_id", "len", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("id"), F.lit(0).cast("long").alias("words"))
    lent = convs.select("conv_id", "len", F.explode("taken").alias("t")).select("conv_id", "len", F.col("t.pos").alias("depth"), "t.id", "t.words")
    own = rows.join(convs.select("conv_id", "len", "h", "n"), "conv_id").filter(F.col("pos") > F.col("h"))
    own = own.select("conv_id", "len", (F.col("pos") - F.col("h") + F.col("n")).alias("depth"), "id", "words")
    return root.union(lent).union(own)


def running_sums(rows: DataFrame, columns: list[str], backward: bool = False) -> DataFrame:
    """``rows`` with each column replaced by its sum up to the row by depth (from the row on, if ``backward``) in its conversation."""
    way = F.desc if backward else F.asc
    parts = rows.withColumn("span", F.floor(F.col("depth") / SPAN))
    totals = parts.groupBy("conv_id", "span").agg(*[F.sum(c).alias(f"total_{c}") for c in columns])
    across = Window.partitionBy("conv_id").orderBy(way("span")).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv_id", "span", *[F.coalesce(F.sum(f"total_{c}").over(across), F.lit(0)).alias(f"carried_{c}") for c in columns])
    within = Window.partitionBy("conv_id", "span").orderBy(way("depth")).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumns({c: F.sum(c).over(within) for c in columns}).join(carried, ["conv_id", "span"])
    return local.select(*[(F.col(c) + F.col(f"carried_{c}")).alias(c) if c in columns else F.col(c) for c in rows.columns])


def prefixes(steps: DataFrame) -> DataFrame:
    """conv_id, len, depth, words, digests k1, k2 of the prefix that ends here and p1, p2 of the one before (root: null)."""
    lanes = {}
    for k in (1, 2):
        one = F.xxhash64(F.lit(k), "depth", "id")
        lanes[f"lane{2 * k - 1}"] = F.when(F.col("depth") > 0, F.shiftrightunsigned(one, 32)).otherwise(0)
        lanes[f"lane{2 * k}"] = F.when(F.col("depth") > 0, one.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(0)
    keyed = steps.withColumns(lanes)
    names = list(lanes)
    summed = running_sums(keyed.withColumns({f"own_{c}": F.col(c) for c in names}), names)

    def digest(k: int, depth: Column, sums: list[Column]) -> Column:
        return F.xxhash64(F.lit(k), depth, *sums)

    at = [digest(k, F.col("depth"), [F.col(c) for c in names[2 * k - 2 : 2 * k]]).alias(KEY[k - 1]) for k in (1, 2)]
    before = [
        F.when(F.col("depth") > 0, digest(k, F.col("depth") - 1, [F.col(c) - F.col(f"own_{c}") for c in names[2 * k - 2 : 2 * k]])).alias(PARENT[k - 1])
        for k in (1, 2)
    ]
    return summed.select("conv_id", "len", "depth", "words", *at, *before)


def endings(paths: DataFrame) -> DataFrame:
    """One row per distinct whole conversation: conv_id (the smallest), copies, ends (SHA-256 of all ids, ascending, comma-joined)."""
    chunk = F.floor(F.col("conv_id") / CHUNK_IDS)
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string"))
    chunks = paths.filter("depth = len").groupBy(*KEY, chunk.alias("chunk")).agg(
        F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n"), F.array_join(ids, ",").alias("ids"))

    def digest(batches):
        def done():
            columns = [pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([sha.digest()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "copies", "ends"])

        key, ready = None, []
        for batch in batches:
            for *at, least, count, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != key:
                    if key:
                        ready.append(done())
                    key, first, n, sha = at, least, 0, hashlib.sha256()
                else:
                    sha.update(b",")
                n += count
                sha.update(ids.encode())
            if ready:
                yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
                ready = []
        if key:
            yield done()

    ordered = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").select(*KEY, "first", "n", "ids")
    return ordered.mapInArrow(digest, "conv_id long, copies long, ends binary")


class SlotTable:
    """A minimal perfect hash of distinct digests: each of n digests has an own slot from 0 to n - 1.

    Digests that fall alone on a place of a level keep it, the others go to the next level; a slot is the number of kept places
    before it. What is left after all levels is looked up in a sorted list.
    """

    def __init__(self, digests: np.ndarray):
        self.levels, start, left = [], 0, digests
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(2 * len(left), 4)
            places = self._places(left, level, size)
            alone = np.bincount(places, minlength=size) == 1
            self.levels.append((alone, start + np.cumsum(alone) - alone))
            start += int(alone.sum())
            left = left[~alone[places]]
        self.rest = {tuple(d): start + k for k, d in enumerate(sorted(map(tuple, left.tolist())))}
        self.digests = np.zeros_like(digests)
        self.digests[self._slots(digests)] = digests

    @staticmethod
    def _places(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = digests.view(np.uint64) if digests.flags.c_contiguous else np.ascontiguousarray(digests).view(np.uint64)
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        code = (mixed[:, 0] ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
        code = (code ^ (code >> np.uint64(31)) ^ mixed[:, 1]) * np.uint64(0x94D049BB133111EB)
        return ((code ^ (code >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def _slots(self, digests: np.ndarray) -> np.ndarray:
        slots, open_ = np.full(len(digests), -1, np.int64), np.arange(len(digests))
        for level, (alone, rank) in enumerate(self.levels):
            places = self._places(digests[open_], level, len(alone))
            hit = alone[places]
            slots[open_[hit]] = rank[places[hit]]
            open_ = open_[~hit]
        for k in open_ if self.rest else []:
            slots[k] = self.rest.get(tuple(digests[k].tolist()), -1)
        return slots

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """Slot of each digest, -1 for one that is not in the table: the digest stored there is compared."""
        slots = self._slots(digests)
        slots[slots >= 0] = np.where((self.digests[slots[slots >= 0]] == digests[slots >= 0]).all(axis=1), slots[slots >= 0], -1)
        return slots


NODE = "k1 long, k2 long, p1 long, p2 long, conv_id long, depth long, n_convs long, words long, ends binary"
SUMMED = ", parent_conv_id long, n_children long, n_leaves long, saved_tokens long, top boolean"


def shard_nodes(rows: pa.Table) -> pa.Table:
    """The nodes of whole subtrees from their conversations' rows, with counts and sums over each subtree."""
    value = {c: rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("conv_id", "depth", "words", "copies")}
    no_parent = rows.column("p1").combine_chunks().is_null().to_numpy(zero_copy_only=False)
    digest, parent = (
        np.stack([rows.column(c).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for c in pair], axis=1) for pair in (KEY, PARENT)
    )
    first = np.unique(np.ascontiguousarray(digest).view([("a", "i8"), ("b", "i8")]).ravel(), return_index=True)[1]
    table = SlotTable(np.ascontiguousarray(digest[first]))
    slot, n = table.slots(digest), len(first)
    conv, depth, words, above = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
    depth[slot], words[slot], above[slot] = value["depth"], value["words"], parent
    orphan = np.zeros(n, bool)
    orphan[slot] = no_parent
    if (slot < 0).any() or (depth[slot] != value["depth"]).any() or (words[slot] != value["words"]).any() or (above[slot] != parent).any():
        raise ValueError("two prefixes have one digest")
    np.minimum.at(conv, slot, value["conv_id"])
    n_convs = np.bincount(slot, value["copies"], n).astype(np.int64)
    up = np.where(orphan, -1, table.slots(above))
    inner = up >= 0
    children = np.bincount(up[inner], minlength=n)
    leaves, saved = (children == 0).astype(np.int64), (n_convs - 1) * words
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        level = level[inner[level]]
        np.add.at(leaves, up[level], leaves[level])
        np.add.at(saved, up[level], saved[level])
    ends = np.full(n, -1, np.int64)
    last = np.flatnonzero(rows.column("ends").combine_chunks().is_valid().to_numpy(zero_copy_only=False))
    ends[slot[last]] = last
    columns = {
        "k1": table.digests[:, 0], "k2": table.digests[:, 1], "p1": pa.array(above[:, 0], mask=orphan), "p2": pa.array(above[:, 1], mask=orphan),
        "conv_id": conv, "depth": depth, "n_convs": n_convs, "words": words,
        "ends": rows.column("ends").combine_chunks().take(pa.array(ends, mask=ends < 0)),
        "parent_conv_id": pa.array(conv[np.maximum(up, 0)], mask=~inner), "n_children": children, "n_leaves": leaves, "saved_tokens": saved,
        "top": ~inner,
    }
    return pa.table({name: c if isinstance(c, pa.Array) else pa.array(c) for name, c in columns.items()})


def subtree_nodes(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """All nodes with their sums, from ``rows`` of distinct conversations (conv_id, len, depth, words, digests, copies, ends)."""
    rows = staged(rows, "paths")
    spark = rows.sparkSession
    weights = rows.groupBy(*KEY).agg(F.sum(F.col("len") - F.col("depth") + 1).alias("weight"))
    heavy = staged(weights.filter(F.col("weight") > shard_rows).select(*KEY, F.lit(True).alias("heavy")), "heavy")
    marked = staged(rows.join(heavy, KEY, "left").withColumn("heavy", F.coalesce("heavy", F.lit(False))), "marked")
    light, upper = marked.filter(~F.col("heavy")), marked.filter("heavy")
    top = light.groupBy("conv_id").agg(F.min_by("k1", "depth").alias("shard"))
    shards = max(shuffle_partitions(spark), 2 * (rows.count() // shard_rows + 1))
    dealt = light.join(top, "conv_id").withColumn("shard", F.pmod(F.xxhash64("shard"), F.lit(shards)))
    dealt = dealt.select("shard", "conv_id", "depth", "words", *KEY, *PARENT, "copies", "ends")
    below = staged(dealt.groupBy("shard").applyInArrow(shard_nodes, NODE + SUMMED), "nodes")

    own = upper.groupBy(*KEY).agg(
        *[F.max(c).alias(c) for c in PARENT], F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        F.sum("copies").alias("n_convs"), F.max("words").alias("words"), F.max("ends").alias("ends"),
    )
    own = staged(own, "upper")
    tops = below.filter("top").select("conv_id", *PARENT, "n_leaves", F.col("saved_tokens").alias("saved"))
    children = own.select(*PARENT).union(tops.select(*PARENT)).filter("p1 IS NOT NULL").groupBy(*PARENT).agg(F.count(F.lit(1)).alias("n_children"))
    children = children.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children")
    # A conversation is the smallest member of a run of nodes down to the end of its path, one subtree's top among them at most.
    gains = own.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("gain"))
    path = upper.select("conv_id", "depth", *KEY).join(gains, ["conv_id", "depth"], "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
    path = running_sums(path, ["gain"], backward=True).join(tops.select("conv_id", "n_leaves", "saved"), "conv_id", "left")
    sums = path.groupBy(*KEY).agg(
        F.sum(F.coalesce("n_leaves", F.lit(0))).alias("n_leaves"), F.sum(F.col("gain") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"))
    above = own.join(children, KEY, "left").join(sums, KEY, "left")
    above = above.withColumn("parent_conv_id", F.lit(None).cast("long")).withColumn("top", F.lit(True)).select(*below.columns)
    whose = own.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("upper_conv_id"))
    joined = below.union(above).join(whose, PARENT, "left")
    return joined.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "upper_conv_id")).drop("upper_conv_id")


def prefix_trie(conversations: DataFrame, borrowed_turns: Column | None = None, lender: Column | None = None, most: int = 0,
                shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per distinct prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role and text; other columns are not read. Turns go by ``turn``, null first, equal
    turns by role, then by an MD5 of role and text; repeated rows are turns of their own. Null role or text is empty. Rows whose
    conv_id is null belong to no conversation. An empty table has no nodes, not even a root. ``borrowed_turns``,
    ``lender`` and ``most`` are those of ``rebuilt``; by default conversations are taken as they are.
    """
    small_batches(conversations.sparkSession)
    zero = F.lit(0).cast("long")
    steps = rebuilt(numbered(turn_rows(conversations)), zero if borrowed_turns is None else borrowed_turns, F.col("conv_id") if lender is None else lender, most)
    paths = staged(prefixes(steps), "prefixes")
    last = F.when(F.col("depth") == F.col("len"), F.col("ends")).alias("ends")
    rows = paths.join(endings(paths), "conv_id").select(*paths.columns, "copies", last)
    ends = F.lower(F.hex(F.coalesce("ends", F.unhex(F.sha2(F.lit(b""), 256))))).alias("ends_sha256")
    return subtree_nodes(rows, shard_rows).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)
