"""Self-join of texts by the Jaccard similarity of their word shingles, exact, by a partitioned universe.

Shingles are hashed to 64 bits. Sets are put in bands by size such that a partner is in the same band or the
next. Per band the hash universe is cut into segments. Two linked sets differ in at most H shingles, a
seventh of their sizes' sum, so of more than H segments with content one is alike in both: equal segment
subsets are what the index holds and what candidates share. A segment can be worth nothing: when it is empty, or
when its subset is so frequent that it says little. Cost decides: frequent subsets whose documents don't
turn out to be linked are skipped, and a document whose other segments no longer outnumber H is indexed
again with every shingle as a segment of its own, where a set always has more segments than H. (A segment's neighbourhood
by one deletion is the empty set there, so the finer cut stands for it.) Of the subsets that remain, a document skips its
most frequent ones as far as its partners must share more than those: pairs meet in rare subsets only.

Of a subset's documents only pairs with the smallest are compared first; once linked documents are
joined to components, subsets inside one component need no more work. So groups of copies cost no pairs.

Near copies of one text that lie just outside its component share nearly all subsets and would be paired each with each.
With single shingles they are told apart by what they differ in from one of them, their pivot: linked documents that are in
different components share many of these differences, which are rare where the subsets are frequent.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import free_name, id_and_text, keyed, shuffle_partitions, slices, split_words, staged
from docengine.llm.components import components

WORDS = 5
FREQUENT = 12  # a subset that more components share says little
COARSE, SINGLE = 0.42, None  # segments for each shingle of a band's largest set; None: every shingle is a segment
KEPT_SHARE = 4  # one part in so many of what partners must share stays after skipping
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(code: np.ndarray) -> np.ndarray:
    code = (code ^ (code >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return code ^ (code >> np.uint64(29))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of five lower-cased words.

    A text of one to four words has its whole sequence as one; a text without words has none.
    """
    offsets, codes, words = split_words(pc.ascii_lower(texts))
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
    stream = known[codes]
    code = np.full(max(len(stream) - WORDS + 1, 0), WORDS, np.uint64)
    for k in range(WORDS):
        code = mix((code + stream[k : k + len(code)]) * MULTIPLIER)
    found = []
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if end - start >= WORDS:
            found.append(np.unique(code[start : end - WORDS + 1]))
        elif end > start:
            short = np.full(1, end - start, np.uint64)
            for k in range(start, end):
                short = mix((short + stream[k : k + 1]) * MULTIPLIER)
            found.append(short)
        else:
            found.append(code[:0])
    return found


def upper_sizes(limit: int) -> list[int]:
    """Largest size of each band; a set's partners are in its band or a neighbouring one."""
    sizes = [0]
    while sizes[-1] < limit:
        sizes.append(max(sizes[-1] + 1, sizes[-1] * 4 // 3))
    return sizes


BANDS = np.array(upper_sizes(2**40))


def segments_of(top: int, rate: float) -> int:
    """Number of segments of a band whose largest set has ``top`` shingles."""
    return int(np.ceil(rate * top)) + 4


def places(tokens: np.ndarray, band: int, rate: float) -> np.ndarray:
    """Segment of each token; they ascend with the sorted tokens."""
    return ((tokens >> np.uint64(32)) * np.uint64(segments_of(int(BANDS[band]), rate))) >> np.uint64(32)


def filled(tokens: np.ndarray, band: int, rate: float) -> int:
    """Number of segments with content."""
    if rate is None:
        return len(tokens)
    place = places(tokens, band, rate)
    return 1 + int(np.count_nonzero(place[1:] != place[:-1]))


def signatures(tokens: np.ndarray, band: int, rate: float) -> np.ndarray:
    """One hash per segment with content: its subset, its number and the band."""
    if rate is None:
        return mix(tokens + mix(np.full(1, band, np.uint64) * MULTIPLIER))
    count = segments_of(int(BANDS[band]), rate)
    place = places(tokens, band, rate)
    starts = np.flatnonzero(np.diff(place, prepend=np.uint64(count)))
    sums = np.add.reduceat(mix(tokens), starts)
    return mix(sums + mix(place[starts] * MULTIPLIER + np.uint64(band)))


def roles(size: int) -> list[tuple[int, int]]:
    """Bands in which a set of ``size`` is indexed, with the most shingles in which it and a partner differ there."""
    band = int(np.searchsorted(BANDS, size))
    found = [(band, (size + min(size * 4 // 3, int(BANDS[band + 1]))) // 7)]
    if band > 1:
        found.append((band - 1, (size + min(size, int(BANDS[band - 1]))) // 7))
    return found


def measure(docs: DataFrame, rate: float) -> DataFrame:
    """doc_id, n_shingles, mark (128-bit hash of the whole set; null if empty), rooms.

    Rooms: per band in which the set is indexed, its segments with content less H, and H as ``most``.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column(1))
                marks = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
                sizes = pa.array([len(x) for x in sets], pa.int64())
                rooms = [[{"band": b, "room": filled(x, b, rate) - most, "most": most} for b, most in roles(len(x))] if len(x) else [] for x in sets]
                values = [part.column(0), sizes, pa.array(marks, pa.binary()), pa.array(rooms, kind)]
                yield pa.RecordBatch.from_arrays(values, names=["doc_id", "n_shingles", "mark", "rooms"])

    kind = pa.list_(pa.struct([("band", pa.int64()), ("room", pa.int64()), ("most", pa.int64())]))
    return docs.mapInArrow(run, "doc_id long, n_shingles long, mark binary, rooms array<struct<band:long,room:long,most:long>>")


def index_groups(docs: DataFrame, rate: float) -> DataFrame:
    """Documents that share segment subsets: gid, band, n (subsets with exactly these members), doc_id.

    Subset hashes travel in packed arrays, sorted into as many buckets as there are shuffle partitions.
    """
    buckets = shuffle_partitions(docs.sparkSession)

    def emit(batches):
        for batch in batches:
            for part in slices(batch):
                ids, owner, bands, keys, seen = [], [], [], [], {}
                for doc, tokens in zip(part.column(0).to_pylist(), shingle_sets(part.column(1)), strict=True):
                    if doc is None or not len(tokens) or seen.setdefault(tokens.tobytes(), doc) != doc:
                        continue
                    for band, _ in roles(len(tokens)):
                        found = signatures(tokens, band, rate)
                        keys.append(found)
                        owner.append(np.full(len(found), len(ids), np.int32))
                        ids.append(doc)
                        bands.append(band)
                if not ids:
                    continue
                keys, owner = np.concatenate(keys), np.concatenate(owner)
                bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                order = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                ids, bands = np.array(ids, np.int64), np.array(bands, np.int32)
                rows = []
                for b in np.flatnonzero(np.diff(ends)).tolist():
                    mine = order[ends[b] : ends[b + 1]]
                    docs_, count = np.unique(owner[mine], return_counts=True)
                    rest = (keys[mine] * MULTIPLIER ^ (keys[mine] >> np.uint64(17))) & np.uint64(0xFFFFFFFFFF)
                    packed = rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                    rows.append([b, ids[docs_].tobytes(), bands[docs_].tobytes(), count.astype("<u4").tobytes(), packed])
                columns = [pa.array([r[k] for r in rows], pa.int32() if k == 0 else pa.binary()) for k in range(5)]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "ids", "bands", "counts", "keys"])

    def meet(table):
        parts = []
        for ids, bands, counts, keys in zip(*(table.column(c).to_pylist() for c in ("ids", "bands", "counts", "keys")), strict=True):
            counts = np.frombuffer(counts, "<u4")
            wide = np.zeros((int(counts.sum()), 8), np.uint8)
            wide[:, :5] = np.frombuffer(keys, np.uint8).reshape(-1, 5)
            parts.append((wide.view("<u8").ravel(), np.repeat(np.frombuffer(ids, np.int64), counts), np.repeat(np.frombuffer(bands, np.int32), counts)))
        keys, docs_, bands = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((docs_, keys))
        keys, docs_, bands = keys[order], docs_[order], bands[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(first, len(keys)))
        groups: dict[tuple, int] = {}
        for start, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            members = docs_[start : start + n]
            if members[0] != members[-1]:
                key = (int(bands[start]), np.unique(members).tobytes())
                groups[key] = groups.get(key, 0) + 1
        rows = [(xxhash.xxh3_64_intdigest(m, seed=band) >> 1, band, n, np.frombuffer(m, np.int64)) for (band, m), n in groups.items()]
        sizes = [len(r[3]) for r in rows]
        columns = [np.repeat(np.array([r[k] for r in rows], np.int64), sizes) for k in range(3)]
        columns.append(np.concatenate([r[3] for r in rows]) if rows else np.zeros(0, np.int64))
        return pa.table([pa.array(c) for c in columns], names=["gid", "band", "n", "doc_id"])

    packed = docs.mapInArrow(emit, "bucket int, ids binary, bands binary, counts binary, keys binary")
    return packed.groupBy("bucket").applyInArrow(meet, "gid long, band long, n long, doc_id long")


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose shingle sets link, compared in full."""
    near = pairs
    wanted = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.join(wanted, "doc_id", "left_semi")

    def compare(batches):
        for batch in batches:
            start, sizes_ = 0, np.cumsum([len(x or "") + len(y or "") for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)])
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(sizes_, (sizes_[start - 1] if start else 0) + 4_000_000)))
                part = batch.slice(start, end - start)
                keep = []
                for x, y in zip(shingle_sets(part.column(2)), shingle_sets(part.column(3)), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= 75 * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in part.columns[:2]], names=["a", "b"])
                start = end

    text_a, text_b = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))
    rows = near.select("a", "b").join(text_b, "b").join(text_a, "a").select("a", "b", "text_a", "text_b")
    return staged(rows.mapInArrow(compare, "a long, b long"), "verified")


def promising(counted: DataFrame, room: DataFrame, sizes: DataFrame, share: float = 1.0) -> DataFrame:
    """Pairs (a, b) of ``counted`` (a, b, band, shared) that can link by their sizes and by the subsets they share.

    Linked sets differ in at most H segments, so they share all others with content: at least the ``room`` of either. What one
    of them ``skipped`` is not counted. A smaller ``share`` allows for subsets that were counted elsewhere.
    """
    for side in ("a", "b"):
        size = sizes.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"n_{side}"))
        rooms = room.select(F.col("doc_id").alias(side), "band", F.col("room").alias(f"room_{side}"), F.col("skipped").alias(f"skipped_{side}"))
        counted = counted.join(size, side).join(rooms, [side, "band"])
    near = counted.filter("n_a * 4 >= n_b * 3 and n_b * 4 >= n_a * 3")
    if share == 1.0:  # a pair of which neither side is covered here is left to the next index
        near = near.filter("greatest(room_a, room_b) >= 1")
    least = F.greatest("room_a", "room_b") - F.greatest("skipped_a", "skipped_b")
    return near.filter(F.col("shared") >= share * least).select("a", "b").distinct()


def resolve(docs: DataFrame, sizes: DataFrame, same: DataFrame, room: DataFrame, rate: float | None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Links that the index at ``rate`` finds beside those ``known``, and the documents it does not cover (none with single shingles)."""
    last = rate is None
    none = F.lit(0).cast("long").alias("skipped")
    groups = index_groups(docs, rate).groupBy("gid", "band", "doc_id").agg(F.sum("n").alias("n"))
    groups = groups.join(same, "doc_id").groupBy("gid", "band", F.col("set_id").alias("doc_id")).agg(F.max("n").alias("n"))
    members = staged(groups, "members")
    # Of a subset's documents the one with the fewest segments of its own is the likeliest to link with the others.
    met = members.groupBy("doc_id", "band").agg(F.sum("n").alias("met")).join(room, ["doc_id", "band"])
    alone = met.select("doc_id", "band", (F.col("room") + F.col("most") - F.col("met")).alias("alone"))
    leaders = members.join(alone, ["doc_id", "band"]).groupBy("gid", "band").agg(F.min_by("doc_id", F.struct("alone", "doc_id")).alias("leader"), F.count(F.lit(1)).alias("members"))
    led = members.join(leaders.filter("members > 1"), ["gid", "band"]).filter("leader <> doc_id")
    led = led.groupBy(F.least("leader", "doc_id").alias("a"), F.greatest("leader", "doc_id").alias("b"), "band").agg(F.sum("n").alias("shared"))
    first = staged(promising(led, room.select("*", none), sizes, 0.5), "pairs")
    links = verified(docs, first)
    labels = components(links if known is None else links.union(known))
    placed = members.join(labels, members.doc_id == labels.node, "left").select("gid", "band", "n", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    parts = placed.groupBy("gid", "band", "component").agg(F.count(F.lit(1)).alias("size"))
    open_ = parts.groupBy("gid", "band").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("size")).filter("parts > 1")
    mixed = staged(placed.join(open_, ["gid", "band"]), "mixed")
    few, left, short = mixed, room, None
    if not last:
        few, many = mixed.filter(F.col("parts") <= FREQUENT), mixed.filter(F.col("parts") > FREQUENT)
        lost = many.groupBy("doc_id", "band").agg(F.sum("n").alias("lost"))
        left = room.join(lost, ["doc_id", "band"], "left").select("doc_id", "band", (F.col("room") - F.coalesce("lost", F.lit(0))).alias("room"), "most")
        left = staged(left, "room")
        short = staged(left.filter("room < 1").select("doc_id").distinct(), "short")
    reached = _within_reach(few, left)
    pivots = None
    if last:
        reached = staged(reached, "reached")
        pivots = _pivots(reached, members, leaders)
    rare, skipped = _rarest(reached, left, sizes)
    more = promising(_across(rare, pivots), skipped, sizes)
    if last:
        holds = members.join(leaders.filter("members > 1").select("gid", "band"), ["gid", "band"])
        apart = staged(_differences(holds, pivots, sizes), "differences")
        close = _placed(apart, labels).filter("out and excess <= n_pivot").select(F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b")).distinct()
        met = verified(docs, staged(close.join(first, ["a", "b"], "left_anti"), "pairs"))
        if not met.isEmpty():
            links = links.union(met)
            labels = components(links if known is None else links.union(known))
        more = more.union(_beside_pivots(_placed(apart, labels))).distinct()
    fresh = staged(staged(more, "pairs").join(first, ["a", "b"], "left_anti"), "pairs")
    return links.union(verified(docs, fresh)), short


def _pivots(placed: DataFrame, members: DataFrame, leaders: DataFrame) -> DataFrame:
    """doc_id, band, pivot of the documents of ``placed``: of the leaders of its subsets, the one that leads most of its segments."""
    able = placed.select("doc_id", "band").distinct()
    led = members.join(able, ["doc_id", "band"]).join(leaders.filter("members > 1"), ["gid", "band"])
    led = led.groupBy("doc_id", "band", "leader").agg(F.sum("n").alias("n"))
    found = led.groupBy("doc_id", "band").agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("pivot"))
    return staged(found, "pivots")


def _differences(holds: DataFrame, pivots: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc_id, band, pivot, total, n_pivot, excess, parts (gid, n): what each document and its pivot differ in, by subset.

    Of subsets (``holds``: gid, band, n, doc_id) that are single shingles; those of the pivot that nobody else has are one part of every document, with a
    gid of -1, and those of the document alone are none. ``excess`` is seven times the number of differences less the document's shingles:
    two documents of one pivot link if the sum of theirs is at most fourteen times the differences that they share.
    """
    led = pivots.select("pivot", "band").distinct()
    holds = holds.select("band", "doc_id", F.concat_ws(":", "gid", "n").alias("part"))  # plain values, as arrays of structs are compared pair by pair
    of_pivot = holds.withColumnRenamed("doc_id", "pivot").join(led, ["pivot", "band"])
    of_pivot = of_pivot.groupBy("pivot", "band").agg(F.collect_list("part").alias("theirs"))
    own = holds.join(pivots, ["doc_id", "band"]).groupBy("doc_id", "band", "pivot").agg(F.collect_list("part").alias("own"))
    total = sizes.select("doc_id", F.col("n_shingles").alias("total"))
    both = own.join(of_pivot, ["pivot", "band"]).join(total, "doc_id")
    both = both.join(total.select(F.col("doc_id").alias("pivot"), F.col("total").alias("n_pivot")), "pivot")
    piece = lambda part, at: F.substring_index(part, ":", at).cast("long")
    weight = lambda parts: F.aggregate(parts, F.lit(0).cast("long"), lambda x, part: x + piece(part, -1))
    both = both.select("*", F.array_except("theirs", "own").alias("missing"), F.array_except("own", "theirs").alias("added"))
    both = both.withColumn("shared", weight(F.col("theirs")) - weight(F.col("missing"))).withColumn("unseen", F.col("n_pivot") - weight(F.col("theirs")))
    unseen = F.array(F.concat_ws(":", F.lit(-1), "unseen"))
    excess = 7 * (F.col("total") + F.col("n_pivot") - 2 * F.col("shared")) - F.col("total")
    excess = F.when(F.col("doc_id") == F.col("pivot"), -F.col("total")).otherwise(excess)
    parts = F.when(F.col("unseen") > 0, F.concat("missing", "added", unseen)).otherwise(F.concat("missing", "added"))
    parts = F.transform(parts, lambda part: F.struct(piece(part, 1).alias("gid"), piece(part, -1).alias("n")))
    return both.select("doc_id", "band", "pivot", "total", "n_pivot", excess.alias("excess"), parts.alias("parts"))


def _placed(apart: DataFrame, labels: DataFrame) -> DataFrame:
    """``apart`` with each document's component and whether it is ``out`` of its pivot's."""
    at = labels.select(F.col("node").alias("doc_id"), "component")
    rows = apart.join(at, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    rows = rows.join(at.select(F.col("doc_id").alias("pivot"), F.col("component").alias("home")), "pivot", "left")
    return rows.withColumn("out", F.col("component") != F.coalesce("home", "pivot")).drop("home")


def _beside_pivots(placed: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents of one pivot in different components that can link by the differences they share.

    One of the two is out of the pivot's component. The other, if it is in there or has the lesser excess, knows from its own excess how many
    differences they share at least, and asks by all but its most frequent ones, as far as that leaves some.
    """
    rows = staged(placed.filter("doc_id <> pivot"), "placed")
    least = rows.filter("out").groupBy("pivot", "band").agg(F.min("excess").alias("least"))
    each = rows.select("doc_id", "band", "pivot", "total", "excess", "component", "out", F.inline("parts"))
    beyond = lambda f: f(F.when(F.col("out"), F.col("component")))
    holders = each.groupBy("pivot", "band", "gid").agg(
        F.count_if("out").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"), beyond(F.min).alias("out_low"), beyond(F.max).alias("out_high")
    )
    each = each.join(holders.filter("size > 0 and low < high"), ["pivot", "band", "gid"]).join(least, ["pivot", "band"])
    each = each.withColumn("asks", F.expr("if(out_low < out_high or out_low <> component, n, 0)"))
    mine = Window.partitionBy("doc_id", "band")
    order = mine.orderBy(F.desc("size"), F.desc("gid")).rowsBetween(Window.unboundedPreceding, 0)
    need = F.ceil((F.col("excess") + F.when(F.col("out"), F.col("excess")).otherwise(F.col("least"))) / 14)
    each = each.select("*", F.sum("asks").over(order).alias("frequent"), F.sum("asks").over(mine).alias("reach"), F.sum("n").over(mine).alias("answers"), need.alias("need"))
    each = staged(each.drop("size", "low", "high", "out_low", "out_high", "least"), "ranked")
    asking = each.filter("asks > 0 and reach >= need")
    skipped = asking.filter("frequent < need").groupBy(F.col("doc_id").alias("a"), "band").agg(F.max("frequent").alias("skipped"))
    keys, key = ["pivot", "band", "gid"], ("doc_id", "component", "excess", "total")
    x = asking.filter("frequent >= need").select(*keys, "n", "out", F.col("reach").alias("c"), *(F.col(k).alias(v) for k, v in zip(key, "apus", strict=True)))
    y = each.filter("out").select(*keys, F.col("answers").alias("d"), *(F.col(k).alias(v) for k, v in zip(key, "bqvt", strict=True)))
    able = "p <> q and s * 4 >= t * 3 and t * 4 >= s * 3 and 14 * least(c, d) >= u + v and (not out or u < v or (u = v and a < b))"
    met = x.join(y, keys).filter(able).groupBy("a", "b", "band", "u", "v").agg(F.sum("n").alias("shared"))
    met = met.join(skipped, ["a", "band"], "left").filter("14 * (shared + coalesce(skipped, 0)) >= u + v")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rarest(placed: DataFrame, room: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subsets without the most frequent ones of each document, and its room with what it ``skipped``.

    The order by frequency is the same for all. Of what a pair must share, each skips an end of that order, and the longer of the
    two ends holds less than its document must share: so linked pairs still share the rest, and it is not empty. ``alone`` is the
    number of segments that a document shares with no other component, ``total`` its shingles.
    """
    order = Window.partitionBy("doc_id", "band").orderBy(F.desc("size"), F.desc("gid")).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("frequent", F.sum("n").over(order)).join(room, ["doc_id", "band"])
    skip = F.col("frequent") <= F.col("room") - F.greatest(F.lit(1), F.ceil(F.col("room") / KEPT_SHARE))
    reach = F.sum("n").over(Window.partitionBy("doc_id", "band"))
    totals = sizes.select("doc_id", F.col("n_shingles").alias("total"))
    summed = summed.withColumn("skip", skip).withColumn("alone", F.col("room") + F.col("most") - reach).join(totals, "doc_id")
    summed = staged(summed, "ranked")
    skipped = summed.filter("skip").groupBy("doc_id", "band").agg(F.max("frequent").alias("skipped"))
    rooms = room.join(skipped, ["doc_id", "band"], "left").withColumn("skipped", F.coalesce("skipped", F.lit(0)))
    return summed.filter("not skip").select(*placed.columns, "alone", "total"), rooms


def _within_reach(placed: DataFrame, room: DataFrame) -> DataFrame:
    """Subsets left after documents that can't link go, all subsets they share with other components being too few.

    A linked pair shares at least the room of either, so each of the two has that many such subsets. This is what keeps
    a large component and the texts that share a passage with it from being paired member by member.
    """
    reach = placed.groupBy("doc_id", "band").agg(F.sum("n").alias("reach")).join(room, ["doc_id", "band"])
    able = reach.filter("reach >= room").select("doc_id", "band")
    kept = staged(placed.join(able, ["doc_id", "band"], "left_semi"), "able")
    mixed = kept.groupBy("gid", "band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    return kept.join(mixed.select("gid", "band"), ["gid", "band"], "left_semi")


def _across(placed: DataFrame, pivots: DataFrame | None = None) -> DataFrame:
    """Pairs of one subset that are in different components, with the number of subsets they share; only those of different ``pivots``, if given.

    Linked sets differ in at most a seventh of their shingles taken together. What a document shares with no other component is such a
    difference, and where every segment is one shingle (there are pivots then), those of both sides add up.
    """
    near = "p <> q and s * 4 >= t * 3 and t * 4 >= s * 3"
    keys, key = ["gid", "band"], ("doc_id", "component", "alone", "total")
    if pivots is not None:
        placed = staged(placed.join(pivots, ["doc_id", "band"]), "led")
        key = (*key, "pivot")
    x = placed.select(*keys, "n", *(F.col(k).alias(v) for k, v in zip(key, ("a", "p", "u", "s", "lower"), strict=False)))
    y = placed.select(*keys, *(F.col(k).alias(v) for k, v in zip(key, ("b", "q", "v", "t", "upper"), strict=False)))
    if pivots is None:
        pairs = x.join(y, keys).filter(f"a < b and {near} and 7 * greatest(u, v) <= s + t")
        return pairs.groupBy("a", "b", "band").agg(F.sum("n").alias("shared"))
    several = placed.groupBy(*keys).agg(F.sort_array(F.collect_set("pivot")).alias("each")).filter("size(each) > 1")
    meets = several.select(*keys, F.explode("each").alias("lower"), "each").select(*keys, "lower", F.explode("each").alias("upper")).filter("lower < upper")
    pairs = x.join(meets, [*keys, "lower"]).join(y, [*keys, "upper"]).filter(f"{near} and 7 * (u + v) <= s + t")
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "band").agg(F.sum("n").alias("shared"))


def _sets(rows: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of rows (doc_id, text) whose ids are distinct and not null."""
    sizes = staged(measure(rows, COARSE), "sizes")
    firsts = sizes.filter("mark is not null").groupBy("mark").agg(F.min("doc_id").alias("set_id"))
    same = staged(sizes.join(firsts, "mark").select("doc_id", "set_id"), "same")
    links, short = resolve(rows, sizes, same, sizes.select("doc_id", F.inline("rooms")), COARSE)
    again = rows.join(same.filter("doc_id = set_id").join(short, "doc_id", "left_semi").select("doc_id"), "doc_id", "left_semi")
    single = staged(measure(again, SINGLE).select("doc_id", F.inline("rooms")), "room")
    more, _ = resolve(again, sizes, same, single, SINGLE, links)
    found = components(reduce(DataFrame.union, [links, more]))
    sets = same.join(found, same.set_id == found.node, "left").select("doc_id", F.coalesce("component", "set_id").alias("component_id"))
    return sizes.join(sets, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included); one row per input row.

    Null text is empty; a text without words has no shingles and links with nothing. Rows repeated under one id are
    documents of their own, each with its text. Rows with a null id link as well; a component of such rows only has a null id.
    """
    rows, repeated = keyed(id_and_text(docs, id_col, text_col), "row")
    found = _sets(rows.select(F.col("row").alias("doc_id"), "text"))
    if not repeated:
        return found
    named = rows.select("row", F.col("doc_id").alias("id"))
    placed = found.join(named, found.doc_id == named.row)
    least = placed.groupBy("component_id").agg(F.min("id").alias("least"))
    return placed.join(least, "component_id").select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every group of near duplicates, that of the smallest id; rows linked with nothing stay.

    A null id comes after all others; of rows with the smallest id any one stays.
    """
    key = free_name(docs, "row")
    rows, repeated = keyed(docs, key)
    found = _sets(id_and_text(rows, key))
    if not repeated:
        drop = found.filter("doc_id <> component_id").select("doc_id")
        return docs.join(drop, "doc_id", "left_anti")
    placed = rows.select(F.col(key), F.col("doc_id").alias("id")).join(found.select(F.col("doc_id").alias(key), "component_id"), key)
    least = F.min_by(key, F.struct(F.col("id").isNull(), "id", key))
    stay = placed.groupBy("component_id").agg(least.alias(key)).select(key)
    return rows.join(stay, key, "left_semi").select(*docs.columns)
