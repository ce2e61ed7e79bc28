"""Katz backoff language model of order two over words: counting, normalising and scoring by shuffles.

Every token of every text is one position: its word, the word before it (a start mark at the head of a text)
and its document. Positions travel in packed arrays to buckets by word. A bucket has all positions of its
words, so it counts words and pairs among the training positions and writes to the model's table, one row per bucket, each
distinct pair once with its counts, and the documents of its positions. Good-Turing discounts come from the counts of
counts over all buckets; with them, buckets turn counts into values and add those up by document.

P(w | h) is the discounted share if the pair was seen, else a(h) P(w); P(w) is the discounted share of the word, and
the mass left over belongs to the unknown word. a(h) = (1 - sum of seen P(w | h)) / (1 - sum of their P(w)), so both
levels add up to one exactly. Sums for a(h) and the unseen positions meet in buckets by h, where the
corrections are made. A document's score is the sum of what all buckets say.

Words with a large share of a bounded sample of texts are spread over buckets by the word before (or by the
document); their exact counts are taken beforehand. The list has at most ``MOST_FREQUENT`` words and steers only balance.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import give_back, id_and_text, shuffle_partitions, slices, split_words, staged

CUTOFF = 5  # counts up to this are discounted by Good and Turing's formula
RESERVE = 0.05  # what a larger count gives up, so that every context leaves some mass
MOST_FREQUENT, FREQUENT_SHARE, SAMPLE_DOCS = 1_000, 0.001, 2_000
BUCKETS = 4  # for each shuffle partition, to bound what one group holds
PASSES = 2  # over the texts, each for a part of the buckets, as the shuffled positions are most of what lies on disk
START, END, NO_ID = np.uint64(1), np.uint64(2), -(2**63)
PRIME = np.uint64(0x9E3779B97F4A7C15)
COUNTED = ["own", "pairs", "ends", "before", "pair_counts", "sizes", "owners", "docs"]  # packed arrays, see ``_reduce``


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end mark after each text's words, and the offsets of the texts."""
    offsets, codes, words = split_words(pc.ascii_lower(texts))
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) | 4 for w in words.to_pylist()), np.uint64, len(words))
    shifted = offsets + np.arange(len(offsets))
    stream = np.full(shifted[-1], END, np.uint64)
    at = np.arange(len(codes)) + np.repeat(np.arange(len(texts)), np.diff(offsets))
    stream[at] = known[codes]
    return stream, shifted


def frequent_words(rows: DataFrame) -> tuple[dict[int, int], int, int]:
    """Exact training counts of the frequent words, all training tokens, training texts."""
    chosen = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).distinct()
    sample = rows.join(F.broadcast(chosen), "doc_id", "left_semi")

    def count(batches, wanted=None):
        for batch in batches:
            for part in slices(batch):
                stream, offsets = word_codes(part.column(1))
                train = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                if wanted is not None:
                    stream = stream[np.repeat(train, np.diff(offsets))]
                words, counts = np.unique(stream, return_counts=True)
                if wanted is None:
                    kept = counts >= max(2, FREQUENT_SHARE * len(stream) / 4)
                else:
                    kept = np.isin(words, wanted)
                words = np.append(words[kept], np.uint64(0)).astype(np.int64, casting="unsafe")
                counts = np.append(counts[kept], len(stream))
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(counts)], names=["word", "n"])

    def total(found, limit):
        sums = found.groupBy("word").agg(F.sum("n").alias("n")).orderBy((F.col("word") != 0), F.desc("n"), "word").limit(limit + 1)
        return {int(r["word"]) & (2**64 - 1): int(r["n"]) for r in sums.collect()}

    seen = total(sample.mapInArrow(count, "word long, n long"), MOST_FREQUENT)
    least = FREQUENT_SHARE * seen.get(0, 0)
    wanted = np.array([w for w, n in seen.items() if w and n >= least] + [int(END)], np.uint64)
    sums = total(rows.mapInArrow(lambda b: count(b, wanted), "word long, n long"), len(wanted))
    tokens = sums.pop(0, 0)
    return sums, tokens, sums.get(int(END), 0)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (keys ^ (keys >> np.uint64(32))) * PRIME
    return (((mixed >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def count_positions(rows: DataFrame, frequent: dict[int, int], turn: int) -> DataFrame:
    """The counts of every ``PASSES``-th bucket from ``turn`` on: bucket and packed arrays (see ``_reduce``)."""
    buckets = BUCKETS * shuffle_partitions(rows.sparkSession)
    spread = np.array(sorted(frequent), np.uint64)

    def emit(batches):
        for batch in batches:
            for part in slices(batch):
                stream, offsets = word_codes(part.column(1))
                before = np.concatenate([[START], stream[:-1]])
                before[offsets[:-1]] = START
                owner = np.repeat(np.arange(part.num_rows, dtype=np.uint32), np.diff(offsets))
                docs_ = part.column(0).fill_null(NO_ID).to_numpy().astype("<i8")
                train = part.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
                bucket = _bucket(np.where(np.isin(stream, spread), stream + before * PRIME, stream), buckets)
                mine = np.flatnonzero(bucket % PASSES == turn)
                order = mine[np.lexsort((before[mine], stream[mine], bucket[mine]))]
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(ends)).tolist():
                    mine = order[ends[b] : ends[b + 1]]
                    words, counts = np.unique(stream[mine], return_counts=True)
                    present, place = np.unique(owner[mine], return_inverse=True)
                    place = place.astype("<u2" if len(present) < 65536 else "<u4")
                    row = [b, np.diff(docs_[present], prepend=0), train[present], words, counts.astype("<u4"), before[mine], place]
                    yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32())] + [pa.array([x.tobytes()], pa.binary()) for x in row[1:]], names=names)
            pa.default_memory_pool().release_unused()

    def meet(table):
        result = _reduce(table.column("bucket")[0].as_py(), *_positions(table), frequent)
        give_back()
        return result

    names = ["bucket", "docs", "train", "words", "counts", "before", "owner"]
    packed = rows.mapInArrow(emit, "bucket int, docs binary, train binary, words binary, counts binary, before binary, owner binary")
    return packed.groupBy("bucket").applyInArrow(meet, f"bucket int, {', '.join(f'{c} binary' for c in COUNTED)}, tallies array<long>")


def _positions(table: pa.Table) -> list[np.ndarray]:
    """All positions of a bucket's packed arrays: word, word before, place of the document among ids, training; then the ids.

    The arrays are filled one packed row after another, as a second copy of each would be most of what a task holds.
    """
    view = lambda x, t: np.frombuffer(x.as_buffer(), t)
    ids, row = np.unique(np.concatenate([np.cumsum(view(x, "<i8")) for x in table["docs"]]), return_inverse=True)
    n = sum(len(x.as_buffer()) // 8 for x in table["before"])
    words, before, doc, train = np.empty(n, np.uint64), np.empty(n, np.uint64), np.empty(n, np.int32), np.empty(n, np.uint8)
    start = first = 0
    for of_docs, word, counts, previous, owner in zip(*(table[c] for c in ("train", "words", "counts", "before", "owner")), strict=True):
        previous, of_docs = view(previous, "<u8"), view(of_docs, np.uint8)
        here = slice(start, start + len(previous))
        owner = view(owner, "<u2" if len(owner.as_buffer()) == 2 * len(previous) else "<u4")
        words[here], before[here] = np.repeat(view(word, "<u8"), view(counts, "<u4")), previous
        doc[here], train[here] = row[first : first + len(of_docs)][owner], of_docs[owner]
        start, first = here.stop, first + len(of_docs)
    order = np.lexsort((before, words))
    arrays = [words, before, doc, train]
    del words, before, doc, train
    for k in range(len(arrays)):
        arrays[k] = arrays[k][order]
    return [*arrays, ids]


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ascending distinct ids: the first, the bytes of a step, the steps."""
    steps = np.diff(ids.view(np.uint64))
    kind = np.min_scalar_type(int(steps.max(initial=0)))
    return ids[:1].astype("<i8").tobytes() + bytes([kind.itemsize]) + steps.astype(kind.newbyteorder("<")).tobytes()


def _unpack_ids(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, f"<u{packed[8]}", offset=9).astype(np.uint64)
    return np.cumsum(np.append(np.frombuffer(packed, "<u8", 1), steps)).view(np.int64)


def _pack_places(places: np.ndarray, n: int) -> bytes:
    """Places below ``n``, each in as few bytes as ``n`` needs."""
    return places.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : max(1, (n.bit_length() + 7) // 8)].tobytes()


def _unpack_places(packed: bytes, n: int) -> np.ndarray:
    width = max(1, (n.bit_length() + 7) // 8)
    wide = np.zeros((len(packed) // width, 4), np.uint8)
    wide[:, :width] = np.frombuffer(packed, np.uint8).reshape(-1, width)
    return wide.view("<u4").ravel()


def _reduce(bucket, words, before, doc, train, ids, frequent) -> pa.Table:
    """Counts of one bucket, from its positions by word and word before.

    Of each distinct word: ``own`` (its training count), ``pairs`` (how many of the pairs that follow are its), ``ends`` (whether
    it is the end mark). Of each distinct pair: ``before`` (the word before), ``pair_counts`` (its training count), ``sizes`` (how
    many of the positions are its). Of each position: ``owners``, the place of its document among ``docs``. tallies: distinct
    words, counts of counts of words, then of pairs.
    """
    new_word = np.concatenate([[True], words[1:] != words[:-1]])
    new_pair = new_word | np.concatenate([[True], before[1:] != before[:-1]])
    word_at, pair_at = np.flatnonzero(new_word), np.flatnonzero(new_pair)
    own = np.add.reduceat(train, word_at, dtype=np.int64)
    spread = np.array([frequent.get(int(w), -1) for w in words[word_at].tolist()] if frequent else np.full(len(word_at), -1), np.int64)
    own = np.where(spread >= 0, spread, own)
    pair_counts = np.add.reduceat(train, pair_at, dtype=np.int64)
    local = own[(spread < 0) & (own > 0)]
    tallies = [len(local), *np.bincount(np.minimum(local, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2].tolist()]
    tallies += np.bincount(np.minimum(pair_counts, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2].tolist()
    pairs, sizes = np.diff(np.append(np.flatnonzero(new_word[pair_at]), len(pair_at))), np.diff(np.append(pair_at, len(words)))
    data = [own.astype("<u8"), pairs.astype("<u4"), words[word_at] == END, before[pair_at].astype("<u8"), pair_counts.astype("<u4"), sizes.astype("<u4")]
    data = [*(x.tobytes() for x in data), _pack_places(doc, len(ids)), _pack_ids(ids)]
    columns = [pa.array([bucket], pa.int32()), *(pa.array([x], pa.binary()) for x in data), pa.array([tallies], pa.list_(pa.int64()))]
    return pa.table(columns, names=["bucket", *COUNTED, "tallies"])


def _counted(batches):
    """Of each bucket, the word's count, whether it is the end mark, the word before, the count and the number of positions of
    each distinct pair; the place of each position's document; the documents."""
    for batch in batches:
        for row in range(batch.num_rows):
            packed = [batch.column(c)[row].as_buffer() for c in COUNTED]
            own, pairs, ends, before, counts, sizes = (np.frombuffer(x, t) for x, t in zip(packed, ("<i8", "<u4", "?", "<u8", "<u4", "<u4"), strict=False))
            ids = _unpack_ids(packed[7].to_pybytes())
            yield np.repeat(own, pairs), np.repeat(ends, pairs), before, counts.astype(np.int64), sizes, _unpack_places(packed[6], len(ids)), ids


def discounted(of: list[int]) -> list[float]:
    """What counts 0 to ``CUTOFF`` are worth, from the counts of counts 1 to ``CUTOFF`` + 1.

    Good and Turing's formula where it gives more than nothing and less than the count; else a constant is taken off.
    """
    constant = of[0] / (of[0] + 2 * of[1]) if of[0] and of[1] else 0.5
    common = (CUTOFF + 1) * of[CUTOFF] / of[0] if of[0] else 1.0
    worth = [0.0]
    for r in range(1, CUTOFF + 1):
        turing = (r + 1) * of[r] / of[r - 1] if of[r - 1] else 0.0
        value = r * (turing / r - common) / (1 - common) if common < 1 else 0.0
        worth.append(value if 0 < value < r else r - constant)
    return worth


class Model:
    """Totals and discounts; small, and all that tasks need besides the tables."""

    def __init__(self, tallies: list[int], frequent: dict[int, int], tokens: int, texts: int):
        seen = [c for c in frequent.values() if c > 0]
        self.tokens, self.texts, self.words = tokens, texts, tallies[0] + len(seen)
        of_words = [tallies[r] + seen.count(r) for r in range(1, CUTOFF + 2)]
        self.word_worth, self.pair_worth = discounted(of_words), discounted(tallies[CUTOFF + 2 :])
        large = self.words - sum(of_words[:CUTOFF])
        given = sum(n * (r - self.word_worth[r]) for r, n in enumerate(of_words[:CUTOFF], 1)) + RESERVE * large
        # The unknown word gets what the words give up; an empty corpus leaves it everything.
        self.unknown = given / tokens if tokens else 1.0
        self.word_worth[0] = self.unknown * max(tokens, 1)

    def of_words(self, counts: np.ndarray) -> np.ndarray:
        """Probability of words by their count."""
        return np.where(counts <= CUTOFF, np.array(self.word_worth)[np.minimum(counts, CUTOFF)], counts - RESERVE) / max(self.tokens, 1)

    def of_pairs(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts <= CUTOFF, np.array(self.pair_worth)[np.minimum(counts, CUTOFF)], counts - RESERVE)

    def values(self, own: np.ndarray, ends: np.ndarray, before: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Base score and score of a position with each pair, the score before corrections by context."""
        log_sum = lambda worth, c: np.where(c > CUTOFF, np.log10(np.maximum(c, 1) - RESERVE), np.log10(np.maximum(worth, 1e-300))[np.minimum(c, CUTOFF)])
        score = np.where(counts > 0, log_sum(self.pair_worth, counts), log_sum(self.word_worth, own) - math.log10(max(self.tokens, 1)))
        score -= np.where((own > 0) & ~ends, np.log10(np.maximum(own, 1)), 0.0)
        if self.texts:
            score -= np.where(before == START, math.log10(self.texts), 0.0)
        return np.log10(own + 1.0) - math.log10(self.tokens + self.words + 1), score


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.stack([np.bincount(at, v, len(found)) for v in values.T], 1) if len(found) else np.zeros((0, values.shape[1]))


def document_sums(counted: DataFrame, model: Model) -> DataFrame:
    """doc_id and what the word buckets say about its tokens and scores."""

    def run(batches):
        for own, ends, before, counts, sizes, doc, ids in _counted(batches):
            known = np.bincount(doc, np.repeat(own > 0, sizes), len(ids))
            sums = [np.bincount(doc, np.repeat(x, sizes), len(ids)) for x in model.values(own, ends, before, counts)]
            columns = [ids, np.bincount(doc, minlength=len(ids)).astype(float), known, *sums]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
        give_back()

    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    return counted.select(*COUNTED).mapInArrow(run, "doc_id long, n_tokens double, n_known double, base_score double, score double")


def corrections(counted: DataFrame, model: Model, frequent: dict[int, int]) -> DataFrame:
    """doc_id and the context part of its unseen positions: log c(h) + log a(h), where h was seen in training.

    Unseen positions after frequent words are dealt out by document; the sums for those words go to all parts.
    """
    buckets = shuffle_partitions(counted.sparkSession)
    parts = min(buckets, 32)
    spread = np.array(sorted({*frequent, int(START)}), np.uint64)

    def emit(batches):
        for own, _, before, counts, sizes, doc, ids in _counted(batches):
            seen = counts > 0
            given = np.stack([counts[seen], model.of_pairs(counts[seen]), model.of_words(own[seen])], 1)
            keys, sums = _sums(before[seen], given)
            docs, before = ids[doc[np.repeat(~seen, sizes)]], np.repeat(before[~seen], sizes[~seen])
            wide = np.isin(keys, spread)
            keys = np.concatenate([keys[~wide], np.tile(keys[wide], parts)])
            sums = np.concatenate([sums[~wide], np.tile(sums[wide], (parts, 1))])
            salt = np.concatenate([np.zeros(int((~wide).sum()), np.uint64), np.repeat(np.arange(parts, dtype=np.uint64), int(wide.sum()))])
            theirs = np.where(np.isin(before, spread), docs.astype(np.uint64) % np.uint64(parts), np.uint64(0))
            to, asks = _bucket(keys + salt * PRIME, buckets), _bucket(before + theirs * PRIME, buckets)
            for b in np.union1d(np.unique(to), np.unique(asks)).tolist():
                mine, own = to == b, asks == b
                data = [keys[mine].tobytes(), salt[mine].tobytes(), sums[mine].tobytes(), before[own].tobytes(), theirs[own].tobytes(), docs[own].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32())] + [pa.array([x], pa.binary()) for x in data], names=names)

    def meet(table):
        columns = {n: table.column(n).to_pylist() for n in names[1:]}
        read = lambda n, t: np.concatenate([np.frombuffer(x, t) for x in columns[n]])
        keys = read("keys", "<u8") + read("salt", "<u8") * PRIME
        known, sums = _sums(keys, read("sums", "<f8").reshape(-1, 3))
        asked, docs = read("before", "<u8") + read("theirs", "<u8") * PRIME, read("docs", "<i8")
        at = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
        hit = known[at] == asked if len(known) else np.zeros(len(asked), bool)
        total, seen, lower = sums[at[hit]].T if len(known) else np.zeros((3, 0))
        # log c(h) + log((1 - seen / c(h)) / (1 - lower)): the mass the context gives up over what it is shared by.
        value = np.log10(total - seen) - np.log10(1 - lower)
        return pa.table([pa.array(docs[hit]), pa.array(value)], names=["doc_id", "score"])

    names = ["bucket", "keys", "salt", "sums", "before", "theirs", "docs"]
    packed = counted.select(*COUNTED).mapInArrow(emit, "bucket int, keys binary, salt binary, sums binary, before binary, theirs binary, docs binary")
    return packed.groupBy("bucket").applyInArrow(meet, "doc_id long, score double")


def katz_scores(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score; one row per document.

    ``training`` says, on column doc_id, which rows are learned from. A null or empty text is its end mark alone. Rows repeated
    under one id (or a null one) are scored as a sequence of texts: their tokens and scores add up. Without
    training texts every word is unknown and has probability one.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("train", F.coalesce(training, F.lit(False)))
    frequent, tokens, texts = frequent_words(rows)
    counted = reduce(DataFrame.union, [staged(count_positions(rows, frequent, turn), "pair-counts") for turn in range(PASSES)])
    tallies = counted.select(F.posexplode("tallies").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()
    model = Model([n for _, n in sorted((r["k"], r["n"]) for r in tallies)] or [0] * (2 * CUTOFF + 3), frequent, tokens, texts)
    none = F.lit(0.0)
    more = corrections(counted, model, frequent).select("doc_id", none.alias("n_tokens"), none.alias("n_known"), none.alias("base_score"), "score")
    sums = document_sums(counted, model).union(more).groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return sums.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), F.col("n_tokens").cast("long"), F.col("n_known").cast("long"),
        F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
