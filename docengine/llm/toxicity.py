"""Toxic text: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is an n-gram of a lower-cased word with a blank at both ends, hashed to ``2**BITS`` places; a text
has it or not. Of every feature the log ratio of its share among toxic and other training texts is taken;
features near zero are left out, the others enter a logistic regression with that ratio as their value.
The model is fitted on at most ``TRAIN_ROWS`` labelled rows (those with the smallest hash of their id), so
its size and the fit are bounded; every text is scored whole. Features are counted over all tasks; only those that
are not left out reach the one task that fits, some hundredth of all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import SLICE_BYTES, free_name, gather, give_back, id_and_text, keyed, slices, split_words, staged

TRAIN_ROWS = 8_000
BITS = 18
ORDERS = (3, 4, 5, 6)
LEAST_RATIO = 2.0
THRESHOLD = 0.7


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each word, one word after another, and their number."""
    text = " " + " ".join(words).lower() + " "
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blank = chars == 32
    word = np.cumsum(blank) - 1
    marks = np.concatenate([[0], np.cumsum(blank)])
    found, owner = [], []
    for n in ORDERS:
        size = len(chars) - n + 1
        if size <= 0:
            continue
        code = np.full(size, n, np.uint64)
        for k in range(n):
            code = (code ^ chars[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        inner = marks[n - 1 : n - 1 + size] - marks[1 : 1 + size] == 0
        found.append((code[inner] >> np.uint64(64 - BITS)).astype(np.int64))
        owner.append(word[:size][inner])
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    features, owners = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return features[order], np.bincount(owners, minlength=len(words))[: len(words)]


def text_features(texts: pa.Array, active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every distinct pair; ``active`` marks the features of interest."""
    offsets, codes, words = split_words(texts)
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
    pairs = np.unique(rows * max(len(words), 1) + codes)
    rows, codes = np.divmod(pairs, max(len(words), 1))
    features, sizes = word_features(words.to_pylist())
    if active is not None and len(features):
        kept = active[features]
        owners = np.repeat(np.arange(len(sizes)), sizes)[kept]
        features, sizes = features[kept], np.bincount(owners, minlength=len(sizes))
    flat, each = gather(features, np.cumsum(sizes) - sizes, sizes, codes)
    return np.divmod(np.unique((np.repeat(rows, each) << BITS) + flat), 1 << BITS)


def log_count_ratios(toxic: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Log ratio of each feature's share among toxic and other rows, one pseudo-count each; those near zero are zero.

    Both arrays hold the number of rows with each feature, then the number of rows.
    """
    with_it, without = toxic[:-1] + 1.0, other[:-1] + 1.0
    ratios = np.log(with_it / (toxic[-1] + 2.0)) - np.log(without / (other[-1] + 2.0))
    ratios[(with_it + without) < 5] = 0.0
    ratios[np.abs(ratios) < LEAST_RATIO] = 0.0
    return ratios


def fit(rows: np.ndarray, features: np.ndarray, toxic: np.ndarray, ratios: np.ndarray, steps: int = 200, penalty: float = 1e-4) -> np.ndarray:
    """Weight of each feature (ratio times coefficient), then the constant; features have a ratio other than zero.

    With labels of one kind only, the constant alone is fitted.
    """
    n = max(len(toxic), 1)
    rate = (toxic.sum() + 0.5) / (len(toxic) + 1.0)
    weights, constant = np.zeros(1 << BITS), float(np.log(rate / (1 - rate)))
    values, moved, moved_constant = ratios[features] / 4, np.full(1 << BITS, 1e-8), 1e-8
    for _ in range(steps if 0 < toxic.sum() < len(toxic) else 0):
        margin = np.bincount(rows, weights[features] * values, len(toxic)) + constant
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - toxic
        slope = np.bincount(features, error[rows] * values, 1 << BITS) / n + penalty * weights
        moved += slope**2
        weights -= 0.3 * slope / np.sqrt(moved)
        moved_constant += error.mean() ** 2
        constant -= 0.3 * error.mean() / np.sqrt(moved_constant)
    return np.append(weights * ratios / 4, constant)


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", limit: int = TRAIN_ROWS) -> np.ndarray:
    """The model, from at most ``limit`` labelled rows; null labels and ids are left out.

    ``usable`` says, on column ``doc_id``, which labels may be learned from.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    if usable is not None:
        known = known.filter(usable)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(limit)
    sample = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")

    def extract(batches):
        give_back(forget=True)
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES // 4):
                rows, features = text_features(part.column(1))
                ends = np.searchsorted(rows, np.arange(part.num_rows + 1))
                packed = [features[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:1], part.column(2), pa.array(packed, pa.binary())], names=["doc_id", "toxic", "features"])

    def count(batches):
        counts = np.zeros((2, (1 << BITS) + 1), np.int64)
        for batch in batches:
            for label, packed in zip(batch.column("toxic").to_pylist(), batch.column("features"), strict=True):
                counts[label, np.frombuffer(packed.as_buffer(), "<u4")] += 1
                counts[label, -1] += 1
        some = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *map(pa.array, counts[::-1, some])], names=["feature", "toxic", "other"])

    def select(batches):
        for batch in batches:
            found = (np.frombuffer(x.as_buffer(), "<u4") for x in batch.column("features"))
            packed = [x[ratios[x] != 0].tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary())], names=["place", "toxic", "features"])

    def learn(batches):
        found = []
        for batch in batches:
            found += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        found.sort()
        labels_, lists = [x[1] for x in found], [np.frombuffer(x[2], "<u4") for x in found]
        sizes = [len(x) for x in lists]
        features = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
        model = fit(np.repeat(np.arange(len(lists)), sizes), features, np.array(labels_, bool), ratios)
        yield pa.RecordBatch.from_arrays([pa.array([model.astype("<f4").tobytes()], pa.binary())], names=["model"])

    found = staged(sample.mapInArrow(extract, "doc_id long, toxic int, features binary"), "features")
    sums = found.mapInArrow(count, "feature long, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    sums = sums.toArrow()  # a row for each place at most
    counts = np.zeros((2, (1 << BITS) + 1))
    counts[:, sums["feature"].to_numpy()] = sums["toxic"].to_numpy(), sums["other"].to_numpy()
    ratios = log_count_ratios(*counts)
    ordered = found.orderBy("doc_id", "toxic", "features").select(F.monotonically_increasing_id().alias("place"), "toxic", "features")
    few = ordered.mapInArrow(select, "place long, toxic int, features binary").repartition(1)
    learned = few.mapInArrow(learn, "model binary").first()  # none where an empty sample leaves no task
    if learned is None:
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), ratios).astype("<f4")
    return np.frombuffer(learned["model"], "<f4")


def score(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score between 0 and 1; one row per input row. Null text is empty; empty text gets the constant's score."""

    def run(batches):
        give_back(forget=True)
        active = model[:-1] != 0
        for batch in batches:
            for part in slices(batch):
                rows, features = text_features(part.column(1), active)
                margin = np.bincount(rows, model[:-1].astype(np.float64)[features], part.num_rows) + float(model[-1])
                scores = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], names=["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def toxic_scores(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> DataFrame:
    """doc_id, score, predicted (1 from a score of ``THRESHOLD``) of all documents."""
    return score(docs, train(docs, labels, usable)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> DataFrame:
    """``docs`` without the rows whose text is found toxic; rows repeated under one id, or under none, are judged one by one."""
    key = free_name(docs, "row")
    rows, _ = keyed(docs, key)
    rejected = score(rows, train(docs, labels, usable), key).filter(F.col("score") >= THRESHOLD).select(F.col("doc_id").alias(key))
    return rows.join(rejected, key, "left_anti").select(*docs.columns)
