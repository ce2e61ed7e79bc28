"""What single tasks hold: few features reach the toxicity fit, workers let go of what they keep; the results stay."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import prose, table

from docengine.llm import common, toxicity


@pytest.fixture
def labelled(spark):
    rng = random.Random(8)
    rows = [(k // 2, prose(rng, 60) + (f" stupid moron{k % 3} " if k // 2 % 4 == 0 else " ") + prose(rng, 30), int(k // 2 % 4 == 0)) for k in range(120)]
    docs = table(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, x) for i, _, x in rows[::2]], "doc_id long, toxic int")
    return rows, docs, labels


def plain_ratios(rows):
    """Features of each row (by id, then features), its label, and the log ratio of each feature."""
    found = [(i, x, np.unique(toxicity.text_features(pa.array([t]))[1]).astype("<u4")) for i, t, x in rows]
    found.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
    toxic = np.array([x for _, x, _ in found], bool)
    with_it, without = np.ones(1 << toxicity.BITS), np.ones(1 << toxicity.BITS)
    for _, x, features in found:
        (with_it if x else without)[features] += 1
    ratios = np.log(with_it / (toxic.sum() + 2.0)) - np.log(without / ((~toxic).sum() + 2.0))
    ratios[(with_it + without < 5) | (np.abs(ratios) < toxicity.LEAST_RATIO)] = 0
    return [x[2] for x in found], toxic, ratios


def test_few_features_reach_the_fit(labelled, monkeypatch):
    rows, docs, labels = labelled
    lists, _, ratios = plain_ratios(rows)
    monkeypatch.setattr(toxicity, "fit", lambda rows, features, *rest: np.array([len(rows), len(features)], float))
    wanted = sum(int((ratios[x] != 0).sum()) for x in lists)
    assert 0 < 10 * wanted < sum(map(len, lists))
    assert toxicity.train(docs, labels).tolist() == [wanted, wanted]


def test_the_model_is_that_of_all_features(labelled):
    rows, docs, labels = labelled
    lists, toxic, ratios = plain_ratios(rows)
    kept = [x[ratios[x] != 0].astype(np.int64) for x in lists]
    model = toxicity.fit(np.repeat(np.arange(len(kept)), [len(x) for x in kept]), np.concatenate(kept), toxic, ratios)
    assert np.array_equal(toxicity.train(docs, labels), model.astype("<f4"))
    assert np.count_nonzero(model[:-1]) > 0


def test_kept_objects_can_be_let_go():
    common.kept_in_worker(("test", 1), lambda: [1])
    common.give_back()
    assert common.kept_in_worker(("test", 1), lambda: [2]) == [1]
    common.give_back(forget=True)
    assert common.kept_in_worker(("test", 1), lambda: [3]) == [3]
