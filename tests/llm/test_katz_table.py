"""The table between Katz's counting and scoring stays small beside its input."""

from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import prose, table
from pyspark.sql import functions as F

from docengine.llm import katz


def test_the_table_of_counts_is_small(spark, monkeypatch):
    rng = random.Random(3)
    docs = table(spark, [(k, prose(rng, 80)) for k in range(300)] + [(1, "again alpha"), (None, "alpha beta")])
    kept, staged = [], katz.staged
    monkeypatch.setattr(katz, "staged", lambda df, purpose: kept.append(staged(df, purpose)) or kept[-1])
    tokens = katz.katz_scores(docs, F.lit(True)).agg(F.sum("n_tokens")).first()[0]
    columns = [c for c, kind in kept[0].dtypes if kind == "binary"]
    sizes = [df.agg(F.sum(sum(F.octet_length(c) for c in columns))).first()[0] for df in kept]
    assert tokens == 300 * 81 + 6
    assert len(sizes) == katz.PASSES and max(sizes) < 0.7 * sum(sizes) and sum(sizes) < 24 * tokens


@pytest.mark.parametrize("ids", [[5], [0, 1, 300], [katz.NO_ID, -7, 2**62], list(range(0, 70_000, 2))])
def test_packed_ids_and_places(ids):
    ids = np.array(ids, np.int64)
    places = np.random.default_rng(1).integers(0, len(ids), 999)
    assert np.array_equal(katz._unpack_ids(katz._pack_ids(ids)), ids)
    assert np.array_equal(katz._unpack_places(katz._pack_places(places, len(ids)), len(ids)), places)
