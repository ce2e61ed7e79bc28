"""The pipeline against plain restatements of its stages, on the smallest tables and on awkward rows."""

import os
import random

import public_tokenizers
import pytest
from helpers import SCHEMA, linked_components, prose, table
from tokenizers import Tokenizer

from docengine.llm import decontamination as D

pipeline = pytest.importorskip("corpus_pipeline")
FOLDER = "/root/testdata/sf0.001"


def leaking(text, items):
    body = D.normal(text)
    for item in items:
        if item and (item in body if len(item) < D.SHORT else D.best_fit(item, body)[0] <= D.most_edits(len(item))):
            return True
    return False


def after_toxicity(rows, items):
    """Ids and texts that the stages after the first keep, of (id, text) rows with distinct ids."""
    first = {}
    for i, t in sorted(rows.items()):
        first.setdefault(t or "", i)
    left = {i: rows[i] for i in first.values()}
    groups = linked_components(left)
    return {i: t for i, t in left.items() if groups[i] == i and not leaking(t, items)}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_whole_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [D.normal(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    accepted = pipeline.toxicity_filter(spark, docs, FOLDER)
    assert accepted.columns == docs.columns
    kept = after_toxicity({r["doc_id"]: r["text"] for r in accepted.collect()}, items)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = pipeline.run(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(kept)
    for r in found:
        assert r["n_tokens"] == len(library.encode(kept[r["doc_id"]] or "", add_special_tokens=False).ids)


def test_awkward_rows(spark, tmp_path):
    """Repeated and null ids, null and empty texts, extra columns; no labels, so nothing is toxic."""
    rng = random.Random(12)
    a, b, c, item = (prose(rng, 50) for _ in range(4))
    rows = [(5, a), (5, a), (6, a), (7, a + " end"), (None, b), (None, b), (8, b), (9, c), (9, f"{c[:90]} {item} {c[90:]}"),
            (10, None), (11, ""), (None, None), (12, item.upper()), (13, "x" * 3000)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    items = spark.createDataFrame([(1, item), (2, None), (None, a), (3, "")], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.schema.names == table(spark, rows).schema.names
    # Of equal texts the row with a null id, which ranks below every other; of near copies the smallest id.
    left = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=str)
    assert left == sorted([(5, a), (None, b), (9, c), (None, ""), (13, "x" * 3000)], key=str)
    coded = pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert coded.count() == 5


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
