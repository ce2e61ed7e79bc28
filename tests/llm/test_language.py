"""Language by compression: held-out accuracy, choices against a plain restatement, awkward rows."""

import os

import numpy as np
import pyarrow as pa
import pytest
from helpers import SCHEMA, awkward, table
from pyspark.sql import functions as F

from docengine.llm import language, queries
from docengine.llm.common import bucket_of_id

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_held_out_documents_get_their_language(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    found = queries.QUERIES["op11_language"](spark, FOLDER).join(docs, "doc_id").collect()
    assert len(found) == docs.count()
    long = [r for r in found if r["held_out"] and r["n"] >= 100]
    assert len(long) > 150
    assert sum(r["lang_pred"] == r["lang"] for r in long) >= 0.97 * len(long)
    assert sum(r["lang_pred"] == r["lang"] for r in long if r["reliable"]) >= 0.97 * sum(r["reliable"] for r in long)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_choice_is_the_least_sum_over_all_blocks(spark):
    model = {"a": b"the and of with that from this " * 9, "b": b"der die und von mit nicht auch " * 9, "c": b"que los las por una para con " * 9}
    texts = ["the and that", "Der UND die!", "por una los 12 que", "x" * 50_000 + " nicht auch", "the der", "ΔΩ 日本"]
    found = language.identify(table(spark, list(enumerate(texts))), model).collect()
    squeezers = language.compressors(list(model.values()))
    for r, text in zip(sorted(found), language.letters(pa.array(texts)).to_pylist(), strict=True):
        body = text.encode()
        sizes = [sum(len(c.compress(body[k : k + language.BLOCK_BYTES])) for k in range(0, len(body), language.BLOCK_BYTES)) for c in squeezers]
        assert r["best"] == "abc"[sizes.index(min(sizes))]
        assert r["score"] == pytest.approx(1 / sum(np.exp((min(sizes) - s) / language.BYTES_PER_E) for s in sizes))
        least, following = sorted(sizes)[:2]
        assert r["margin"] == pytest.approx((following - least) / following)
        assert r["lang"] == (r["best"] if r["margin"] >= language.LEAST_MARGIN else "und")


def test_texts_without_letters_and_tables_without_labels(spark):
    texts = [(0, None), (1, ""), (2, " 12 .,; \t"), (3, "abc"), (3, "abc"), (None, "abc"), (None, None)]
    found = language.identify(table(spark, texts), {"en": b"abc def ghi"}).collect()
    assert sorted((r["best"], r["score"]) for r in found) == [("en", 1.0)] * 3 + [("und", 0.0)] * 4
    nothing = language.train(spark.createDataFrame([], SCHEMA))
    assert nothing == {} and language.identify(spark.createDataFrame([], SCHEMA), nothing).count() == 0
    assert {r["best"] for r in language.identify(table(spark, texts), nothing).collect()} == {"und"}


def test_training_is_bounded_and_keeps_to_usable_rows(spark):
    docs = spark.range(2000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "xx").when(F.col("id") % 3 == 1, "yy").alias("lang"),
        F.concat(F.when(bucket_of_id("id", 4) == 2, F.lit("hidden ")).otherwise("open "), F.repeat(F.lit("wort "), 500)).alias("text"),
    )
    model = language.train(docs, bucket_of_id("doc_id", 4) != 2, pieces=20)
    assert sorted(model) == ["xx", "yy"]
    assert all(b"hidden" not in d and len(d) <= 20 * (language.PIECE_CHARS + 1) for d in model.values())
    twice = language.train(table(spark, awkward() + awkward()))
    assert set(twice) == {"en"}
