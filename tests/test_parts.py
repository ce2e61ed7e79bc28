"""Large batches are worked through in bounded parts."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import PythonEvalType

from docengine.functions import parts


def test_parts_hold_every_row_once_and_in_order():
    texts = pa.array([None, "", "a" * 5000, *("b" * (k % 90) for k in range(300)), "é" * 700])
    numbers = pa.array([[k, None] if k % 3 else None for k in range(len(texts))], pa.list_(pa.int32()))
    found = list(parts.parts((texts, numbers), 1000))
    assert [t for part in found for t in part[0].to_pylist()] == texts.to_pylist()
    assert [n for part in found for n in part[1].to_pylist()] == numbers.to_pylist()
    assert all(len(part[0]) == 1 or sum(c.nbytes for c in part) <= 1000 for part in found)
    assert [len(part[0]) for part in parts.parts((texts.slice(0, 0),))] == [0]


def test_a_batch_is_not_parsed_as_a_whole(spark):
    @parts.part_udf(T.LongType())
    def rows_at_once(html):
        return pa.array([len(html)] * len(html), pa.int64())

    pages = spark.range(600, numPartitions=1).select(F.repeat(F.lit("<p>text</p>"), 500).alias("html"))
    found = pages.select(rows_at_once("html").alias("n")).agg(F.max("n").alias("most"), F.count("n").alias("rows")).first()
    assert found["rows"] == 600 and found["most"] * 5500 <= parts.PART_BYTES


def test_page_functions_take_parts():
    from docengine.functions import html, page_index

    functions = [html.parse_html, html.html_to_markdown, html.html_to_clean_markdown, html.content_parser(dict)]
    functions += [page_index.ranges_around, page_index.locate, page_index.tree_order]
    assert {f.evalType for f in functions} == {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}
