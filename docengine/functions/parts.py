"""Arrow functions that take a batch a small part at a time.

Spark fills a batch up to the session's limits (10,000 rows or 64 MB unless set), and a parsed page is some twenty times its
HTML; so the objects of a whole batch would take gigabytes of each worker. Parts keep that the same at any size of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART_BYTES = 1 << 18


def parts(columns: tuple[pa.Array, ...], most: int = PART_BYTES) -> Iterator[tuple[pa.Array, ...]]:
    """The rows of a batch in order, in runs of at most so many bytes; a larger row is a part of its own."""
    rows = len(columns[0])
    if rows <= 1 or sum(c.nbytes for c in columns) <= most:
        yield columns
    else:
        half = rows // 2
        yield from parts(tuple(c.slice(0, half) for c in columns), most)
        yield from parts(tuple(c.slice(half) for c in columns), most)


def part_udf(returns: T.DataType) -> Callable:
    """A scalar Arrow function of one or more columns, called for each part of a batch."""

    def made(function: Callable[..., pa.Array]):
        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for batch in batches:
                for part in parts(batch if isinstance(batch, tuple) else (batch,)):
                    yield function(*part)

        run.__name__, run.__doc__ = function.__name__, function.__doc__
        return F.arrow_udf(run, returns)

    return made
