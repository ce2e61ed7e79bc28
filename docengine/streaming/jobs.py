"""Incremental forms: they read what is new, and stop when nothing is.

What a stream has to remember between batches is in its state store, by key; no batch reads what earlier ones wrote.
Batches go to a folder named after the batch number and replace it, or to a versioned table that remembers the number, so a
batch that is run again after a failure leaves no second copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from docengine.operators.logs import route_levels
from docengine.operators.resume import publish_paths, publish_texts
from docengine.operators.summaries import outcome_tally
from docengine.sources.versioned import VersionedTable

BATCH = "batch"


def _start(stream: DataFrame, write, checkpoint: str, mode: str = "append") -> StreamingQuery:
    started = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return started.trigger(availableNow=True).start()


def first_seen(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Of every key the row with the least ``pos`` of the first batch that has the key; a null position comes last.

    The state store holds the keys seen and nothing else. A key's rows come in bounded pieces, of which one row is kept.
    """

    def choose(_key, pieces, state):
        best = None
        for piece in pieces:
            if not state.exists and len(piece):
                ordered = piece.sort_values(pos, kind="stable", na_position="last").head(1)
                if best is None or ordered[pos].iloc[0] < best[pos].iloc[0] or best[pos].isna().iloc[0]:
                    best = ordered
        if best is not None:
            state.update((True,))
            yield best

    return rows.groupBy(key).applyInPandasWithState(choose, rows.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def incremental_publish(content: DataFrame, out: str, checkpoint: str, base: str = "output", pos: str = "pos", render=None) -> StreamingQuery:
    """Publish new content once per output path.

    Within a batch the first row of a path wins; across batches, the one that is
    already published. ``render`` makes the Markdown of the rows that are published, as in ``publish_markdown``.
    """
    columns = ["output_path", "header", "menu", "text", "markdown", "sha256"]

    def write(batch: DataFrame, number: int) -> None:
        publish_texts(render(batch) if render else batch).select(*columns).write.mode("overwrite").parquet(f"{out}/{BATCH}={number}")

    return _start(first_seen(publish_paths(content, base), "output_path", pos), write, checkpoint)


def stream_log_routing(records: DataFrame, out: str, checkpoint: str, level: str = "level") -> StreamingQuery:
    """Send records to the outputs their level reaches."""

    def write(batch: DataFrame, number: int) -> None:
        routed = route_levels(batch, level)
        routed.write.mode("overwrite").partitionBy("sink").parquet(f"{out}/{BATCH}={number}")

    return _start(records, write, checkpoint)


def running_tally(runs: DataFrame, succeeded: Column, failed: Column, keys: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Outcome counts so far in a versioned table; ``tally_so_far`` reads it.

    The totals live in the state store. A batch writes the keys it changed and then commits them, so a reader during a batch sees
    the table before it.
    """
    tally = outcome_tally(runs, succeeded, failed, keys)
    table = _tally_of(runs, out, keys)

    def write(batch: DataFrame, number: int) -> None:
        table.add(batch, replaces=True, mark=number)

    return _start(tally, write, checkpoint, "update")


def tally_so_far(runs: DataFrame, out: str, keys: list[str]) -> DataFrame | None:
    """The committed counts of ``running_tally``; ``runs`` gives the types of the keys."""
    return _tally_of(runs, out, keys).read()


def _tally_of(runs: DataFrame, out: str, keys: list[str]) -> VersionedTable:
    columns = [*(f"{k} {runs.schema[k].dataType.simpleString()}" for k in keys), "processed long", "failed long", "skipped long"]
    return VersionedTable(runs.sparkSession, out, ", ".join(columns), keys)
