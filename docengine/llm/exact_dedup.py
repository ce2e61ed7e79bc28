"""Exact duplicates by a tree merge of sorted digest runs. DataFrame functions only.

Rows are dealt to runs by id. Each run is reduced to one sorted entry per text (digest, best id,
count); then runs meet ``FAN_IN`` at a time in rounds, and equal digests of one meeting merge into one
entry that keeps the best id. Entries are told apart by SHA-256, a second fingerprint and the length, so
every merge is verified. The winners go back down the same tree: at no level does a key hold more than
``FAN_IN`` rows, and the lowest level holds only one run's rows, whatever share of all rows one text has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import free_name, id_and_text, shuffle_partitions, staged

FAN_IN = 16
KEY = ["sha", "mark", "size"]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                normalise=lambda text: text) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row per input row.

    Null text counts as empty, and all empty texts are one group. A null id ranks below every other.
    Rows repeated under one id are members like any other and exactly one of them is kept.
    An empty table gives no rows; other columns are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep}")
    best = F.min if keep == "smallest" else F.max
    rounds = 1
    while FAN_IN**rounds < shuffle_partitions(docs.sparkSession):
        rounds += 1
    text = normalise(F.col("text"))
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id", F.unhex(F.sha2(text, 256)).alias("sha"), F.xxhash64(text).alias("mark"), F.octet_length(text).alias("size"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = staged(rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "row"), F.lit(FAN_IN**rounds))), "digests")
    levels = [_merged(rows.withColumn("best", F.struct("doc_id", "row")), F.col("run"), best, F.count(F.lit(1)))]
    for _ in range(rounds):
        levels.append(_merged(levels[-1], F.floor(F.col("run") / FAN_IN), best, F.sum("members")))
    won = levels.pop().select("run", *KEY, F.col("best").alias("keep"), F.col("members").alias("group_size"))
    for level in reversed(levels):
        below = level.select(F.col("run").alias("child"), F.floor(F.col("run") / FAN_IN).alias("run"), *KEY)
        won = below.join(won, ["run", *KEY]).select(F.col("child").alias("run"), *KEY, "keep", "group_size")
    return rows.join(won, ["run", *KEY]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _merged(entries: DataFrame, run: Column, best, members: Column) -> DataFrame:
    """Runs that meet, merged: one entry per text, sorted within each run."""
    merged = entries.withColumn("run", run.cast("long")).groupBy("run", *KEY).agg(best("best").alias("best"), members.alias("members"))
    return merged.sortWithinPartitions("run", *KEY)


def kept_documents(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """``docs`` with one row of each text, that of the best id. Of rows that repeat an id and its text any one stays."""
    kept = exact_dedup(docs, keep=keep).filter("kept")
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        stay = kept.select("doc_id")
        return docs.join(stay, docs["doc_id"].eqNullSafe(stay["doc_id"]), "left_semi")
    sha = free_name(docs, "sha")
    marked = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["doc_id", sha])
    stay = kept.select("doc_id", F.col("text_sha256").alias(sha))
    return marked.join(stay, marked["doc_id"].eqNullSafe(stay["doc_id"]) & (marked[sha] == stay[sha]), "left_semi").select(*docs.columns)
