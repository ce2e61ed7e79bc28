"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "docengine", master: str | None = None, shuffle: int | None = None) -> SparkSession:
    """A session with the settings the operators expect.

    ``shuffle`` is for local runs only: on a cluster leave it unset and let AQE
    coalesce from a generous initial partition number.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.parquet.filterPushdown", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        # A parsed page is some twenty times its HTML.
        .config("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
        # Call sites are not recorded for each column expression; large ones build faster.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle))
    return builder.getOrCreate()


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name for tables and stream checkpoints of one run.

    It lies in the folder the cluster names in ``spark.checkpoint.dir``; only a
    local session without that setting (tests) falls back to a temporary one, as
    machines of a cluster don't see each other's.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master or 'the cluster'} share")
        shared = tempfile.mkdtemp(prefix="docengine-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return os.path.join(shared, f"{purpose}-{uuid.uuid4().hex}")
