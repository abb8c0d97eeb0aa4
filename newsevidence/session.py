"""Session options the engine relies on, and where it may keep shared state."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Options that change results (time zone) or protect large shuffles (AQE).
OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "newsevidence", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**OPTIONS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_options(spark: SparkSession) -> SparkSession:
    """Set the result-relevant runtime options on a session made elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


#: Bytes of one batch that goes to Python or comes back where rows are wide; both sides hold several copies of a batch.
BATCH_BYTES = 8 * 1024 * 1024


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written inside sends rows to Python by at most BATCH_BYTES at a time; the session's own limit holds again afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


# Folders of local sessions without a configured one, by application; removed when Python ends.
_LOCAL: dict[str, tempfile.TemporaryDirectory] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local session without one, as in tests, gets one temporary folder; a cluster without one is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder every executor can reach")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.TemporaryDirectory(prefix="newsevidence-", ignore_cleanup_errors=True)
    return _LOCAL[context.applicationId].name
