"""A batch against a long history: the batch moves, the history is only scanned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that the key hashes of a batch may take in every task, and what one takes in a hash relation.
FILTER_BYTES, HASH_BYTES = 64 * 1024 * 1024, 32


def touched_history(history: DataFrame, batch: DataFrame, keys: dict[str, str], most_bytes: int = FILTER_BYTES) -> DataFrame:
    """Rows of ``history`` that a join with ``batch`` can meet; ``keys`` maps columns of the history to those of the batch.

    The batch's keys are counted as 64-bit hashes, up to a bound. Within it they travel to every task and the history is
    filtered where it lies; what is left is of the size of the batch, whatever the history's. Hashes may agree by chance,
    so the join itself has still to compare the keys. Beyond the bound the history comes back as it is, for a join that
    shuffles both sides: such a batch is large itself. Rows with a null in a key stay out, as no join meets them.
    """
    limit = max(0, most_bytes // HASH_BYTES)
    mine, theirs = list(keys), list(keys.values())
    whole = lambda names: [F.col(c).cast("string") for c in names]  # types of both sides need not agree
    asked = batch.dropna(subset=theirs).select(F.xxhash64(*whole(theirs)).alias("__h")).distinct()
    if asked.limit(limit + 1).count() > limit:
        return history
    met = history.dropna(subset=mine).withColumn("__h", F.xxhash64(*whole(mine)))
    return met.join(F.broadcast(asked), "__h", "left_semi").drop("__h")
