"""Keyed building blocks: first row per key, joins that survive hot keys, ranks, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank

Keys = Sequence[str]
SALTS = 16


def top_per_key(df: DataFrame, keys: Keys, order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key.

    The rank filter becomes a group limit that runs before the shuffle, so a hot key sends at
    most ``k`` rows per map task.
    """
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    name = rank or "_rank"
    out = df.withColumn(name, rn).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def keep_first(df: DataFrame, keys: Keys, order: Sequence[Column]) -> DataFrame:
    """First row per key in a stated order, unlike ``dropDuplicates``."""
    return top_per_key(df, keys, order, 1)


def latest(df: DataFrame, keys: Keys, by: Sequence[str]) -> DataFrame:
    """Newest row per key, ties decided by the later columns of ``by``."""
    return top_per_key(df, keys, [F.desc(c) for c in by], 1)


def salted_join(big: DataFrame, unique: DataFrame, keys: Keys, spread: Keys, how: str = "left",
                salts: int = SALTS) -> DataFrame:
    """Join ``big`` with a side that holds one row per key, spreading hot keys over ``salts`` tasks.

    Wanted where an aggregation on the same keys follows: adaptive execution does not split a
    skewed join there. The salt is a hash of ``spread`` columns, so a retried task gets the same one.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(copies, [*keys, "_salt"], how).drop("_salt")


RANK_BUCKET = 65_536


def volume_rank(df: DataFrame, volume: str, id_col: str, out: str = "rank") -> DataFrame:
    """1-based rank of all rows by ``volume`` descending, then ``id_col``.

    No window runs over the whole table. Rows are numbered inside (volume, id bucket) cells of at
    most ``RANK_BUCKET`` ids; cell offsets come from a window per volume. Only the table of distinct
    volumes is ordered as a whole: n different counts need n * n / 2 counted rows, which bounds it.
    """
    celled = df.withColumn("_cell", F.floor(F.col(id_col) / RANK_BUCKET))
    cells = celled.groupBy(volume, "_cell").agg(F.count("*").alias("_n"))
    preceding = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    below = lambda w: F.coalesce(F.sum("_n").over(preceding(w)), F.lit(0))
    volumes = cells.groupBy(volume).agg(F.sum("_n").alias("_n"))
    volumes = volumes.select(volume, below(Window.orderBy(F.desc(volume))).alias("_above"))
    cells = cells.select(volume, "_cell", below(Window.partitionBy(volume).orderBy("_cell")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(volume, "_cell").orderBy(id_col))
    ranked = celled.withColumn("_in", inside).join(cells, [volume, "_cell"]).join(volumes, volume)
    return ranked.withColumn(out, F.col("_above") + F.col("_before") + F.col("_in")).drop(
        "_cell", "_in", "_before", "_above"
    )


POLICIES = ("replace", "insert", "fill")


def upsert(current: DataFrame, changes: DataFrame, keys: Keys, policy: str = "replace", *,
           now: Column | None = None, action: str | None = None) -> DataFrame:
    """New snapshot of ``current`` after ``changes``; both hold one row per key.

    ``replace`` lets the change win in its columns, ``insert`` adds absent keys only, ``fill`` sets
    columns that are blank in ``current``. Rows that change get ``updated_at = now`` and
    ``version + 1`` where the table has those columns; new rows get both timestamps and version 0.
    With ``action`` the result also says 'inserted', 'updated' or 'kept'.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    auto = {"created_at", "updated_at", "version"}
    cols = current.columns
    given = [c for c in changes.columns if c not in keys and c in cols and c not in auto]
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in given], F.lit(True).alias("_in"))
    old = current.withColumn("_had", F.lit(True))
    joined = old.join(new, list(keys), "full_outer")
    had, has = F.col("_had").isNotNull(), F.col("_in").isNotNull()

    def merged(c: str) -> Column:
        if policy == "replace":
            return F.when(has, F.col(f"_new_{c}")).otherwise(F.col(c))
        if policy == "insert":
            return F.when(had, F.col(c)).otherwise(F.col(f"_new_{c}"))
        blank = F.col(c).isNull()
        if dict(current.dtypes)[c] == "string":
            blank = is_blank(c)
        return F.when(blank, F.coalesce(F.col(f"_new_{c}"), F.col(c))).otherwise(F.col(c))

    differs = F.lit(False)
    for c in given:
        differs = differs | ~merged(c).eqNullSafe(F.col(c))
    changed = had & has & differs
    stamp = F.current_timestamp() if now is None else now
    exprs = []
    for c in cols:
        if c in keys:
            exprs.append(F.col(c))
        elif c in given:
            exprs.append(merged(c).alias(c))
        elif c == "updated_at":
            exprs.append(F.when(changed | ~had, stamp).otherwise(F.col(c)).alias(c))
        elif c == "created_at":
            exprs.append(F.when(had, F.col(c)).otherwise(stamp).alias(c))
        elif c == "version":
            exprs.append(F.when(~had, F.lit(0)).when(changed, F.col(c) + 1).otherwise(F.col(c)).alias(c))
        else:
            exprs.append(F.col(c))
    if action:
        exprs.append(
            F.when(~had, F.lit("inserted")).when(changed, F.lit("updated")).otherwise(F.lit("kept")).alias(action)
        )
    return joined.select(*exprs)
