"""Discovery over a stream of landed feed items; same result as the batch operator.

The state is a log: version ``n + 1`` of a table is a folder ``v=n+1`` with the rows batch ``n`` added (new articles, new
links, sightings of known articles). A micro-batch reads what its keys can meet in the versions before it and writes its
own folder, so its cost does not include rewriting the tables. After COMPACT_AFTER versions they are merged to one base,
and the folders merged are removed, so a state has a bounded number of folders however long it runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.discover import discover, merge_articles, new_article_rows, new_link_rows, seen_again
from ..sources.tables import remove, stage


#: Versions after which a state is merged.
COMPACT_AFTER = 16
TABLES = ("articles", "seen", "links")


def _write(df: DataFrame, state_dir: str, name: str, version: int) -> None:
    df.write.mode("overwrite").parquet(f"{state_dir}/{name}/v={version}")


def _marked(spark: SparkSession, state_dir: str, name: str, version: int | None = None) -> int | None:
    """Newest version with a marker, at most ``version``; None where there is none."""
    try:
        marks = spark.read.parquet(f"{state_dir}/{name}")
    except AnalysisException:
        return None
    if version is not None:
        marks = marks.filter(F.col("v") <= version)
    return marks.agg(F.max("v").alias("v")).first()["v"]


def _read(spark: SparkSession, state_dir: str, name: str, version: int) -> DataFrame:
    """Rows of the newest base and all versions behind it up to ``version``; later folders may stem from an attempt that failed."""
    base = _marked(spark, state_dir, "bases", version)
    paths = [f"{state_dir}/{name}/v={v}" for v in range(0 if base is None else base + 1, version + 1)]
    if base is not None:
        paths.insert(0, f"{state_dir}/base_{name}/v={base}")
    return spark.read.parquet(*paths)


def read_state(spark: SparkSession, state_dir: str, version: int) -> tuple[DataFrame, DataFrame]:
    """Article and link tables as of ``version``, sightings applied."""
    articles, seen, links = (_read(spark, state_dir, name, version) for name in TABLES)
    return merge_articles(articles, articles.limit(0), seen), links


def compact(spark: SparkSession, state_dir: str, version: int) -> None:
    """Merge all up to ``version``, which must be complete, to one base, and remove what has been merged.

    The base counts from its marker on, which is written last; folders are removed after that. Whatever an interrupted
    run leaves behind is not read, and goes with the next merge.
    """
    old = _marked(spark, state_dir, "bases")
    for name in TABLES:
        rows = _read(spark, state_dir, name, version)
        if name == "seen":
            rows = rows.groupBy("id").agg(F.max("last_seen_at").alias("last_seen_at"))
        rows.write.mode("overwrite").parquet(f"{state_dir}/base_{name}/v={version}")
    _write(spark.range(1), state_dir, "bases", version)
    for v in range(0 if old is None else old + 1, version + 1):
        for name in (*TABLES, "work"):
            remove(spark, f"{state_dir}/{name}/v={v}")
        if v < version:
            remove(spark, f"{state_dir}/done/v={v}")
    if old is not None:
        for name in TABLES:
            remove(spark, f"{state_dir}/base_{name}/v={old}")
        remove(spark, f"{state_dir}/bases/v={old}")
        remove(spark, f"{state_dir}/done/v={old}")


def last_version(spark: SparkSession, state_dir: str) -> int | None:
    """Newest complete version of a state, or None where there is no state yet.

    A one-row marker is written after the other folders of a version.
    """
    return _marked(spark, state_dir, "done")


def stream_discover(spark: SparkSession, landing: str, schema: str, to_items: Callable[[DataFrame], DataFrame],
                    endpoints: DataFrame, state_dir: str, start: tuple[DataFrame, DataFrame], now: Column, *,
                    files_per_trigger: int = 100) -> int:
    """Run discovery over all files now in ``landing`` and return the last state version.

    ``start`` holds the article and link tables before the stream; a state that is there already is
    gone on with. A batch that is run again after a failure overwrites its own folders from the same
    input, so late or repeated items change nothing but ``last_seen_at``.
    """
    if last_version(spark, state_dir) is None:
        articles, links = start
        link_columns = ["article_id", "source_endpoint_id", "source_item_id", "fetched_at"]
        _write(articles, state_dir, "articles", 0)
        _write(articles.select("id", "last_seen_at").limit(0), state_dir, "seen", 0)
        _write(links.select(*link_columns), state_dir, "links", 0)
        _write(spark.range(1), state_dir, "done", 0)

    def step(batch: DataFrame, batch_id: int) -> None:
        session, version = batch.sparkSession, batch_id + 1
        done = last_version(session, state_dir)
        if done is not None and done >= version:
            return  # written before a restart that came ahead of the stream's own checkpoint
        known = _read(session, state_dir, "articles", batch_id)
        linked = _read(session, state_dir, "links", batch_id)
        # Items and what is found are written once; all that follows reads them back.
        work = f"{state_dir}/work/v={version}"
        found = discover(stage(to_items(batch), work, "items"), endpoints, known, linked, now)
        articles, links = stage(found.articles, work, "articles"), stage(found.links, work, "links")
        rows = known.limit(0).unionByName(new_article_rows(known, articles, now), allowMissingColumns=True)
        _write(rows.select(*known.columns), state_dir, "articles", version)
        _write(seen_again(articles), state_dir, "seen", version)
        fresh = session.read.parquet(f"{state_dir}/articles/v={version}")
        _write(new_link_rows(links, fresh), state_dir, "links", version)
        _write(session.range(1), state_dir, "done", version)
        remove(session, work)
        base = _marked(session, state_dir, "bases")
        if version - (0 if base is None else base) >= COMPACT_AFTER:
            compact(session, state_dir, version)

    query = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(landing)
        .writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{state_dir}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return last_version(spark, state_dir)
