"""Table scans and snapshot writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas


def read_table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """Scan ``{folder}/{name}.parquet``; engine tables are read with their stated schema.

    Filters and column choices made on the result reach the Parquet scan.
    """
    reader = spark.read
    schema = schema or schemas.TABLES.get(name)
    if schema:
        reader = reader.schema(schema)
    return reader.parquet(f"{folder}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, table: str, *, key: str, lower: int, upper: int, partitions: int,
              **options: str) -> DataFrame:
    """Scan a database table in ``partitions`` parallel key ranges."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(lower), upperBound=str(upper),
                 numPartitions=str(partitions), **options)
        .load()
    )


def spread(scan: DataFrame) -> DataFrame:
    """Give costly per-row work on a scanned table at least one partition per core.

    Does nothing for tables that are read in many pieces, which any large one is; only a table read
    as fewer pieces than there are cores is redistributed. Meant for scans: asking a plan with
    shuffles for its partitions would run them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def stage(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write an intermediate table under the shared ``folder`` and read it back.

    Cuts the lineage: what several later tables are derived from is computed once, and a lost
    executor costs a re-read instead of a recomputation.
    """
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_snapshot(df: DataFrame, path: str, *, cluster_by: list[str] | None = None) -> None:
    """Write a table so that row-group statistics on ``cluster_by`` help later scans."""
    out = df
    if cluster_by:
        out = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    out.write.mode("overwrite").parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, whichever file system it is in; nothing happens if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
