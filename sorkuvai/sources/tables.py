"""Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def splits(df: DataFrame) -> int:
    """About how many tasks a scan of the files is cut into; counting stops once every core has one."""
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if len(files) >= cores:
        return len(files)
    size = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    paths = [hadoop(f) for f in files]
    return sum(-(-p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() // size) for p in paths)


def read(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table, or some of its columns; if its files make fewer tasks than there are cores, its rows are spread over them.

    What is spread is therefore never more than a scan task's bytes for each core; larger tables are read as they lie.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    few = splits(df) < spark.sparkContext.defaultParallelism
    df = df.select(*columns) if columns else df
    return df.repartition(spark.sparkContext.defaultParallelism) if few else df
