"""Audited snapshots with an append-only log, and landings by key bucket."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from .stored import stored

LOG = "name string, version string, path string, n_rows long, n_columns int, columns string, digest long, bytes long, written timestamp"


def digest(df: DataFrame) -> Column:
    """A number that tells contents apart in any order of rows: the sum over rows of 32 bits of an md5 of their values as text."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns))
    return F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"))


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_snapshot(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as a new version of ``name`` and return its row of the log.

    Rows go to a staging folder and are counted and digested on the way; they are read again and must give the same digest; the
    folder is renamed; the row of the log makes the version visible. A write that breaks off before that leaves none.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    staging, path = f"{folder}/{name}/_staging-{version}", f"{folder}/{name}/{version}"
    seen = Observation("snapshot")
    df.observe(seen, F.count(F.lit(1)).alias("n"), digest(df).alias("digest")).write.parquet(staging)
    wrote = (seen.get["n"], seen.get["digest"])
    found = tuple(spark.read.schema(df.schema).parquet(staging).agg(F.count("*"), digest(df)).first())
    if wrote != found:
        raise OSError(f"{name}: wrote {wrote}, found {found}")
    fs, source = _file_system(spark, staging)
    size = fs.getContentSummary(source).getLength()
    if not fs.rename(source, _file_system(spark, path)[1]):
        raise OSError(f"{name}: {staging} could not be renamed")
    row = spark.createDataFrame([(name, version, path, wrote[0], len(df.columns), ",".join(df.columns), wrote[1], size)], LOG.rsplit(",", 1)[0]).withColumn("written", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(f"{folder}/_log")
    return snapshot_log(spark, folder).where(F.col("version") == version)


def snapshot_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(f"{folder}/_log")


def read_snapshot(spark: SparkSession, folder: str, name: str, version: str | None = None) -> DataFrame:
    """The named version, or the last one that was committed."""
    rows = snapshot_log(spark, folder).where(F.col("name") == name)
    row = (rows if version is None else rows.where(F.col("version") == version)).orderBy(F.desc("written")).limit(1).collect()
    if not row:
        raise FileNotFoundError(f"no snapshot of {name} in {folder}")
    return spark.read.parquet(row[0]["path"])


# --- landings

def land(answers: DataFrame, asked: DataFrame, folder: str, as_of, key: str = "ticker", buckets: int = 64) -> None:
    """Land ``answers`` for the keys that were ``asked``, each with the day it landed; a key without an answer gets a row without values, so
    that it is not asked again at once. Only the buckets of these keys are written anew, with the other keys that they hold."""
    spark = answers.sparkSession
    asked = asked.select(key).distinct()
    values = [c for c in answers.columns if c != key]
    fresh = asked.join(answers.withColumn("_got", F.lit(True)), key, "left").withColumn("landed_on", F.lit(as_of).cast("date"))
    fresh = fresh.select(key, *values, F.coalesce("_got", F.lit(False)).alias("has_data"), "landed_on").withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    fs, place = _file_system(spark, folder)
    if fs.exists(place):
        touched = fresh.select("bucket").distinct()
        held = spark.read.parquet(folder).join(touched, "bucket", "left_semi").join(asked, key, "left_anti")
        fresh = fresh.unionByName(held.select(*fresh.columns))
    stored(fresh).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)


def landings(spark: SparkSession, folder: str, key: str = "ticker") -> DataFrame:
    """key, landed_on, n: what the work list asks for; keys without data have n = 0."""
    return spark.read.parquet(folder).groupBy(key).agg(F.max("landed_on").alias("landed_on"), F.count_if("has_data").alias("n"))
