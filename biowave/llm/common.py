"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: for jobs whose result is written: shuffle files go at their end, instead of when the driver happens to collect garbage
WRITTEN = {"classic__shuffleDependency__fileCleanup__enabled": "true"}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one of this machine only where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="biowave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@contextmanager
def _set(spark: SparkSession, **options: str) -> Iterator[None]:
    """Session options (__ for each dot) for a while."""
    names = {k: f"spark.sql.{k.replace('__', '.')}" for k in options}
    before = {k: spark.conf.get(name) for k, name in names.items()}
    try:
        for k, value in options.items():
            spark.conf.set(names[k], value)
        yield
    finally:
        for k, value in before.items():
            spark.conf.set(names[k], value)


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage is cut and a lost executor costs nothing.

    Nothing reads the shuffles of the job any more once the table is written, so their files go with its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/biowave/{uuid.uuid4().hex}"
    with _set(spark, **WRITTEN):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df in a reliable checkpoint in the shared folder: unlike a written table it keeps how its rows are partitioned.

    An adaptive plan doesn't say how it will be partitioned, so this one plan is made without.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    with _set(spark, adaptive__enabled="false", **WRITTEN):
        return df.select("*").checkpoint()


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; the byte-wise lower() is the same thing, and faster, where every character is ASCII."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(
        F.translate(whole, UPPER, UPPER.lower())
    )


def crc32_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo n: the fold of a document."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
