"""What the training-data operators share: written tables and shared folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset and all runs on this machine, as in tests, a temporary folder is made.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = "file://" + tempfile.mkdtemp(prefix="loomdoc-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/loomdoc/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, with its lineage cut.

    A lost executor costs only the tasks that ran on it.
    """
    path = f"{_scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, buckets: int, name: str = "t") -> DataFrame:
    """As written, but dealt into buckets by a column, so that grouping and joining on it move no rows.

    Each task that computes df writes its own file of every bucket it has rows for. The catalogue
    knows the table only while it is opened here.
    """
    spark, known = df.sparkSession, f"loomdoc_{name}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{_scratch(spark)}/{known}")
    writer.bucketBy(buckets, column).saveAsTable(known)
    table = spark.table(known)
    table.schema  # noqa: B018  resolved, so that the name is no longer needed
    spark.sql(f"DROP TABLE {known}")
    return table


def clean(spark: SparkSession) -> None:
    """Removes what this application wrote to the shared folder, once its results have been read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(text):
    """Lower-cases A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def byte_texts(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def str_texts(column) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]
