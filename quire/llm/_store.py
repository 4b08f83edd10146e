"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: While a table is written, shuffle files of what runs go when it ends, as nothing reads them once the table is there;
#: and Python gets texts by the thousand, which bounds the buffers on both sides.
_FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
#: Tables of few columns get few files: by their size and not by the number of cores, and at most one for so many shuffle
#: partitions, which are as many as whole texts ask for.
PARTITIONS_A_FILE = 8
_FEW_FILES = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests), one below the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared").rstrip("/")


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, *, few_files: bool = False) -> DataFrame:
    """df, computed once: written as Parquet to the shared folder and read again.

    A lost executor costs no more than the running stage, and later steps read the table
    instead of computing it again. The shuffle files behind it are freed. few_files: for tables that are small beside
    the texts and come from a shuffle; not for what takes much computing for its size.
    """
    spark = df.sparkSession
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    with _settings(spark, _FREED | _FEW_FILES if few_files else _FREED):
        (df.coalesce(max(int(spark.conf.get("spark.sql.shuffle.partitions")) // PARTITIONS_A_FILE, 1)) if few_files else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads; what was made of them must be written too."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
