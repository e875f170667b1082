"""Written intermediate tables.

A DataFrame that several later stages read is written once as Parquet under the cluster's shared
checkpoint folder and read back. Compared with a cache this survives the loss of executors without
recomputing, cuts the lineage, keeps column pruning, and gives the optimizer real sizes.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open: list[list[str]] = []  # folders made inside each open ``temporary`` block


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the session's checkpoint folder, else a folder in its warehouse.

    On a cluster a warehouse on local disks is refused: each executor would write to its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    one_machine = re.match(r"local(\[|$)", spark.sparkContext.master)
    if not one_machine and (warehouse.startswith("file:") or ":" not in warehouse):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; the warehouse {warehouse} is on local disks")
    return f"{warehouse}/_scratch"


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark).rstrip('/')}/evalspark/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder and return the table read back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables made inside, once the result of the run is written."""
    _open.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _open.pop():
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
