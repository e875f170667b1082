"""Per-batch Arrow functions over narrow inputs, shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arrow_schema(ddl: str) -> pa.Schema:
    """Made on the driver: the DDL parser is not there in tasks."""
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(StructType.fromDDL(ddl))


def map_batches(df: DataFrame, ddl: str, start: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]]) -> DataFrame:
    """One output per batch. ``start`` runs once in each task and returns the batch function."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            step = step or start()
            out = step(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
    return df.mapInArrow(run, ddl)


@contextmanager
def small_batches(spark: SparkSession, most: str = "4m") -> Iterator[None]:
    """Arrow batches of what is run inside have some ``most`` bytes, whatever 10,000 rows would take; the session's setting comes back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``id`` and ``text``, so that other columns can have any name; a null text is empty."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_key(text_col: str) -> Column:
    """Tells rows of one id apart by their texts; a null text is empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.lit(1))


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """Whole rows as one column ``row`` beside ``keys``, so that their columns may have any names; ``row.*`` gives them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[k.alias(name) for name, k in keys.items()])
