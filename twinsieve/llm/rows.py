"""Columns computed from texts in Arrow batches, and keys of rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def struct_udf(function: Callable[[list], dict[str, list]], schema: str):
    """A column function: ``function`` takes a batch of texts (nulls as None) and returns the struct's fields."""
    kind = StructType.fromDDL(schema)
    fields = list(to_arrow_schema(kind))

    def apply(texts: pa.Array) -> pa.Array:
        columns = function(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(columns[f.name], f.type) for f in fields], fields=fields)

    return F.arrow_udf(apply, kind)


def content_key(text: Column | str = "text") -> Column:
    """64 bits of a text, to tell rows of one id apart; rows equal in both are one for every decision."""
    return F.xxhash64(text)


def parts_by_bytes(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes each; a row beyond that is a range of its own."""
    out, start, total = [], 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            out.append((start, i))
            start, total = i, 0
        total += size
    return [*out, (start, len(sizes))] if sizes else out
