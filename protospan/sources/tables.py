"""Readers of the Parquet tables; one place that knows where a table lies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``, a Parquet file or folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shortest_double(c) -> "F.Column":
    """A float32 as the double nearest its shortest decimal text (not the widened float)."""
    return c.cast("string").cast("double")


def column_names(df: DataFrame) -> list[str]:
    """Leaf field names of a schema, nested fields with dots between."""

    def walk(fields, at: str) -> list[str]:
        out: list[str] = []
        for f in fields:
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType.fields, f"{at}{f.name}.")
            else:
                out.append(at + f.name)
        return out

    return walk(df.schema.fields, "")
