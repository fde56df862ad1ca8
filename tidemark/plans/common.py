"""Helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str):
    """Microseconds since 1970 of a timestamp without zone."""
    return F.unix_micros(F.col(c).cast("timestamp"))


#: DuckDB form of an FNV-1a-64 hash of an ASCII text expression.
def fnv_sql(text: str) -> str:
    return (
        f"(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split({text}, ''), lambda c: ord(c)::HUGEINT)), "
        "lambda h, x: (xor(h::UBIGINT, x::UBIGINT)::HUGEINT * 435 + (xor(h::UBIGINT, x::UBIGINT) % 16777216)::HUGEINT * 1099511627776) % 18446744073709551616))"
    )
