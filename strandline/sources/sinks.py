"""Writers for datasets, sidecars and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.numeric import finite

ROWS_PER_FILE = 5_000_000
COMPLEX = (T.StructType, T.ArrayType, T.MapType)


def write_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)


def write_text_dataset(df: DataFrame, path: str) -> None:
    """Delimited copy; doubles keep their shortest exact form, missing numbers read NaN."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "NaN").option("nanValue", "NaN").csv(path)


def write_flights(df: DataFrame, path: str, index: str = "time_us", span: int = 3_600_000_000) -> None:
    """One folder per log and flight. Rows are spread by flight and hour, so a long flight is written by many
    tasks and a short one by few."""
    spread = df.repartition("log_id", "flight_id", F.floor(F.col(index) / span))
    spread.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("log_id", "flight_id").parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested cells as JSON text, bytes as hexadecimal text."""
    return df.select(*[
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, COMPLEX)
        else F.lower(F.hex(f.name)).alias(f.name) if isinstance(f.dataType, T.BinaryType)
        else F.col(f.name)
        for f in df.schema.fields
    ])


def sidecar(parts: list[DataFrame]) -> DataFrame:
    """Raw rows of several layouts as one table with the union of their columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [flat(p) for p in parts])


def json_safe(c: Column, kind: T.DataType) -> Column:
    """Non-finite numbers as NULL and bytes as hexadecimal text, at any depth."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(finite(c), c)
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda k, v: json_safe(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[json_safe(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON document: non-finite numbers become null, bytes hexadecimal text."""
    safe = [json_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("value"))


def write_reports(reports: dict[str, DataFrame], root: str) -> None:
    """One folder per report table."""
    for name, table in reports.items():
        table.write.mode("overwrite").parquet(f"{root}/{name}")
