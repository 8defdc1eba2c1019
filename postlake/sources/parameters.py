"""Relations that callers hand over as JSON, and reports written as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def json_rows(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The rows of df once for each object of the JSON array in a column, with the fields of a schema such as ``id bigint, kind string``; malformed texts give none."""
    others = [c for c in df.columns if c != column]
    each = df.select(*others, F.explode(F.from_json(column, ArrayType(StructType.fromDDL(schema)))).alias("_row"))
    return each.select(*others, "_row.*")


def write_report(report: DataFrame, path: str) -> None:
    """One JSON object a line, nulls included, replacing the report that was there."""
    report.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
