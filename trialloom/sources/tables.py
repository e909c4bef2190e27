"""File scans and sinks: CSV with a declared schema, Parquet snapshots, the course catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trialloom.functions.nulls import as_col

# fixed values: the columns of a course catalogue file
CATALOGUE_COLUMNS = [
    "school", "year_term", "number", "name", "short_name", "start", "end", "intermediate_outcome",
    "on_demand", "new_course", "Phase", "course_url", "notes",
]


def read_csv(spark: SparkSession, path: str, schema: StructType | str, **options) -> DataFrame:
    """CSV with a header row and quoted commas; the schema is declared, so there is no inference pass."""
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', **options)


def load_snapshot(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def save_snapshot(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def flexible_date(x: Column | str) -> Column:
    """Date from month/day/year text whose year has four or two digits.

    The four-digit pattern goes first, since it rejects a two-digit year while the reverse is not so.
    """
    text = F.trim(as_col(x))
    return F.coalesce(F.try_to_date(text, "M/d/yyyy"), F.try_to_date(text, "M/d/yy"))


def tidy_catalogue(raw: DataFrame) -> DataFrame:
    """Typed catalogue from all-text columns: trimmed, blanks as NULL, dates and the flag parsed."""
    trimmed = raw.select(*[F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in CATALOGUE_COLUMNS])
    return trimmed.withColumns(
        {
            "start": flexible_date("start"),
            "end": flexible_date("end"),
            "on_demand": F.col("on_demand").try_cast("int"),
        }
    )


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in CATALOGUE_COLUMNS)
    return tidy_catalogue(read_csv(spark, path, schema))
