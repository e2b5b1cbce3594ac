"""Reading and writing structured logs, catalogues, metric tables and exchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.reports import round2

CATALOGUE_SCHEMA = (
    "log_id string, EventId string, EventTemplate string, Occurrences bigint, first_line bigint, "
    "template_key string"
)
EXCHANGE_SCHEMA = (
    "user_input string, response string, extra_info string, timestamp string, response_time string, "
    "_corrupt_record string"
)


def output_path(root: str, table: str) -> str:
    """Folder of one kind of result; each log is a ``log_id=`` partition inside."""
    return f"{root.rstrip('/')}/{table}"


def write_by_log(df: DataFrame, root: str, table: str) -> str:
    """Write parquet, one partition per log, replacing only the logs in ``df``."""
    path = output_path(root, table)
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("log_id")
        .parquet(path)
    )
    return path


def read_by_log(spark: SparkSession, root: str, table: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(output_path(root, table))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; array columns are written as JSON text."""
    columns = [
        F.to_json(name).alias(name) if kind.startswith("array") else F.col(name) for name, kind in df.dtypes
    ]
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def two_decimals(wide: DataFrame) -> DataFrame:
    """Number columns as text with two decimals."""
    return wide.select(*[
        F.format_string("%.2f", round2(F.col(f"`{name}`"))).alias(name) if kind == "double" else F.col(f"`{name}`")
        for name, kind in wide.dtypes
    ])


def write_metrics(wide: DataFrame, path: str) -> None:
    """Wide metrics, one folder ``sheet=<name>`` per sheet, two decimals."""
    two_decimals(wide).write.mode("overwrite").option("header", True).partitionBy("sheet").csv(path)


def read_metrics(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All sheets' wide metrics; the sheet comes from the folder name."""
    schema = "category string, " + ", ".join(f"`{name}` double" for name in columns)
    table = spark.read.schema(schema + ", sheet string").option("header", True).csv(path)
    return table.select("sheet", "category", *[F.col(f"`{name}`") for name in columns])


def append_exchanges(exchanges: DataFrame, path: str) -> None:
    """Append question and answer records as JSON lines."""
    exchanges.select("user_input", "response", "extra_info", "timestamp", "response_time").write.mode(
        "append"
    ).json(path)


def read_exchanges(spark: SparkSession, path: str) -> DataFrame:
    """Saved exchanges; unreadable records are kept aside in ``_corrupt_record``."""
    return (
        spark.read.schema(EXCHANGE_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )
