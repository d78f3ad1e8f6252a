"""Series from event tables, and the readers of series, cases and captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import npy

#: The base of the SQL oracles: one row for each point, and one list for each series.
POINTS_SQL = "p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS v, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
SERIES_SQL = "s AS (SELECT user_id, list(value ORDER BY ts, event_id) AS s, count(*) AS n FROM events GROUP BY user_id)"


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows ``user_id, values``: each user's event values in order of time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value")
    ordered = events.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("r"))
    return ordered.select("user_id", F.transform("r", lambda x: x["value"]).alias("values"))


def points(series: DataFrame, *keys: str, values: str = "values") -> DataFrame:
    """The long view: ``keys, t, v``."""
    return series.select(*keys, F.posexplode(values).alias("t", "v"))


def rounded(x: Column, digits: int = 6) -> Column:
    """Half-up at so many digits, by floor: engines agree on it, unlike on round()."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def rounded_sql(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits}::DOUBLE + 0.5::DOUBLE) / 1e{digits}::DOUBLE"


def read_cases(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array (or one object) of cases."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON Lines."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_csv_series(spark: SparkSession, path: str, columns: list[str], list_column: str, limit: int | None = None) -> DataFrame:
    """CSV with pruned columns, a literal list of numbers in one cell, and the row's number in file order."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    rows = rows.select(*columns, F.from_json(list_column, "array<double>").alias("values"), F.col("_metadata.file_name").alias("file"))
    return rows.limit(limit) if limit is not None else rows


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``index | description``, split at the first bar."""
    parts = F.split("value", r"\|", 2)
    return spark.read.text(path).where(F.col("value").contains("|")).select(F.trim(parts[0]).try_cast("int").alias("index"), F.trim(parts[1]).alias("description"))


def read_npy(spark: SparkSession, path: str, **options) -> DataFrame:
    """Rows ``path, row, values`` of one- or two-dimensional NumPy files, read by ranges of rows (``sources.npy``)."""
    npy.register(spark)
    prune = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("npy").options(**{"prune": prune, **options}).load(path)
