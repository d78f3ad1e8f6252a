"""The registered queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        register(name, f, sql)
        return f

    return keep


def examples(name: str, inputs: list[tuple], expected: list[str | None], build: Callable[..., "Column"]) -> None:
    """Registers a query that gives each user one of the inputs, by id, and ``build``'s text for it.

    ``expected`` are the texts by the rules that define the operator; the oracle knows nothing else.
    """
    from pyspark.sql import functions as F

    width = len(inputs[0])

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = spark.createDataFrame([(i, *x) for i, x in enumerate(inputs)], "k int, " + ", ".join(f"x{j} string" for j in range(width)))
        users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().withColumn("k", (F.col("user_id") % len(inputs)).cast("int"))
        return users.join(F.broadcast(table), "k").select("user_id", build(*(F.col(f"x{j}") for j in range(width))).alias("result"))

    quoted = ", ".join("NULL" if e is None else "'" + e.replace("'", "''") + "'" for e in expected)
    register(name, run, f"SELECT user_id, [{quoted}][1 + user_id % {len(inputs)}] AS result FROM (SELECT DISTINCT user_id FROM events)")
