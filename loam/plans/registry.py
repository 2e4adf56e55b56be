"""The list of queries: name, function (spark, sf_dir) and the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_list(items) -> str:
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in items) + "]"


def sql_any(column: str, needles) -> str:
    return "(" + " OR ".join("contains(" + column + ", '" + n.replace("'", "''") + "')" for n in needles) + ")"


def values(rows: list[tuple]) -> str:
    """Literal rows for SQL."""

    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)

    return "VALUES " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
