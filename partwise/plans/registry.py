"""The registry of queries by name, with their DuckDB SQL; ``catalogue`` fills it.

``query(sql)`` registers a function ``(spark, sf_dir) -> DataFrame``; without SQL
the driver makes a rows-only check, and a test holds the query against a plain
version instead (``hash_phash``, ``src_local_dir``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "agg_rate_ci"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Second names of queries: the function and SQL are those of the first name.
ALIASES: dict[str, str] = {}


def also(name: str, of: str) -> None:
    """Keep the query ``of`` under the name that it had in an earlier version as well."""
    ALIASES[name] = of
    QUERIES[name] = QUERIES[of]
    if of in ORACLE:
        ORACLE[name] = ORACLE[of]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
