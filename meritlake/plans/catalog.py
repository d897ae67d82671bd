"""Registry of queries: the Spark job and, where SQL can say it, the SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meritlake import constants as K
from meritlake.plans.driver_views import Tables, with_views


class Query(NamedTuple):
    run: Callable[[Tables], DataFrame]
    oracle: str | None
    heavy: bool


CATALOG: dict[str, Query] = {}


def query(name: str, oracle: str | None = None, heavy: bool = False):
    """Register a query; ``heavy`` ones do so much per row that small inputs are spread first."""
    def register(run: Callable[[Tables], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"query registered twice: {name}")
        CATALOG[name] = Query(run, with_views(oracle) if oracle else None, heavy)
        return run

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(entry: Query):
        return lambda spark, folder: entry.run(Tables(spark, folder, entry.heavy))

    return {name: bound(entry) for name, entry in CATALOG.items()}


def oracles() -> dict[str, str]:
    return {name: entry.oracle for name, entry in CATALOG.items() if entry.oracle}


# --- small helpers shared by the query modules --------------------------------------------

def day(column: str) -> Column:
    """A date or time column as ISO text, under its own name."""
    return F.date_format(column, "yyyy-MM-dd").alias(column.split(".")[-1])


def sql_day(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d') AS {column.split('.')[-1]}"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SQL_WHITE = " || ".join(f"chr({ord(c)})" for c in K.STRIP_CHARS)


def sql_strip(expression: str) -> str:
    return f"trim({expression}, {SQL_WHITE})"


def sql_contains_any(expression: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({expression}, {sql_text(p)})" for p in phrases) + ")"


def sql_lines(expression: str, breaks: str, minimum: int) -> str:
    """Trimmed lines of a minimum length, joined by newlines."""
    return (f"array_to_string(list_filter(list_transform(regexp_split_to_array({expression}, '{breaks}'), "
            f"lambda l: {sql_strip('l')}), lambda l: length(l) >= {minimum}), chr(10))")


PROGRAMMES_SQL = "(VALUES " + ", ".join(
    f"({i}, {sql_text(key)}, {sql_text(name)})" for i, (key, name) in enumerate(K.DEGREE_PROGRAMMES)
) + ") AS p(place, key, name)"


def programme_key(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(key) for key, _ in K.DEGREE_PROGRAMMES]), number + 1)


def keyword_table(t: Tables) -> DataFrame:
    return t.keywords.select(
        programme_key(F.col("programme_no").cast("int")).alias("programme_key"), "kind", "keyword")
