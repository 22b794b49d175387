"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, ShortType

from lexdrift.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Results as they are compared: fractions to six places, whole numbers as long."""

    def of(f):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            return (F.round(c.cast("double"), 6) + 0.0).alias(f.name)
        return c.cast("long").alias(f.name) if isinstance(f.dataType, (IntegerType, ShortType)) else c

    return df.select(*[of(f) for f in df.schema.fields])


def query(sql: str | None = None, fractions: str = "", wholes: str = ""):
    """Register a query under its function's name; ``sql`` gives the same rows, with the named columns rounded or made bigint."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return plain(f(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql is not None:
            changed = [f"round({c}::double, 6) + 0.0 as {c}" for c in fractions.split()] + [f"{c}::bigint as {c}" for c in wholes.split()]
            ORACLES[f.__name__] = f"select * replace ({', '.join(changed)}) from ({sql})" if changed else sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["top_drifting_words"](spark, sf_dir)


from lexdrift.plans import queries_drift, queries_sources, queries_text  # noqa: E402, F401
