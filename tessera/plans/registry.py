"""All registered queries of the library and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import asking, assembling, catalog, code, finding, linking, modules, reports, scalars, selecting, tables

Query = Callable[[SparkSession, str], DataFrame]
GROUPS = (scalars, reports, linking, tables, asking, code, selecting, catalog, modules, finding, assembling)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.top_documents(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {k: q for g in GROUPS for k, q in g.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for g in GROUPS for k, s in g.SQL.items()}
