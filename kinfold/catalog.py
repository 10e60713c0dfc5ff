"""The registry of queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import files, linkage, reports, scalars

QUERIES: dict = {**scalars.QUERIES, **linkage.QUERIES, **files.QUERIES, **reports.QUERIES}
SQL: dict[str, str] = {**scalars.SQL, **linkage.SQL, **files.SQL, **reports.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well do exact legal names within a country, with capped posting lists, find the same businesses?"""
    return linkage.agg_macro_f05(spark, sf_dir)
