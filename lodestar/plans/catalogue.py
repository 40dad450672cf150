"""All queries of the workloads by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import Catalog
from . import single, ssb, tpch

CATALOGUE = tpch.CATALOGUE | ssb.CATALOGUE | single.CATALOGUE
ORACLE_SQL = {name: sql for name, (_, sql) in CATALOGUE.items()}


def _over_folder(plan) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(Catalog(spark, sf_dir))


QUERIES = {name: _over_folder(plan) for name, (plan, _) in CATALOGUE.items()}
