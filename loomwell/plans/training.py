"""Queries of the general training-data operators (problems 3 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwell.operators.changes import pending_keys
from loomwell.operators.timestamps import instants_found
from loomwell.session import read_table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return pending_keys(*(read_table(spark, folder, t) for t in ("refs", "sync_runs", "posts", "blogs")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return instants_found(read_table(spark, folder, "posts"), read_table(spark, folder, "blogs"))


QUERIES = {"p3_found": p3_found, "p5_found": p5_found}
