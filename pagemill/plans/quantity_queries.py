"""Queries of the quantities operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import quantities
from pagemill.session import spread, table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return quantities.found_amounts(table(spark, d, "run_states"))


def p4_figures(spark: SparkSession, d: str) -> DataFrame:
    """Every figure with a unit of corrected_output, whatever the question, in base units."""
    states = spread(table(spark, d, "run_states").select("state_id", "corrected_output").where(F.col("corrected_output").isNotNull()))
    return states.select("state_id", F.posexplode(quantities.base_figures("corrected_output")).alias("no", "f")).select("state_id", "no", "f.dimensions", "f.value")


QUERIES = {"p4_found": p4_found, "p4_figures": p4_figures}
SQL: dict[str, str] = {}
