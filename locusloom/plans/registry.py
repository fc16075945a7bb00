"""Query registry: each name carries its Spark job and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from locusloom.plans.fixtures import Fixtures

JOBS: dict[str, Callable[[Fixtures], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a job under ``name`` with its oracle text."""

    def wrap(job: Callable[[Fixtures], DataFrame]):
        if name in JOBS:
            raise ValueError(f"duplicate query {name}")
        JOBS[name] = job
        if sql is not None:
            ORACLES[name] = sql
        return job

    return wrap


def bind(job: Callable[[Fixtures], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: job(Fixtures(spark, sf_dir))
