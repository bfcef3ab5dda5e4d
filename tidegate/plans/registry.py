"""Named queries over the driver tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[["Tables"], DataFrame]


class Tables:
    """Lazy access to the parquet tables of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


class Registry:
    def __init__(self) -> None:
        self.plans: dict[str, Plan] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
        def add(plan: Plan) -> Plan:
            if name in self.plans:
                raise ValueError(f"query {name!r} is registered twice")
            self.plans[name] = plan
            if sql is not None:
                self.sql[name] = sql
            return plan

        return add

    def merge(self, other: Registry) -> None:
        for name, plan in other.plans.items():
            self.query(name, other.sql.get(name))(plan)
