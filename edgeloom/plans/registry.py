"""Registered queries: one per operator of the inventory, each with its oracle.

A query is ``fn(ctx) -> DataFrame`` over the fixture inputs of one scale
factor; ``ctx`` holds the lazily built (and staged) graph of that folder so a
session answering many queries builds each stage once. Every query reads the
whole driver tables; traversal seeds come from the data (the most connected
node, which is also what the reference's search opens with).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from edgeloom.plans.build import BuildParams, GraphBuild
from edgeloom.plans.report import report
from edgeloom.sources.fixtures import AS_OF, HOST, OFFSET_DAYS, WORKSPACE, Fixture


class Ctx:
    def __init__(self, spark: SparkSession, sf_dir: str, materialize: bool = True):
        self.spark, self.sf_dir = spark, sf_dir
        self.fx = Fixture(spark, sf_dir)
        self.params = BuildParams(WORKSPACE, HOST, AS_OF, OFFSET_DAYS)
        self.host, self.as_of, self.days = HOST, AS_OF, OFFSET_DAYS
        self.g = GraphBuild(self.fx.events(), self.params, self.fx.inventory(), self.fx.legacy(),
                            materialize=materialize)
        self.memo: dict = {}

    def once(self, name: str, make: Callable[[], DataFrame], stage: bool = True) -> DataFrame:
        if name not in self.memo:
            df = make()
            self.memo[name] = self.g._get(name, lambda: df) if stage else df
        return self.memo[name]


_CTX: dict = {}
MATERIALIZE = True


def ctx_for(spark: SparkSession, sf_dir: str) -> Ctx:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CTX:
        _CTX[key] = Ctx(spark, sf_dir, MATERIALIZE)
    return _CTX[key]


@dataclass
class Entry:
    fn: Callable[[Ctx], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = Entry(fn, sql)
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def make(e: Entry):
        return lambda spark, sf_dir: report(e.fn(ctx_for(spark, sf_dir)))
    return {k: make(e) for k, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: e.sql for k, e in REGISTRY.items() if e.sql is not None}


def load_all() -> None:
    """Import the modules that register queries."""
    import importlib
    for m in ("q_build", "q_serve", "q_graph", "q_purge", "q_scale"):
        try:
            importlib.import_module(f"edgeloom.plans.{m}")
        except ModuleNotFoundError as ex:
            if ex.name != f"edgeloom.plans.{m}":
                raise
