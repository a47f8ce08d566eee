"""What the registered queries share."""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.compiler import Compiler
from ..plans.registry import Registry
from ..sources.tables import balanced

#: Documents made from events by rule: some as they are, some with what validators look for. Both engines read this expression.
EVENT_DOC = """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '{"k": "7"}' WHEN 2 THEN '{"k": 5, "z": 1}' WHEN 3 THEN '{}'
  WHEN 4 THEN '{"a": 1, "b": [1, 2, 2], "k": 101}' ELSE '{"k": null, "key": 3, "n_1": "x"}' END"""


_tables: WeakKeyDictionary[SparkSession, dict[str, DataFrame]] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver; its files are listed once in a session."""
    known, path = _tables.setdefault(spark, {}), f"{sf_dir}/{name}.parquet"
    if path not in known:
        known[path] = spark.read.parquet(path)
    return known[path]


def event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, event_type, text, doc (VARIANT)."""
    return balanced(table(spark, sf_dir, "events")).select("event_id", "event_type", F.expr(EVENT_DOC).alias("text")).withColumn("doc", F.parse_json("text"))


def compiler(*schemas: dict, **options) -> Compiler:
    return Compiler(Registry(schemas), **options)


class Catalogue:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Callable, sql: str | None = None) -> None:
        self.queries[name] = query
        if sql is not None:
            self.sql[name] = sql

    def query(self, sql: str | None = None):
        def register(f):
            self.add(f.__name__, f, sql)
            return f

        return register
