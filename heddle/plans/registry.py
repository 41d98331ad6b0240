"""Registry of queries and their oracle SQL.

A *binding* derives a lineage table from the driver tables in SQL both engines
run, so that a query and its oracle start from the same input rows. What the
operator computes is stated twice: in Spark here, and in DuckDB SQL in the
oracle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heddle.session import cut, generation, lasting, sized

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

BINDINGS: dict[str, str] = {}
#: The same rows in the order in which Spark moves least, where that is another than the binding's.
BUILT: dict[str, str] = {}
_LANDED: dict[tuple[str, int, str, str], DataFrame] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def binding(name: str, sql: str, built: str | None = None) -> None:
    BINDINGS[name] = sql.strip()
    if built is not None:
        BUILT[name] = built.strip()


def _needed(text: str) -> list[str]:
    """Bindings a text refers to, each after the ones it depends on itself."""
    order: list[str] = []

    def visit(body: str) -> None:
        for word in dict.fromkeys(re.findall(r"\bb_\w+", body)):
            if word in BINDINGS and word not in order:
                visit(BINDINGS[word])
                if word not in order:
                    order.append(word)

    visit(text)
    return order


def with_bindings(sql: str, recursive: bool = False) -> str:
    parts = [f"{name} AS (\n{BINDINGS[name]}\n)" for name in _needed(sql)]
    body = sql.strip()
    match = re.match(r"(?is)^WITH\s+(RECURSIVE\s+)?", body)
    if match:
        parts.append(body[match.end():])
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts)
    if not parts:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


class Inputs:
    """Lineage tables of one data directory: ``t("b_entity")`` or ``t.sql(...)``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def base(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def sql(self, text: str) -> DataFrame:
        """`text` over the driver tables and the landed lineage tables."""
        for word in dict.fromkeys(re.findall(r"\bb_\w+", text)):
            if word in BINDINGS:
                self(word).createOrReplaceTempView(word)
        full = text
        for table in TABLES:
            if re.search(rf"\b{table}\b", full):
                self.base(table).createOrReplaceTempView(table)
        return self.spark.sql(full)

    def __call__(self, name: str) -> DataFrame:
        """A landed lineage table: derived once per session and directory, then read."""
        key = (self.spark.sparkContext.applicationId, generation(self.spark), self.sf_dir, name)
        if key not in _LANDED:
            with lasting():
                _LANDED[key] = cut(self.sql(BUILT.get(name, BINDINGS[name])))
        return _LANDED[key]


def query(name: str, oracle: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under `name`, with its oracle SQL."""

    def register(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            sized(spark)
            return fn(Inputs(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_bindings(oracle, recursive=True)
        return fn

    return register
