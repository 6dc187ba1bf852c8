"""Query registry and the output contract shared by Spark and SQL.

An output spec such as ``"seller_id:i day:d wape:f"`` fixes column names,
order and types on both sides: ``i`` BIGINT, ``f`` DOUBLE rounded to 6
decimals with one binary formula on both sides (half-even on the double
``x * 1e6``: ``rint`` in Spark, ``round_even`` in DuckDB), so last-bit float
noise cannot break a value hash and the rounding stays inside codegen, ``s`` string,
``d`` DATE, ``t`` TIMESTAMP.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load_tables

DIGITS = 6


def parse_spec(spec: str) -> list[tuple[str, str]]:
    return [tuple(tok.split(":")) for tok in spec.split()]


def finalize(df: DataFrame, spec: str) -> DataFrame:
    cols = []
    for name, kind in parse_spec(spec):
        c = F.col(name)
        if kind == "i":
            c = c.cast("bigint")
        elif kind == "f":
            x = c.cast("double")
            c = F.rint(x * F.lit(10.0 ** DIGITS)) / F.lit(10.0 ** DIGITS) + F.lit(0.0)
        elif kind == "s":
            c = c.cast("string")
        elif kind == "d":
            c = c.cast("date")
        elif kind == "t":
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(name))
    return df.select(*cols)


def wrap_sql(spec: str, sql: str) -> str:
    cols = []
    for name, kind in parse_spec(spec):
        q = f'"{name}"'
        if kind == "i":
            e = f"CAST({q} AS BIGINT)"
        elif kind == "f":
            x = f"CAST({q} AS DOUBLE)"
            e = f"round_even({x} * {10.0 ** DIGITS}, 0) / {10.0 ** DIGITS} + 0.0"
        elif kind == "s":
            e = f"CAST({q} AS VARCHAR)"
        elif kind == "d":
            e = f"CAST({q} AS DATE)"
        else:
            e = f"CAST({q} AS TIMESTAMP)"
        cols.append(f"{e} AS {q}")
    return f"SELECT {', '.join(cols)}\nFROM (\n{sql}\n) AS _q"


@dataclass
class Query:
    name: str
    build: Callable[[dict], DataFrame]      # tables -> DataFrame
    spec: str
    sql: str | None
    ops: tuple[str, ...]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return finalize(self.build(Tables(spark, sf_dir)), self.spec)

    def oracle(self) -> str | None:
        return None if self.sql is None else wrap_sql(self.spec, self.sql)


class Tables(dict):
    """Lazy name -> DataFrame map over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def memo(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Build a derived frame once per job so every consumer shares the
        same logical subtree (identical exchanges are then reused)."""
        key = "__" + name
        if key not in self:
            dict.__setitem__(self, key, build())
        return dict.__getitem__(self, key)

    def __missing__(self, name):
        df = load_tables(self.spark, self.sf_dir, (name,))[name]
        self[name] = df
        return df


REGISTRY: dict[str, Query] = {}


def query(name: str, spec: str, sql: str | None = None, ops: tuple[str, ...] = ()):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, spec, sql, ops)
        return fn
    return deco


def cte(**parts: str) -> str:
    """``WITH a AS (...), b AS (...)`` from keyword snippets, in order."""
    return "WITH " + ",\n".join(f"{k} AS (\n{v}\n)" for k, v in parts.items())
