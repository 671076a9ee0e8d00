"""Declared facts compiled into one aggregate for each table, and the audit of published ones against them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fact:
    """A number that a table holds: name, table and an aggregate expression over its rows, in SQL."""

    name: str
    table: str
    expression: str

    def sql(self) -> str:
        return f"SELECT '{self.name}' AS name, CAST({self.expression} AS BIGINT) AS value FROM {self.table}"


def histogram(table: str, column: str, values: Iterable[str]) -> list[Fact]:
    """How many rows have each of the values, and how many any other or none; values have no quotes."""
    values = list(values)
    if any(c in v for v in values for c in "'\\"):
        raise ValueError("a value with a quote or backslash is no plain SQL text")
    other = f"count_if({column} IS NULL OR {column} NOT IN ({', '.join(repr(v) for v in values)}))"
    return [*(Fact(f"{table}.{column}.{v}", table, f"count_if({column} = '{v}')") for v in values), Fact(f"{table}.{column}.other", table, other)]


def measure(tables: dict[str, DataFrame], facts: Iterable[Fact]) -> DataFrame:
    """(name, value) of all facts: each table is read once, only in the columns that its facts name, and added up before
    anything is shuffled."""
    by_table: dict[str, list[Fact]] = {}
    for f in facts:
        by_table.setdefault(f.table, []).append(f)
    names = [f.name for fs in by_table.values() for f in fs]
    if len(names) != len(set(names)):
        raise ValueError("a fact is declared twice")

    def one(table: str, fs: list[Fact]) -> DataFrame:
        row = tables[table].agg(*(F.expr(f.expression).cast("long").alias(f"f{k}") for k, f in enumerate(fs)))
        return row.select(F.explode(F.array(*(F.struct(F.lit(f.name).alias("name"), F.col(f"f{k}").alias("value")) for k, f in enumerate(fs)))).alias("x")).select("x.*")

    return reduce(DataFrame.unionByName, (one(t, fs) for t, fs in by_table.items()))


def audit(published: DataFrame, measured: DataFrame, excluded: dict[str, str]) -> DataFrame:
    """(name, published, measured, status, reason) of every published fact: exact or differs where it was measured, else
    not_computable with the reason that the case gives, or that none was declared.  An excluded fact is never compared."""
    why = F.create_map(*(F.lit(x) for kv in excluded.items() for x in kv)) if excluded else F.lit(None).cast("map<string, string>")
    x = published.select("name", F.col("value").alias("published")).join(measured.select("name", F.col("value").alias("measured")), "name", "left")
    out = F.coalesce(F.try_element_at(why, "name"), F.when(F.col("measured").isNull(), "no computation declared"))
    status = F.when(out.isNotNull(), "not_computable").when(F.col("published") == F.col("measured"), "exact").otherwise("differs")
    return x.select("name", "published", F.when(out.isNull(), F.col("measured")).alias("measured"), status.alias("status"), out.alias("reason"))
