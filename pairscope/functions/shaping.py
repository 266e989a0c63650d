"""Output contracts: a query's columns and types in one short text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def parse(spec: str) -> list[tuple[str, str]]:
    """``"rna_id:s tp:i f1:d"`` -> [(name, kind)]; kinds are s, i, d (9 decimals), m (6 decimals)."""
    return [tuple(item.split(":")) for item in spec.split()]


def shape(df: DataFrame, spec: str) -> DataFrame:
    """Select and cast to the contract, so results compare by value everywhere."""
    columns = []
    for name, kind in parse(spec):
        column = F.col(name)
        if kind == "i":
            column = column.cast("bigint")
        elif kind == "d":
            column = F.round(column.cast("double"), 9) + F.lit(0.0)
        elif kind == "m":
            column = F.round(column.cast("double"), 6) + F.lit(0.0)
        else:
            column = column.cast("string")
        columns.append(column.alias(name))
    return df.select(*columns)


def shape_sql(body: str, spec: str) -> str:
    """The same contract around a SQL text."""
    parts = []
    for name, kind in parse(spec):
        if kind == "i":
            parts.append(f"CAST({name} AS BIGINT) AS {name}")
        elif kind == "d":
            parts.append(f"ROUND(CAST({name} AS DOUBLE), 9) + 0.0::DOUBLE AS {name}")
        elif kind == "m":
            parts.append(f"ROUND(CAST({name} AS DOUBLE), 6) + 0.0::DOUBLE AS {name}")
        else:
            parts.append(f"CAST({name} AS VARCHAR) AS {name}")
    return f"SELECT {', '.join(parts)} FROM ({body}) shaped"


def computed_once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Add a column that later steps read as a value.

    Catalyst may copy a projected expression into every place that reads it, even into a lambda that runs
    per array element. Exploding a repeat of one (which the optimizer does not undo) keeps an expensive text or array expression evaluated once per row.
    """
    return df.select("*", F.explode(F.array_repeat(column, F.lit(1))).alias(name))
