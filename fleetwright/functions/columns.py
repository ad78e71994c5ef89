"""Helpers that hand SQL expression texts to DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame


def derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add or replace columns; expressions may use columns named earlier in the same dict
    unless the input already has a column of that name."""
    replaced = [name for name in df.columns if name in columns]
    star = f"* EXCEPT ({', '.join(replaced)})" if replaced else "*"
    return df.selectExpr(star, *[f"{expr} AS {name}" for name, expr in columns.items()])


def aggregate(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Grouped aggregation stated as one query text, for long column lists."""
    named = ", ".join([*keys, *[f"{expr} AS {name}" for name, expr in columns.items()]])
    return df.sparkSession.sql(f"SELECT {named} FROM {{rows}} GROUP BY {', '.join(keys)}", rows=df)


def record(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {expr}" for name, expr in fields.items()) + ")"


def records(rows: list[dict[str, str]]) -> str:
    return "array(" + ", ".join(record(row) for row in rows) + ")"


def open_rows(df: DataFrame, owner: list[str], rows: str) -> DataFrame:
    """One output row per array element, with its position and the element's fields."""
    return df.selectExpr(*owner, f"posexplode({rows}) AS (pos, _row)").selectExpr(
        *[name.split(" AS ")[-1] for name in owner], "pos", "_row.*")
