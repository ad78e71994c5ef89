"""Compare a Spark query with its SQL twin, row by row and type family by type family."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v + 0.0 if isinstance(v, float) else v


def _family(name: str) -> str:
    name = name.lower()
    for family, words in {"bool": ("bool",), "float": ("double", "float"),
                          "int": ("bigint", "int", "long", "hugeint"),
                          "text": ("string", "varchar"), "time": ("timestamp",)}.items():
        if any(name.startswith(w) for w in words):
            return family
    return name


def differences(spark_df, con, sql: str) -> list[str]:
    relation = con.sql(sql)
    out = []
    left, right = sorted(spark_df.columns), sorted(relation.columns)
    if left != right:
        return [f"columns {set(left) ^ set(right)}"]
    ours = {f.name: _family(f.dataType.simpleString()) for f in spark_df.schema}
    theirs = {n: _family(str(t)) for n, t in zip(relation.columns, relation.types, strict=True)}
    for name in left:
        if ours[name] != theirs[name] and theirs[name] != '"null"':
            out.append(f"type of {name}: {ours[name]} / {theirs[name]}")
    a = Counter(tuple(_cell(r[n]) for n in left) for r in spark_df.collect())
    order = [relation.columns.index(n) for n in left]
    b = Counter(tuple(_cell(r[i]) for i in order) for r in relation.fetchall())
    if sum(a.values()) != sum(b.values()):
        out.append(f"rows {sum(a.values())} / {sum(b.values())}")
    only_a, only_b = a - b, b - a
    if only_a or only_b:
        out.append(f"{sum(only_a.values())} / {sum(only_b.values())} rows differ of {sum(a.values())}")
        pair = sorted(only_a, key=repr)[:1] + sorted(only_b, key=repr)[:1]
        out += [str(dict(zip(left, row, strict=True))) for row in pair]
    return out
