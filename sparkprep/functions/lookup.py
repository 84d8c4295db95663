"""Small constant tables as map literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, dict):
        return "named_struct(" + ", ".join(f"'{k}', {sql_literal(v)}" for k, v in value.items()) + ")"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(sql_literal, value))})"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def literal_map(pairs: dict) -> Column:
    return F.expr("map(" + ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in pairs.items()) + ")")
