"""Expressions built as text: one parse instead of one driver call per element.

A wide table has thousands of aggregates, so the cost of building the plan counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def double_text(x: float) -> str:
    x = float(x)
    if x != x or x in (float("inf"), float("-inf")):
        return f"double('{x}')"
    return f"{x!r}D"


def _array(items: Iterable[str], kind: str) -> str:
    inside = ",".join(items)
    return f"array({inside})" if inside else f"cast(array() as array<{kind}>)"


def double_array(xs: Sequence[float]) -> Column:
    return F.expr(_array((double_text(x) for x in xs), "double"))


def double_matrix(rows: Sequence[Sequence[float]]) -> Column:
    return F.expr(_array((_array((double_text(x) for x in r), "double") for r in rows), "array<double>"))


def int_array(xs: Sequence[int]) -> Column:
    return F.expr(_array((str(int(x)) for x in xs), "int"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rows_from(columns: Sequence[str], fields: dict[str, str], label: str = "feature") -> Column:
    """One output row per column, its fields taken from aggregates named ``<prefix><i>``."""
    rows = (
        f"named_struct('{label}', {text(c)}, " + ", ".join(f"'{name}', {p}{i}" for name, p in fields.items()) + ")"
        for i, c in enumerate(columns)
    )
    return F.expr(f"inline(array({', '.join(rows)}))")
