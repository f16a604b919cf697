"""Small array and map helpers shared by the operators."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def strings(col: Column) -> Column:
    """A string array column with NULL read as empty."""
    return F.coalesce(col, empty_strings())


def ordered_union(*arrays: Column) -> Column:
    """Distinct values of several arrays in order of first appearance."""
    return F.array_distinct(F.concat(*[strings(a) for a in arrays]))


def first_of(values: Column, limit: int | None) -> Column:
    """The first ``limit`` values; None keeps all."""
    return values if limit is None else F.slice(values, 1, limit)


def has_any(col: Column) -> Column:
    return F.size(strings(col)) > 0


def clean_metrics(metrics: Column) -> Column:
    """Keep metrics that read as a number above zero."""
    numeric = F.transform_values(metrics, lambda _, v: v.try_cast("double"))
    return F.map_filter(numeric, lambda _, v: v > 0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def constant(value, schema: str) -> Column:
    """Python data as one constant of the plan.

    A JSON literal is folded once by the optimizer; a tree of literals would be analysed again
    by every following DataFrame call.
    """
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), schema)


def literal_map(table: Mapping[str, str]) -> Column:
    """A small string map as a constant."""
    return constant(dict(table), "map<string,string>")


def literal_strings(values: Iterable[str]) -> Column:
    return constant(list(values), "array<string>")


def computed(df: DataFrame, row: Column, names: Iterable[str]) -> DataFrame:
    """Add the fields of a struct column, evaluated exactly once per row.

    Filters over plain projected columns are pushed below the projection, which repeats the
    expressions behind them. A generated row is a boundary they do not cross.
    """
    names = list(names)
    return df.select(*[c for c in df.columns if c not in names], F.inline(F.array(row)))
