"""Filters that the Python data sources answer themselves: ``(column, operator, value)``, all of which must hold.

They go to a source as an option, not by Spark's filter push-down: Spark 4.1.2
keeps one set of pushed filters per loaded DataFrame, so a second query or a
second branch over it gets the rows of the other's filters.
"""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.compute as pc

_COMPARE = {"=": pc.equal, "<>": pc.not_equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}
_TEXT = {"starts with": pc.starts_with, "ends with": pc.ends_with, "contains": pc.match_substring}
OPERATORS = (*_COMPARE, *_TEXT, "in", "not in", "is null", "is not null")


def packed(where, columns=None) -> str:
    """The filters as an option's text; ValueError for an operator or column that is unknown, or a value no filter can hold."""
    for column, operator, value in where:
        if operator not in OPERATORS or (columns is not None and column not in columns):
            raise ValueError(f"no such filter: {column} {operator}")
        values = value if operator in ("in", "not in") else [value]
        if not operator.startswith("is ") and any(v is None or v != v for v in values):
            raise ValueError(f"a filter's value is null or not a number: {column} {operator}")
    return json.dumps([list(f) for f in where])


def unpacked(options) -> list[tuple]:
    return [tuple(f) for f in json.loads(options.get("where", "[]"))]


def holds(operator: str, value, cells: pa.Array) -> pa.Array:
    """Answer for every cell, null where SQL has null; texts compare by bytes, as Spark's do."""
    if operator == "is null":
        return pc.is_null(cells)
    if operator == "is not null":
        return pc.is_valid(cells)
    if operator in _TEXT:
        return _TEXT[operator](cells, value)
    if operator in _COMPARE:
        return _COMPARE[operator](cells, pa.scalar(value, cells.type))
    found = pc.is_in(cells, pa.array(list(value), cells.type))
    return pc.if_else(pc.is_null(cells), pa.scalar(None, pa.bool_()), found if operator == "in" else pc.invert(found))


def keep(where, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch's rows for which every filter is true."""
    for column, operator, value in where:
        batch = batch.filter(pc.fill_null(holds(operator, value, batch.column(column)), False))
    return batch


def tests_of(where, column: str, kind: pa.DataType) -> list:
    """The filters on ``column`` as tests of one value, true only where SQL says true."""

    def test(operator, value):
        if operator in (">", ">=", "<", "<="):  # the usual ones of times, without an array a value
            compare = {">": float.__gt__, ">=": float.__ge__, "<": float.__lt__, "<=": float.__le__}[operator]
            if pa.types.is_floating(kind):
                bound = float(value)
                return lambda v: v is not None and compare(v, bound)
        return lambda v: holds(operator, value, pa.array([v], kind))[0].as_py() is True

    return [test(o, v) for c, o, v in where if c == column]
