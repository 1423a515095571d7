"""Document-style metadata predicates compiled to two-valued Columns.

Every leaf is true or false, never null, so that negation means "not true":
a missing key fails ``$eq`` and passes ``$ne``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"
_RANGES: dict[str, Callable[[Column, float], Column]] = {
    "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v,
}


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


class JsonFields:
    """Fields are top-level keys of a JSON string or variant column; types are
    told apart strictly: 1, "1" and true all differ, 1 and 1.0 don't."""

    def __init__(self, column: Column, is_variant: bool = False) -> None:
        self.doc = column if is_variant else F.try_parse_json(column)

    def _value(self, name: str) -> Column:
        return F.try_variant_get(self.doc, "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']", "variant")

    def _as(self, name: str, kind: str) -> Column:
        return F.try_variant_get(self.doc, "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']", kind)

    def number(self, name: str) -> Column:
        return F.when(F.schema_of_variant(self._value(name)).rlike(_NUMERIC), self._as(name, "double"))

    def string(self, name: str) -> Column:
        return F.when(F.schema_of_variant(self._value(name)) == "STRING", self._as(name, "string"))

    def equals(self, name: str, value: Any) -> Column:
        if value is None:
            return _sure(F.is_variant_null(self._value(name)))
        if isinstance(value, bool):
            return _sure((F.schema_of_variant(self._value(name)) == "BOOLEAN") & (self._as(name, "boolean") == value))
        if isinstance(value, (int, float)):
            return _sure(self.number(name) == float(value))
        if isinstance(value, str):
            return _sure(self.string(name) == value)
        # Arrays and objects by their text; Spark writes keys in order.
        return _sure(F.to_json(self._value(name)) == json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False))


class ColumnFields:
    """Fields are typed columns, so that predicates reach the scan.  A null
    stands for a missing key; an unknown column is missing everywhere."""

    def __init__(self, df: DataFrame) -> None:
        self.kinds = {f.name: f.dataType for f in df.schema.fields}

    def number(self, name: str) -> Column:
        return F.col(f"`{name}`") if isinstance(self.kinds.get(name), T.NumericType) else F.lit(None).cast("double")

    def string(self, name: str) -> Column:
        return F.col(f"`{name}`") if isinstance(self.kinds.get(name), T.StringType) else F.lit(None).cast("string")

    def equals(self, name: str, value: Any) -> Column:
        kind = self.kinds.get(name)
        if value is None or kind is None:
            return F.lit(False)
        fits = isinstance(kind, T.BooleanType) if isinstance(value, bool) else isinstance(kind, T.NumericType) if isinstance(value, (int, float)) else isinstance(kind, T.StringType) and isinstance(value, str)
        return _sure(F.col(f"`{name}`") == F.lit(value)) if fits else F.lit(False)


Fields = JsonFields | ColumnFields


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True)) if len(parts) != 1 else parts[0]


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False)) if len(parts) != 1 else parts[0]


def _number(op: str, value: Any) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"{op} needs a number, not {value!r}")
    return float(value)


def _leaf(fields: Fields, name: str, op: str, value: Any) -> Column:
    if op == "$eq":
        return fields.equals(name, value)
    if op == "$ne":
        return ~fields.equals(name, value)
    if op in _RANGES:
        return _sure(_RANGES[op](fields.number(name), _number(op, value)))
    if op == "$in":
        if not isinstance(value, (list, tuple)):
            raise ValueError("$in needs a list")
        return _any([fields.equals(name, v) for v in value])
    if op == "$contains":
        if not isinstance(value, str):
            raise ValueError("$contains needs a string")
        return _sure(F.contains(fields.string(name), F.lit(value)))
    raise ValueError(f"unknown operator {op!r}")


def compile_filter(spec: Mapping[str, Any], fields: Fields, empty_matches: bool = False) -> Column:
    """The predicate of a filter document.  Several keys, and several operators
    on one key, must all hold, also beside ``$and``, ``$or`` and ``$not``.  An
    empty document is an error, or matches all with ``empty_matches``."""
    if not isinstance(spec, Mapping):
        raise ValueError("a filter is an object")
    if not spec:
        if empty_matches:
            return F.lit(True)
        raise ValueError("a filter must not be empty")
    parts: list[Column] = []
    for key, value in spec.items():
        if key in ("$and", "$or"):
            if not isinstance(value, (list, tuple)):
                raise ValueError(f"{key} needs a list")
            inner = [compile_filter(v, fields) for v in value]
            parts.append(_all(inner) if key == "$and" else _any(inner))
        elif key == "$not":
            parts.append(~compile_filter(value, fields))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key!r}")
        elif isinstance(value, Mapping) and any(k.startswith("$") for k in value):
            parts += [_leaf(fields, key, op, v) for op, v in value.items()]
        else:
            parts.append(fields.equals(key, value))
    return _all(parts)


def combine(*filters: Mapping[str, Any]) -> dict[str, Any]:
    """All of the filters."""
    flat: list[Mapping[str, Any]] = []
    for f in filters:
        flat += f["$and"] if set(f) == {"$and"} else [f]
    return {"$and": flat}


def from_triples(items: list[Mapping[str, Any]], condition: str = "and") -> dict[str, Any]:
    """Filters as integrations give them: key, operator name and value; an
    unknown operator means equality."""
    names = {"==": "$eq", "!=": "$ne", ">": "$gt", ">=": "$gte", "<": "$lt", "<=": "$lte", "in": "$in", "contains": "$contains", "eq": "$eq", "ne": "$ne", "gt": "$gt", "gte": "$gte", "lt": "$lt", "lte": "$lte"}
    made = [{i["key"]: {names.get(str(i.get("operator", "==")).lower(), "$eq"): i["value"]}} for i in items]
    return made[0] if len(made) == 1 else {"$or" if condition.lower() == "or" else "$and": made}
