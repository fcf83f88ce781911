"""Options and results as JSON with names in camel case, as web clients send and read them."""

from __future__ import annotations

import json
from dataclasses import fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import SearchOptions


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.capitalize() for x in rest)


def options_from_json(text: str) -> SearchOptions:
    """Fields that are absent keep their defaults, unknown ones are ignored; a wrong type is an error."""
    given, known = json.loads(text or "{}"), {}
    if not isinstance(given, dict):
        raise ValueError("search options must be an object")
    for f in fields(SearchOptions):
        if (name := camel(f.name)) in given:
            kind = int if f.type.startswith("int") else bool
            if given[name] is None and f.type.endswith("None"):
                pass
            elif type(given[name]) is not kind or (kind is int and given[name] < 0):
                raise ValueError(f"invalid search options: {name}")
            known[f.name] = given[name]
    return SearchOptions(**known)


def options_to_json(options: SearchOptions) -> str:
    return json.dumps({camel(f.name): getattr(options, f.name) for f in fields(options)}, separators=(",", ":"))


def _renamed(value: Column, kind) -> Column:
    if kind.typeName() == "struct":
        parts = [_renamed(value[f.name], f.dataType).alias(camel(f.name)) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*parts))
    if kind.typeName() == "array" and kind.elementType.typeName() == "struct":
        return F.transform(value, lambda x: _renamed(x, kind.elementType))
    return value


def results_to_json(results: DataFrame) -> DataFrame:
    """(json): each row of a result, its columns named in camel case; absent parts are left out."""
    parts = [_renamed(F.col(f.name), f.dataType).alias(camel(f.name)) for f in results.schema.fields]
    return results.select(F.to_json(F.struct(*parts)).alias("json"))
