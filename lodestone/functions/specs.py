"""Search in nested specification objects kept as JSON text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import focal_length, horizontal_fov, json_map

# The keys of each summary field, and the words that mark a combined text.
RESOLUTION_KEYS = ["max resolution", "max. resolution", "resolution", "video resolution"]
LENS_KEYS = ["focal length", "lens", "focal length & fov"]
FOV_KEYS = ["horizontal field of view", "horizontal fov", "fov", "field of view", "focal length & fov"]
COMBINED = ["focal length", "field of view", "vertical", "diagonal"]


def _matches(key: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | F.lower(key).contains(p.lower())
    return found


def _first(entries: Column, patterns: list[str]) -> Column:
    return F.get(F.filter(entries, lambda e: _matches(e["key"], patterns)), 0)["value"]


def _once(value: Column, use) -> Column:
    """use(value), with value computed a single time however often it is used."""
    return F.transform(F.array(value), use)[0]


def find_value(specs: Column, patterns: list[str]) -> Column:
    """Value of the first key, in document order, that contains a pattern, in objects of up to two levels.

    A key that matches at the top decides: its scalar, or the first match inside its object, or nothing.
    Only without one are the objects below searched in turn. Empty values found below are passed over.
    """
    return _once(F.map_entries(json_map(specs)), lambda top: _search(top, patterns))


def _search(top: Column, patterns: list[str]) -> Column:
    """find_value() in the entries of an object, parsed already."""
    inner = lambda text: _first(F.map_entries(json_map(text)), patterns)
    is_object = lambda text: F.ltrim(F.coalesce(text, F.lit(""))).startswith("{")
    below = F.filter(F.transform(F.filter(top, lambda e: is_object(e["value"])), lambda e: inner(e["value"])), lambda v: F.coalesce(v, F.lit("")) != "")
    decided = lambda hit: F.when(hit.isNotNull(), F.when(is_object(hit["value"]), _once(inner(hit["value"]), lambda v: F.nullif(v, F.lit("")))).otherwise(hit["value"])).otherwise(F.get(below, 0))
    return _once(F.get(F.filter(top, lambda e: _matches(e["key"], patterns)), 0), decided)


def deep_search(node, patterns: list[str]) -> str | None:
    """The same for objects of any depth."""
    if not isinstance(node, dict):
        return None
    for key, value in node.items():
        if any(p in key.lower() for p in patterns):
            return (deep_search(value, patterns) or None) if isinstance(value, dict) else str(value)
    return next(filter(None, (deep_search(v, patterns) for v in node.values())), None)


def find_value_deep(specs: Column, patterns: list[str]) -> Column:
    lowered = [p.lower() for p in patterns]

    @F.pandas_udf(T.StringType())
    def search(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return deep_search(json.loads(text), lowered) if text else None
            except (ValueError, RecursionError):
                return None

        return texts.map(one)

    return search(specs)


def summary(specs: Column, find=None) -> Column:
    """struct(max_resolution, lens, horizontal_fov), null for an empty object; combined texts are taken apart. The
    text is parsed once, but by find (such as find_value_deep) where one is given."""
    def found(top: Column) -> Column:
        search = (lambda keys: find(specs, keys)) if find else (lambda keys: _search(top, keys))
        fields = F.struct(search(RESOLUTION_KEYS).alias("max_resolution"), search(LENS_KEYS).alias("lens"), search(FOV_KEYS).alias("fov"))
        return F.when(F.size(top) > 0, _once(fields, _taken_apart))

    return _once(F.map_entries(json_map(specs)), found) if find is None else found(F.map_entries(json_map(specs)))


def _taken_apart(fields: Column) -> Column:
    lens, fov = fields["lens"], fields["fov"]
    lens = F.when(F.lower(lens).contains("fov"), F.coalesce(focal_length(lens), lens)).otherwise(lens)
    combined = F.lit(False)
    for word in COMBINED:
        combined = combined | F.lower(fov).contains(word)
    fov = F.when(combined, horizontal_fov(fov)).otherwise(fov)
    return F.struct(fields["max_resolution"].alias("max_resolution"), lens.alias("lens"), fov.alias("horizontal_fov"))
