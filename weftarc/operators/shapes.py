"""Documents held against a declared shape: every fault with its path, by one expression that is made from the shape.

A shape says which keys an object has and what is behind each: texts (any, of a list or a pattern), numbers, flags, lists (whose items may
carry their number) and objects, with values that must be what the rest of the object gives. From it a tree of built-in
functions over VARIANT values is made, so a table is gone through once, in the row, and nothing is read by Python.

Edge cases: what is no JSON has the one fault not-json at $; a null document is no JSON. Null is a fault where a shape does not
allow it. An object in the place of a list, or the other way round, has that one fault; what is in it is not looked at. Keys that come
twice are no JSON to Spark. Paths are written as $.key[3].key, counted from 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAULT = "array<struct<path: string, fault: string>>"


@dataclass(frozen=True)
class Text:
    choices: tuple[str, ...] = ()
    pattern: str | None = None
    nullable: bool = False


@dataclass(frozen=True)
class Number:
    least: float | None = None
    most: float | None = None
    whole: bool = True
    nullable: bool = False


@dataclass(frozen=True)
class Flag:
    nullable: bool = False


@dataclass(frozen=True)
class Items:
    """A list; ``numbered`` is the key of its items that must count them from 1."""

    of: Shape
    numbered: str | None = None
    nullable: bool = False


@dataclass(frozen=True)
class Object:
    """``keys`` must all be there but for ``optional`` ones, and no others. ``given``: keys whose value must be the number that a function
    of the object's map (string to VARIANT) says."""

    keys: dict[str, Shape]
    optional: frozenset[str] = frozenset()
    given: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    nullable: bool = False


Shape = Text | Number | Flag | Items | Object
_NUMBERS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


def _fault(path: Column, kind: str, when: Column) -> Column:
    """One fault if ``when`` holds, else none."""
    return F.when(F.coalesce(when, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(kind).alias("fault")))).otherwise(F.array().cast(FAULT))


def number(v: Column, key: str = "$") -> Column:
    return F.try_variant_get(v, key, "double")


def size(v: Column) -> Column:
    """How many items a list has; 0 if it is none."""
    return F.coalesce(F.size(v.try_cast("array<variant>")), F.lit(0))


def faults_of(v: Column, shape: Shape, path: Column) -> Column:
    """array<struct<path, fault>> of a VARIANT value."""
    kind = F.schema_of_variant(v)
    none = v.isNull() | (kind == "VOID")
    if isinstance(shape, Text):
        text = F.try_variant_get(v, "$", "string")
        bad = F.when(kind != "STRING", "not-a-text")
        if shape.choices:
            bad = bad.when(~text.isin(*shape.choices), "not-a-choice")
        if shape.pattern is not None:
            bad = bad.when(~text.rlike(shape.pattern), "not-of-the-pattern")
        found = F.when(bad.isNotNull(), F.array(F.struct(path.alias("path"), bad.alias("fault")))).otherwise(F.array().cast(FAULT))
    elif isinstance(shape, Number):
        n = number(v)
        out = F.lit(False)
        if shape.least is not None:
            out = out | (n < shape.least)
        if shape.most is not None:
            out = out | (n > shape.most)
        bad = F.when(~kind.rlike(_NUMBERS), "not-a-number").when(F.lit(shape.whole) & (n != F.floor(n)), "not-whole").when(out, "out-of-range")
        found = F.when(bad.isNotNull(), F.array(F.struct(path.alias("path"), bad.alias("fault")))).otherwise(F.array().cast(FAULT))
    elif isinstance(shape, Flag):
        found = _fault(path, "not-a-flag", kind != "BOOLEAN")
    elif isinstance(shape, Items):
        items = v.try_cast("array<variant>")
        at = lambda k: F.concat(path, F.lit("["), k.cast("string"), F.lit("]"))
        inside = F.flatten(F.transform(items, lambda x, k: faults_of(x, shape.of, at(k))))
        if shape.numbered:
            counted = lambda x, k: _fault(F.concat(at(k), F.lit(f".{shape.numbered}")), "not-dense", F.coalesce(number(x, f"$.{shape.numbered}") != k + 1, F.lit(False)))
            inside = F.concat(inside, F.flatten(F.transform(items, counted)))
        found = F.when(items.isNull(), F.array(F.struct(path.alias("path"), F.lit("not-a-list").alias("fault")))).otherwise(inside)
    else:
        m = v.try_cast("map<string, variant>")
        keys = F.map_keys(m)
        below = lambda key: F.concat(path, F.lit(f".{key}"))
        unknown = F.transform(F.filter(keys, lambda k: ~k.isin(*shape.keys)), lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.lit("unknown-key").alias("fault")))
        parts = [unknown]
        for key, of in shape.keys.items():
            there = F.array_contains(keys, key)
            absent = F.array().cast(FAULT) if key in shape.optional else F.array(F.struct(below(key).alias("path"), F.lit("missing").alias("fault")))
            parts.append(F.when(there, faults_of(F.try_element_at(m, F.lit(key)), of, below(key))).otherwise(absent))
        for key, rule in shape.given.items():
            parts.append(_fault(below(key), "differs", F.array_contains(keys, key) & (number(F.try_element_at(m, F.lit(key))) != rule(m))))
        found = F.when(m.isNull(), F.array(F.struct(path.alias("path"), F.lit("not-an-object").alias("fault")))).otherwise(F.concat(*parts))
    return F.when(none, F.array().cast(FAULT) if shape.nullable else F.array(F.struct(path.alias("path"), F.lit("null").alias("fault")))).otherwise(found)


def shape_faults(documents: DataFrame, shape: Shape, column: str) -> DataFrame:
    """``documents`` without ``column`` (JSON), with path and fault: a row for each fault of each document."""
    rest = [F.col(f"`{c}`") for c in documents.columns if c != column]
    value = F.try_parse_json(F.col(f"`{column}`"))
    found = F.when(value.isNull(), F.array(F.struct(F.lit("$").alias("path"), F.lit("not-json").alias("fault")))).otherwise(faults_of(value, shape, F.lit("$")))
    return documents.select(*rest, F.inline(found))


#: A manifest of saved resources as ``packages`` writes it, in its numbers and choices.
MANIFEST = Object(
    {
        "version": Number(1, 1), "total_bytes": Number(0), "count": Number(0),
        "resources": Items(Object({"ordinal": Number(1), "path": Text(pattern=r"^(?!/)(?!.*//).+$"), "type": Text(("document", "image", "script")), "bytes": Number(0, nullable=True), "cached": Flag()}, optional=frozenset({"cached"})), numbered="ordinal"),
    },
    given={
        "count": lambda m: size(F.try_element_at(m, F.lit("resources"))),
        "total_bytes": lambda m: F.aggregate(F.coalesce(F.try_element_at(m, F.lit("resources")).try_cast("array<variant>"), F.array().cast("array<variant>")), F.lit(0.0), lambda a, r: a + F.coalesce(number(r, "$.bytes"), F.lit(0.0))),
    },
)
