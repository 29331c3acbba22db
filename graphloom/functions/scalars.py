"""Property values. Properties are a map from name to the value's JSON text, so a value keeps its JSON type.

A filter compares as Python compares scalars: true = 1 = 1.0, but never "1" = 1; null matches a missing property.
"""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER = r"^-?[0-9]+$"


def json_text(value: Column) -> Column:
    """JSON text of a scalar column."""
    return F.regexp_extract(F.to_json(F.array(value), {"ignoreNullFields": "false"}), r"(?s)^\[(.*)\]$", 1)


def properties(**values: Column) -> Column:
    """A property map; null values are left out, like properties that were never set."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.when(v.isNotNull(), json_text(v)).alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def nested_text(value: Column) -> Column:
    """JSON text, with sorted keys, of a map; it is stored as one string value."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value))))


def as_string(text: Column) -> Column:
    """The string that a JSON text stands for (null for other values)."""
    return F.when(text.startswith('"'), F.get_json_object(F.concat(F.lit("["), text, F.lit("]")), "$[0]"))


def equals(text: Column, value: object) -> Column:
    """Whether a property with this JSON text (null: missing) equals the Python scalar; never null."""
    if value is None:
        return text.isNull() | (text == "null")
    if isinstance(value, str):
        return F.coalesce(as_string(text) == value, F.lit(False))
    truth = F.lit(False)
    if value == 1 or value == 0:
        truth = text == ("true" if value == 1 else "false")
    number = Decimal(int(value)) if isinstance(value, bool | int) else Decimal(repr(value)) if value == value and abs(value) != float("inf") else None
    if number is None:
        return F.lit(False)
    whole = number == number.to_integral_value() and abs(number) < Decimal(10) ** 38
    is_integer = text.rlike(INTEGER)
    same_integer = F.coalesce(text.try_cast("decimal(38,0)") == F.lit(int(number)).cast("decimal(38,0)"), F.lit(False)) if whole else F.lit(False)
    same_double = F.coalesce(text.try_cast("double") == F.lit(float(number)), F.lit(False)) & ~text.startswith('"')
    return F.coalesce(truth | F.when(is_integer, same_integer).otherwise(same_double), F.lit(False))


# Comparison of properties as graph query languages have it: three truth values, kinds that don't mix.


def json_of(value: Column | object) -> Column:
    """A property's JSON text as it is, or that of a Python scalar."""
    return value if isinstance(value, Column) else F.lit(None if value is None else json.dumps(value)).cast("string")


def present(text: Column) -> Column:
    return text.isNotNull() & (text != "null")


def number(text: Column) -> Column:
    """The number that a JSON text stands for (null for other values)."""
    return F.when(text.rlike(r"^-?[0-9]"), text.try_cast("double"))


def same(a: Column | object, b: Column | object) -> Column:
    """a = b: null if either is missing, false for values of different kinds ("1" isn't 1, true isn't 1)."""
    a, b = json_of(a), json_of(b)
    whole = a.rlike(INTEGER) & b.rlike(INTEGER)
    numbers = F.when(whole, a.try_cast("decimal(38,0)") == b.try_cast("decimal(38,0)")).otherwise(number(a) == number(b))
    equal = F.when(a.startswith('"') & b.startswith('"'), as_string(a) == as_string(b)).when(number(a).isNotNull() & number(b).isNotNull(), numbers).otherwise(a == b)
    return F.when(present(a) & present(b), equal)


def less(a: Column | object, b: Column | object, or_equal: bool = False) -> Column:
    """a < b (or <=): of numbers, strings or truth values; null if either is missing or they are of different kinds."""
    a, b = json_of(a), json_of(b)
    how = (lambda x, y: x <= y) if or_equal else (lambda x, y: x < y)
    truth = lambda x: F.when(x == "true", 1).when(x == "false", 0)
    return F.when(present(a) & present(b), F.coalesce(how(number(a), number(b)), how(as_string(a), as_string(b)), how(truth(a), truth(b))))


def sort_key(text: Column) -> Column:
    """Orders properties: strings, then false, true, then numbers by value; missing ones last (ascending)."""
    kind = F.when(~present(text) | text.isNull(), 4).when(text.startswith('"'), 1).when(text.isin("true", "false"), 2).otherwise(3)
    return F.struct(kind.alias("kind"), number(text).alias("number"), F.coalesce(as_string(text), text).alias("text"))


def greatest_of(text: Column) -> Column:
    """Aggregate: the largest property, as JSON text; missing ones don't count."""
    return F.max_by(text, F.when(present(text), sort_key(text)))


def least_of(text: Column) -> Column:
    return F.min_by(text, F.when(present(text), sort_key(text)))


def shown(text: Column) -> Column:
    """A property as text: strings without quotes, other values as JSON has them, null if missing."""
    return F.when(present(text), F.coalesce(as_string(text), text))
