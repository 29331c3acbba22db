"""Derivations from a cursor's tokens, as higher-order functions over the token array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_token(tokens: Column, token: str) -> Column:
    return F.coalesce(F.array_contains(tokens, token), F.lit(False))


def storage_class(label: Column, tokens: Column, declared: Column) -> Column:
    """Fields have none; thread_local comes before what is declared."""
    known = F.lower(declared).isin("static", "extern", "auto", "register")
    return F.when(label == "Field", "none").when(has_token(tokens, "thread_local"), "thread_local").when(known, F.lower(declared)).otherwise("none")


def default_value(tokens: Column) -> Column:
    """The tokens after the first '=', joined by spaces; '' without one."""
    at = F.coalesce(F.array_position(tokens, "="), F.lit(0)).cast("int")
    rest = F.slice(tokens, at + 1, F.greatest(F.size(tokens) - at, F.lit(0)))
    return F.when(at > 0, F.trim(F.array_join(rest, " "))).otherwise("")


def trailing_volatile(tokens: Column) -> Column:
    """Whether 'volatile' stands between the parenthesis that closes the parameters and the body, initialiser or return type."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit("before").alias("state"), F.lit(False).alias("found"))

    def step(a: Column, t: Column) -> Column:
        depth = F.when(a["state"] == "before", a["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)).otherwise(a["depth"])
        closes = (a["state"] == "before") & (t == ")") & (depth == 0)
        ends = (a["state"] == "after") & t.isin("{", ";", "=", "->")
        state = F.when(closes, "after").when(ends, "done").otherwise(a["state"])
        return F.struct(depth.alias("depth"), state.alias("state"), (a["found"] | ((a["state"] == "after") & (t == "volatile"))).alias("found"))

    return F.coalesce(F.aggregate(tokens, zero, step, lambda a: a["found"]), F.lit(False))


def cv_qualifiers(is_const: Column, tokens: Column) -> Column:
    return F.concat_ws(" ", F.when(F.coalesce(is_const, F.lit(False)), "const"), F.when(trailing_volatile(tokens), "volatile"))


def is_noexcept(specification: Column) -> Column:
    return F.coalesce(F.upper(specification).isin("BASIC_NOEXCEPT", "COMPUTED_NOEXCEPT", "DYNAMIC_NONE"), F.lit(False))


def macro_value(tokens: Column) -> Column:
    """The tokens after the name."""
    return F.coalesce(F.array_join(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), " "), F.lit(""))
