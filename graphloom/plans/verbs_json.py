"""The JSON form of the verbs: {"query": verb, "args": {...}}, checked before anything is planned."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..errors import GraphError
from ..model import EDGE_KEY, Graph
from ..operators import verbs

NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
#: Verb: (needed arguments, optional ones).
VERBS = {
    "all_vertices": (set(), set()), "all_edges": (set(), set()), "vertex_with_type": ({"t"}, set()), "edge_with_type": ({"t"}, set()),
    "vertex_with_property_equal": ({"name", "value"}, set()), "edge_with_property_equal": ({"name", "value"}, set()), "pipe": ({"vertex_id", "direction"}, {"t"}),
}


def refuse(message: str, code: str = "QUERY_PARSE_ERROR") -> GraphError:
    return GraphError(code, message)


@dataclass(frozen=True)
class Verb:
    name: str
    args: dict = field(default_factory=dict)


def parse(text: str) -> Verb:
    """The verb with its arguments made uniform; errors say whether the text can't be read or isn't supported."""
    try:
        body = json.loads(text)
    except ValueError as e:
        raise refuse(f"not JSON: {e}") from e
    if not isinstance(body, dict):
        raise refuse("the query must be a JSON object")
    name, args = body.get("query"), body.get("args", {})
    if not isinstance(args, dict):
        raise refuse("args must be an object")
    if not isinstance(name, str) or name not in VERBS:
        raise refuse(f"unknown verb {name!r}", "QUERY_UNSUPPORTED")
    needed, optional = VERBS[name]
    if missing := needed - set(args):
        raise refuse(f"missing arguments: {sorted(missing)}")
    if extra := set(args) - needed - optional:
        raise refuse(f"unknown arguments: {sorted(extra)}")
    out = dict(args)
    if "t" in out and not (isinstance(out["t"], str) and NAME.match(out["t"])):
        raise refuse("t must be a type name")
    if "name" in out and not isinstance(out["name"], str):
        raise refuse("name must be a string")
    if "value" in out and not isinstance(out["value"], str | int | float | bool | None):
        raise refuse("value must be a JSON scalar")
    if "vertex_id" in out:
        try:
            out["vertex_id"] = str(uuid.UUID(out["vertex_id"]))
        except (ValueError, AttributeError, TypeError) as e:
            raise refuse("vertex_id must be a UUID") from e
    if "direction" in out and out["direction"] not in (verbs.OUTBOUND, verbs.INBOUND):
        raise refuse("direction must be outbound or inbound")
    return Verb(name, out)


@F.pandas_udf(StringType())
def code_of(texts: pd.Series) -> pd.Series:
    """Each text's error code as parse() has it; the empty text if there is none."""

    def code(text: str | None) -> str:
        try:
            parse(text or "")
        except GraphError as e:
            return e.code
        return ""

    return texts.map(code)


def plan(verb: Verb, g: Graph, limit: int | None = None) -> DataFrame:
    return getattr(verbs, verb.name)(g, **verb.args, limit=limit)


def order_of(verb: Verb) -> tuple[str, ...]:
    return EDGE_KEY if "edge" in verb.name else ("id",)
