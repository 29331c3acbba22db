"""Running a query for an answer: row limit with a truncation flag, timeout, JSON-ready rows."""

from __future__ import annotations

import datetime
import decimal
import json
import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Row, SparkSession

from ..config import Settings, clamped
from ..errors import GraphError
from ..model import Graph
from . import guard, verbs_json
from ..operators import verbs


@dataclass
class Answer:
    rows: list[dict]
    rows_returned: int
    truncated: bool
    ms: int
    request_id: str


def plain(value: object) -> object:
    """A value as JSON has it; times become strings. Of vertices and edges (patterns.as_node, as_relationship), the properties
    become values beside _id, _labels or _type, _start, _end."""
    if isinstance(value, Row):
        out = {k: plain(v) for k, v in value.asDict().items()}
        if {"_labels", "props"} <= set(out) or {"_type", "props"} <= set(out):
            out |= {k: json.loads(v) for k, v in (out.pop("props") or {}).items()}
        return out
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    if isinstance(value, datetime.datetime | datetime.date | datetime.timedelta | decimal.Decimal):
        return str(value)
    if isinstance(value, bytes | bytearray):
        return value.hex()
    return value


def graph_row(row: Row) -> dict:
    """A vertex or edge row: properties under that name, their JSON texts read."""
    out = plain(row)
    if isinstance(props := out.pop("props", None), dict):
        out["properties"] = {k: json.loads(v) for k, v in props.items()}
    out.pop("usr", None)
    return out


def within(spark: SparkSession, seconds: int, action):
    """action(), with its jobs cancelled if it takes longer."""
    group, late = f"query-{uuid.uuid4().hex}", threading.Event()
    spark.sparkContext.addJobTag(group)

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(group)

    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        return action()
    except Exception as e:
        if late.is_set():
            raise GraphError("QUERY_TIMEOUT", f"the query took more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(group)


def answer(df: DataFrame, limit: object = None, timeout: object = None, settings: Settings = Settings(), shape=plain, more=None) -> Answer:
    """The first rows and whether there are more; one row beyond the limit is fetched to know."""
    n, began = clamped(limit, settings.row_limit, 1, 500), time.time()

    def run() -> tuple[list[Row], bool]:
        rows = df.limit(n + 1).collect()
        return rows[:n], len(rows) > n if more is None else more(n, min(len(rows), n))

    rows, truncated = within(df.sparkSession, clamped(timeout, settings.timeout_s, 1, 120), run)
    return Answer([shape(r) for r in rows], len(rows), truncated, round(1000 * (time.time() - began)), str(uuid.uuid4()))


def run_json(g: Graph, text: str, limit: object = None, timeout: object = None, settings: Settings = Settings()) -> Answer:
    """A JSON verb over the graph. Of a pipe, the limit is on edges, and edges without a stored neighbour count as rows left out."""
    verb = verbs_json.parse(text)
    n = clamped(limit, settings.row_limit, 1, 500)
    if verb.name == "pipe":
        seen = Observation()
        df = verbs.pipe(g, **verb.args, limit=n, seen=seen)

        def more(_: int, got: int) -> bool:
            # a plan that found the vertices empty needn't have read the edges
            edges = seen.get.get("n")
            return got < (verbs.pipe_edges(g, **verb.args).count() if edges is None else edges)

        return answer(df.orderBy("id"), n, timeout, settings, graph_row, more)
    return answer(verbs_json.plan(verb, g, n + 1), n, timeout, settings, graph_row)


def run_sql(spark: SparkSession, text: str, args: dict | list | None = None, limit: object = None, timeout: object = None, settings: Settings = Settings()) -> Answer:
    return answer(guard.read_only_sql(spark, text, args), limit, timeout, settings)


def register_views(g: Graph) -> None:
    """The graph as views for SQL: vertices and edges."""
    g.vertices.createOrReplaceTempView("vertices")
    g.edges.createOrReplaceTempView("edges")
