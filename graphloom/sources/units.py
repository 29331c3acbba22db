"""What was extracted from each unit, kept from one ingestion to the next: only units that are new or have changed are extracted.

A manifest has a row for each unit: its path, build folder and options, by which it is known, and the length, modification time
and hash of its content, by which a change shows. A change join compares the units that are there now with the manifest. What is
extracted in one go is a generation of files; a unit's rows are those of its own generation, so what a changed or lost unit left
behind in older ones is simply not joined. Manifests are published as those of stores are: the second of two writers is refused.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from ..model import PROPS
from ..operators.extract import extract
from .manifest import Manifests

UNIT = "tu string, build string, options string, length long, modified timestamp, digest string, generation int"
NODES = f"tu string, t string, usr string, props {PROPS}, seq long"
EDGES = f"tu string, source_usr string, target_usr string, t string, props {PROPS}"
KEY = ("tu", "build", "options")
HIT, TOUCHED, CHANGED, NEW, GONE = "hit", "touched", "changed", "new", "gone"


def unit_rows(files: DataFrame) -> DataFrame:
    """files (tu, text, modified; build and flags if known) -> (tu, build, options, length, modified, digest): one row for each unit.

    Of rows that repeat a unit, the one modified last counts. Null texts count as empty, missing build folders as ''.
    """
    have = set(files.columns)
    text = F.coalesce(F.col("text"), F.lit(""))
    options = F.sha1(F.coalesce(F.to_json("flags"), F.lit("[]")).cast("binary")) if "flags" in have else F.sha1(F.lit("[]").cast("binary"))
    rows = files.select("tu", (F.coalesce("build", F.lit("")) if "build" in have else F.lit("")).alias("build"), options.alias("options"), F.octet_length(text).cast("long").alias("length"), "modified", F.sha2(text.cast("binary"), 256).alias("digest"))
    return rows.where("tu IS NOT NULL").groupBy(*KEY).agg(F.max(F.struct("modified", "length", "digest")).alias("r")).select(*KEY, "r.length", "r.modified", "r.digest")


def changes(known: DataFrame, now: DataFrame) -> DataFrame:
    """(tu, build, options, length, modified, digest, generation, state): all units of now, and those of known that are gone.

    hit: length and modification time are as they were; touched: they aren't, but the content is; changed, new, gone. generation is
    the one that holds what was extracted, null if there is none to use.
    """
    old = known.select(*KEY, *[F.col(c).alias(f"old_{c}") for c in ("length", "modified", "digest")], "generation", F.lit(True).alias("was"))
    both = now.withColumn("is", F.lit(True)).join(old, list(KEY), "full_outer")
    same = F.col("length").eqNullSafe(F.col("old_length")) & F.col("modified").eqNullSafe(F.col("old_modified"))
    state: Column = F.when(F.col("is").isNull(), GONE).when(F.col("was").isNull(), NEW).when(same, HIT).when(F.col("digest") == F.col("old_digest"), TOUCHED).otherwise(CHANGED)
    usable = F.when(state.isin(HIT, TOUCHED), F.col("generation"))
    # a hit's content wasn't looked at: the manifest keeps the hash that it had
    digest = F.when(same & F.col("was").isNotNull(), F.col("old_digest")).otherwise(F.col("digest"))
    return both.select(*KEY, "length", "modified", digest.alias("digest"), usable.alias("generation"), state.alias("state"))


@dataclass
class UnitManifest:
    version: int = 0
    units: str = ""
    generations: list[str] = field(default_factory=list)

    def dump(self) -> str:
        return json.dumps(asdict(self))


@dataclass
class Refreshed:
    """nodes and edges of all units, and how many units were in which state."""

    nodes: DataFrame
    edges: DataFrame
    counts: dict[str, int]

    @property
    def hits(self) -> int:
        return self.counts.get(HIT, 0) + self.counts.get(TOUCHED, 0)

    @property
    def misses(self) -> int:
        return self.counts.get(NEW, 0) + self.counts.get(CHANGED, 0)

    @property
    def evictions(self) -> int:
        return self.counts.get(CHANGED, 0) + self.counts.get(GONE, 0)


class UnitCache:
    def __init__(self, spark: SparkSession, url: str):
        self.spark, self.url = spark, url.rstrip("/")
        self.manifests = Manifests(spark, self.url)

    def manifest(self) -> UnitManifest:
        n = self.manifests.version()
        if not n:
            return UnitManifest()
        return UnitManifest(**json.loads(self.spark.read.text(f"{self.url}/manifests/{n:012d}.json", wholetext=True).first()[0]) | {"version": n})

    def units(self, m: UnitManifest | None = None) -> DataFrame:
        m = m or self.manifest()
        return self.spark.read.schema(UNIT).parquet(f"{self.url}/{m.units}") if m.units else self.spark.createDataFrame([], UNIT)

    def rows(self, kind: str, m: UnitManifest | None = None) -> DataFrame:
        """The nodes or edges of all units, each from its own generation."""
        m = m or self.manifest()
        schema, out = {"nodes": NODES, "edges": EDGES}[kind], None
        for n, folder in enumerate(m.generations):
            if folder:
                part = self.spark.read.schema(schema).parquet(f"{self.url}/{folder}/{kind}").withColumn("generation", F.lit(n))
                out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], schema)
        return out.join(self.units(m).select("tu", "generation"), ["tu", "generation"], "left_semi").drop("generation")

    def refresh(self, now: DataFrame, cursors: DataFrame, **options) -> Refreshed:
        """Brings the cache to the units of now (see unit_rows): extracts those of cursors (a table by tu) that are new or have
        changed, and forgets those that are gone. options are extract()'s; they count as options of each unit.

        A unit is known by path, build folder and options, but rows are by path; so of units with one path the last by build
        folder and options counts.
        """
        m = self.manifest()
        now = now.withColumn("options", F.sha1(F.concat("options", F.lit(json.dumps(options, sort_keys=True, default=str))).cast("binary")))
        now = now.groupBy("tu").agg(F.max(F.struct("build", "options", "length", "modified", "digest")).alias("r")).select("tu", "r.*")
        found = cut_lineage(self.spark, changes(self.units(m), now), "unit-changes")
        counts = {r.state: r.n for r in found.groupBy("state").agg(F.count("*").alias("n")).collect()}
        new = UnitManifest(m.version, f"units-{uuid.uuid4().hex}", list(m.generations))
        if counts.get(NEW, 0) + counts.get(CHANGED, 0):
            due = found.where(F.col("state").isin(NEW, CHANGED)).select("tu")
            nodes, edges = extract(cursors.join(due, "tu", "left_semi"), **options)
            folder = f"generation-{uuid.uuid4().hex}"
            nodes.select("tu", "t", "usr", "props", "seq").write.parquet(f"{self.url}/{folder}/nodes")
            edges.select("tu", "source_usr", "target_usr", "t", "props").write.parquet(f"{self.url}/{folder}/edges")
            new.generations.append(folder)
        latest = F.lit(len(new.generations) - 1)
        found.where(F.col("state") != GONE).select(*KEY, "length", "modified", "digest", F.coalesce("generation", latest).cast("int").alias("generation")).write.parquet(f"{self.url}/{new.units}")
        new.version = self.manifests.publish(new)
        return Refreshed(self.rows("nodes", new), self.rows("edges", new), counts)

    def invalidate(self, paths: DataFrame) -> int:
        """Forgets units by path (tu), whatever their build folder; how many there were."""
        m = self.manifest()
        units = self.units(m)
        lost = units.join(paths.select("tu").distinct(), "tu", "left_semi").count()
        if lost:
            new = UnitManifest(m.version, f"units-{uuid.uuid4().hex}", list(m.generations))
            units.join(paths.select("tu"), "tu", "left_anti").write.parquet(f"{self.url}/{new.units}")
            self.manifests.publish(new)
        return lost

    def compact(self) -> None:
        """Writes the rows of all units anew as one generation, without what changed and lost units left behind."""
        m = self.manifest()
        if not m.units:
            return
        folder, new = f"generation-{uuid.uuid4().hex}", UnitManifest(m.version, f"units-{uuid.uuid4().hex}", [])
        for kind in ("nodes", "edges"):
            self.rows(kind, m).write.parquet(f"{self.url}/{folder}/{kind}")
        new.generations.append(folder)
        self.units(m).withColumn("generation", F.lit(0)).write.parquet(f"{self.url}/{new.units}")
        self.manifests.publish(new)
