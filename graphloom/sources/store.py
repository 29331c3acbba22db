"""Graph stores: a graph as Parquet files listed by numbered manifests (manifest.py), merged on read; JSON documents; choice of
a store by address.

A write appends small delta files with the new versions of the rows that it touches, and a manifest that lists them beside the
files that were there. A reader takes, of each key, the version of the latest delta, else that of the base; as deltas
are small, their keys are broadcast and the base isn't shuffled. Where the deltas of a bucket exceed a share of it, or are many, the same write
compacts it: its rows are written anew as sorted base files, and it is split if it has grown. Readers see the graph before or
after a write, never between, and of two writers that began from the same graph the second is refused and may start again.

Edges are kept twice, dealt by either end, so that a look-up from either side opens few files. Properties that most rows of a type
have get columns of their own beside the map, on which filters are pushed to the scan.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GraphError
from ..functions.ids import document_key
from ..functions.scalars import as_string, equals
from ..lineage import cut_lineage
from ..model import EDGE_KEY, EDGE_SCHEMA, VERTEX_SCHEMA, Graph
from ..operators.introspect import SAFE_NAME
from ..operators.upsert import merged
from .manifest import MOST_BITS, Bucket, Entry, Manifest, Manifests, bloom_of, bloom_positions, bucket_index, few_listing_tasks, split, whole

#: kind: (columns, the id by which rows are dealt, key)
KINDS = {
    "vertices": (VERTEX_SCHEMA, "id", ("id",)),
    "edges": (EDGE_SCHEMA, "outbound_id", EDGE_KEY),
    "inbound": (EDGE_SCHEMA, "inbound_id", EDGE_KEY),
}
#: Buckets of a new store (a power of two), rows above which a bucket is split, and what makes a bucket be compacted: deltas of
#: more than a share of its base rows, or in more files than this.
BUCKETS, SPLIT_ROWS, SHARE, MAX_DELTAS = 16, 1 << 20, 0.25, 16
#: Ids up to which a look-up goes by them one by one; and properties with columns of their own, at most.
FEW, TYPED = 1000, 16


def typed_columns(names: list[str]) -> list[Column]:
    """Two columns for each property: its string, and its number (a truth value counts as 1 or 0, as filters have it)."""
    out = []
    for k in names:
        text = F.try_element_at("props", F.lit(k))
        number = F.when(text == "true", 1.0).when(text == "false", 0.0).when(~text.startswith('"'), text.try_cast("double"))
        out += [as_string(text).alias(f"s${k}"), F.when(number == 0.0, 0.0).otherwise(number).alias(f"n${k}")]
    return out


def pushed(name: str, value: object) -> Column | None:
    """A filter on a property's own columns that holds wherever the property equals the value; None if there is none."""
    s, n = F.col(f"`s${name}`"), F.col(f"`n${name}`")
    if value is None:
        return s.isNull() & n.isNull()
    if isinstance(value, str):
        return s == value
    try:
        number = float(value)
    except OverflowError:
        return None
    return n == number if math.isfinite(number) else F.lit(False)


def frequent(counts: Iterable[tuple[str, int, int]]) -> list[str]:
    """Of properties (name, rows of a type that have it, rows of the type), those to get columns of their own: the ones most
    often in at least half of a type's rows."""
    sums: dict[str, int] = {}
    for k, c, n in counts:
        if re.match(SAFE_NAME, k):
            sums[k] = sums.get(k, 0) + (c if 2 * c >= n else 0)
    return sorted(sorted((k for k, c in sums.items() if c), key=lambda k: (-sums[k], k))[:TYPED])


class ParquetStore:
    """buckets: their number in a store that is new; an old one's manifest says how it is dealt, whatever is asked here."""

    def __init__(self, spark: SparkSession, url: str, buckets: int = BUCKETS, *, split_rows: int = SPLIT_ROWS, share: float = SHARE, max_deltas: int = MAX_DELTAS):
        if buckets < 1 or buckets & (buckets - 1):
            raise GraphError("INVALID_ARGUMENT", "the number of buckets must be a power of two")
        self.spark, self.url = spark, url.rstrip("/")
        self.depth, self.split_rows, self.share, self.max_deltas = buckets.bit_length() - 1, split_rows, share, max_deltas
        self.manifests = Manifests(spark, self.url)

    def version(self) -> int:
        return self.manifests.version()

    def manifest(self, version: int | None = None) -> Manifest:
        return self.manifests.load(version)

    # ------------------------------------------------------------ reading

    def _files(self, kind: str, entries: list[Entry], typed: list[str] = []) -> DataFrame:
        schema = KINDS[kind][0] + ", seq long" + "".join(f", `s${k}` string, `n${k}` double" for k in typed)
        with few_listing_tasks(self.spark):
            return self.spark.read.schema(schema).parquet(*[f"{self.url}/data/{e.path}" for e in entries])

    def _rows(self, kind: str, entries: list[Entry], where: Column | None = None, prop: tuple[str, object] | None = None) -> DataFrame:
        """The latest version of each row in these files. where: over the key, for rows that are asked for; prop: a property and its
        value, asked of the latest versions."""
        schema, _, key = KINDS[kind]
        names = [x.split()[0] for x in schema.split(", ")]
        if not entries:
            return self.spark.createDataFrame([], schema)
        equal = None if prop is None else equals(F.try_element_at("props", F.lit(prop[0])), prop[1])
        base, deltas = [e for e in entries if e.base], [e for e in entries if not e.base]
        parts = []
        typed = [e for e in base if prop is not None and prop[0] in e.typed]
        for own, columns in ((typed, [prop[0]] if typed else []), ([e for e in base if e not in typed], [])):
            if own:
                rows = self._files(kind, own, columns)
                first = pushed(*prop) if columns else None
                rows = rows if first is None else rows.where(first)
                rows = rows if where is None else rows.where(where)
                parts.append((rows if equal is None else rows.where(equal)).select(*names))
        if deltas:
            newer = self._files(kind, deltas)
            newer = newer if where is None else newer.where(where)
            if parts:
                parts = [p.join(newer.select(*key).distinct(), list(key), "left_anti").select(*names) for p in parts]
            latest = newer.groupBy(*key).agg(F.max_by(F.struct(*names), "seq").alias("v")).select("v.*")
            parts.append(latest if equal is None else latest.where(equal))
        return reduce(DataFrame.unionByName, parts)

    def read(self, version: int | None = None, types: set[str] | None = None) -> StoredGraph:
        """The graph, or of it the vertices and edges of some labels and types only, whose files alone are then read."""
        m = self.manifest(version)
        return StoredGraph(self._rows("vertices", m.of("vertices", types)), self._rows("edges", m.of("edges", types)), self, m, types)

    # ------------------------------------------------------------ writing

    def _write(self, kind: str, df: DataFrame, buckets: list[Bucket], seq: int, base: bool, typed: list[str]) -> list[Entry]:
        """New files with df's rows (the kind's columns, and fresh), sorted by key within bucket and type."""
        _, routed, key = KINDS[kind]
        name = f"{kind}-{seq:012d}-{uuid.uuid4().hex[:12]}"
        order = ["bucket", "part", routed, *[k for k in key if k != routed]]
        placed = df.select("*", F.lit(seq).cast("long").alias("seq"), bucket_index(F.col(routed), buckets).alias("bucket"), F.col("t").alias("part"))
        # by ranges: files of like size, each with few ids between its first and last, also where one bucket holds most rows
        dealt = placed.repartitionByRange(*order).select("*", *typed_columns(typed)).sortWithinPartitions(*order)
        # each task moves its own files: nobody reads them before the manifest that lists them, and the driver would move them one by one
        dealt.write.partitionBy("bucket", "part").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{self.url}/data/{name}")
        with few_listing_tasks(self.spark):
            written = self.spark.read.schema(f"{routed} string, fresh boolean, props map<string,string>").parquet(f"{self.url}/data/{name}") if self._has_files(name) else None
        if written is None:
            return []
        rows = written.select(F.col("_metadata.file_path").alias("path"), F.col(routed).alias("id"), "fresh", "props")
        # each counted by an aggregation of its own, whose groups are few beside the rows, and met in a row for each file
        none = lambda **types: [F.lit(None).cast(t).alias(c) for c, t in types.items()]
        sums = rows.groupBy("path").agg(F.count("*").alias("n"), F.count_if("fresh").alias("fresh"), F.min("id").alias("low"), F.max("id").alias("high")).select("*", *none(bit="int", name="string", named="long"))
        bits = rows.select("path", F.explode(bloom_positions(F.xxhash64("id"))).alias("bit")).distinct().select("path", *none(n="long", fresh="long", low="string", high="string"), "bit", *none(name="string", named="long"))
        sets = rows.groupBy("path", F.map_keys("props").alias("names")).agg(F.count("*").alias("named"))
        names = sets.select("path", F.explode("names").alias("name"), "named").groupBy("path", "name").agg(F.sum("named").alias("named")).select("path", *none(n="long", fresh="long", low="string", high="string", bit="int"), "name", "named")
        filter_ = F.collect_list("bit")
        found = sums.unionByName(bits).unionByName(names).groupBy("path").agg(
            F.max("n").alias("n_rows"), F.max("fresh").alias("fresh_rows"), F.min("low").alias("low"), F.max("high").alias("high"), F.when(F.size(filter_) <= MOST_BITS, filter_).alias("bits"),
            F.collect_list(F.when(F.col("name").isNotNull(), F.struct(F.col("name").alias("value"), F.col("named").alias("n")))).alias("keys"),
        ).collect()
        out = []
        for r in found:
            bucket, part, file = unquote(r.path).split("/")[-3:]  # a URI; names of folders are quoted once more
            label = unquote(part.removeprefix("part="))
            out.append(Entry(kind, buckets[int(bucket.removeprefix("bucket="))], None if label == "__HIVE_DEFAULT_PARTITION__" else label, f"{name}/{bucket}/{part}/{file}", base, seq, r.n_rows, r.fresh_rows, r.low, r.high, bloom_of(r.bits), dict(sorted((k.value, k.n) for k in r["keys"])), typed))
        return sorted(out, key=lambda e: e.path)

    def _has_files(self, name: str) -> bool:
        fs = self.manifests.file_system()
        return any(s.isDirectory() for s in fs.listStatus(self.manifests.path("data", name)))

    def write(self, g: Graph) -> int:
        """Replaces the whole graph. How a store is dealt stays as it is."""
        m = self.manifest()
        new = Manifest(m.version, dict(m.buckets), [])
        for kind, df in (("vertices", g.vertices), ("edges", g.edges)):
            self._write_whole(new, kind, cut_lineage(self.spark, df.withColumn("fresh", F.lit(True)), kind))
        return self.manifests.publish(new)

    def _write_whole(self, m: Manifest, kind: str, rows: DataFrame) -> None:
        counts = rows.groupBy("t").agg(F.count("*").alias("n"))
        keys = rows.select("t", F.explode(F.map_keys("props")).alias("k")).groupBy(F.col("t").alias("kt"), "k").agg(F.count("*").alias("c"))
        typed = frequent((r.k, r.c, r.n) for r in keys.join(counts, F.col("kt").eqNullSafe(F.col("t"))).where(F.col("c") * 2 >= F.col("n")).collect())
        for k in (kind, "inbound") if kind == "edges" else (kind,):
            m.buckets.setdefault(k, whole(self.depth))
            m.entries += self._write(k, rows, m.buckets[k], m.version + 1, True, typed)

    def _known(self, m: Manifest, kind: str, wanted: DataFrame, column: str, more: bool = False) -> DataFrame:
        """The stored rows of kind whose id (by which they are dealt) is in wanted's column; more: others too, as the caller joins them anyway."""
        routed = KINDS[kind][1]
        ids = wanted.select(F.col(column).alias("id")).where("id IS NOT NULL").distinct()
        few = [r.id for r in ids.limit(FEW + 1).collect()]
        if len(few) <= FEW:
            return self._rows(kind, m.holding(kind, few), F.col(routed).isin(few))
        buckets = m.buckets.get(kind, [])
        named = wanted.where(F.col(column).isNotNull())
        touched = {buckets[r.b] for r in named.select(bucket_index(F.col(column), buckets).alias("b")).distinct().collect()} if buckets else set()  # no more than there are buckets
        rows = self._rows(kind, [e for e in m.of(kind) if e.bucket in touched])
        return rows if more else rows.join(ids.select(F.col("id").alias(routed)), routed, "left_semi")

    def upsert(self, vertices: DataFrame, edges: DataFrame) -> dict[str, int]:
        """Upserts batches (with seq) and publishes the new graph; counts of rows inserted and attempted.

        The first label and usr of an id stay; of a property the last value stays. Edges need both ends stored. What is written are the
        rows of the batches only, and the buckets that this makes due for compaction.
        """
        m = self.manifest()
        new, counts = Manifest(m.version, dict(m.buckets), list(m.entries)), {}
        for kind, batch in (("vertices", vertices), ("edges", edges)):
            batch = cut_lineage(self.spark, batch, kind)
            counts[f"{kind}_attempted"] = batch.count()
            if kind == "edges":
                # with a batch that isn't small beside the store, looking for its vertices first would only be one more join
                large = SHARE * sum(e.rows for e in new.of("vertices")) < counts["edges_attempted"]
                for end in ("outbound_id", "inbound_id"):
                    batch = batch.join(self._known(new, "vertices", batch, end, large).select(F.col("id").alias(end)), end, "left_semi")
            delta = cut_lineage(self.spark, self._versions(new, kind, batch), f"{kind}-delta")
            written = self._append(new, kind, delta)
            counts[f"{kind}_inserted"] = sum(e.fresh for e in written)
        self._compact(new)
        self.manifests.publish(new)
        return {k: counts[k] for k in ("vertices_inserted", "vertices_attempted", "edges_inserted", "edges_attempted")}

    def _versions(self, m: Manifest, kind: str, batch: DataFrame) -> DataFrame:
        """The new versions of the batch's rows, with fresh: whether the key is new."""
        schema, routed, key = KINDS[kind]
        first = ("t", "usr") if kind == "vertices" else ()
        folded = merged(batch, key, first, lambda df: cut_lineage(self.spark, df, f"{kind}-repeated"))
        names = [x.split()[0] for x in schema.split(", ")]
        if not m.of(kind):
            return folded.select(*names, F.lit(True).alias("fresh"))
        old = self._known(m, kind, folded, routed).select(*[F.col(k).alias(f"o_{k}") for k in key], *[F.col(c).alias(f"old_{c}") for c in first], F.col("props").alias("old_props"), F.lit(True).alias("stored"))
        both = folded.join(old, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in key]), "left")
        fresh = F.col("stored").isNull()
        kept = F.filter(F.map_entries("old_props"), lambda e: ~F.map_contains_key("props", e["key"]))
        props = F.when(fresh, F.col("props")).otherwise(F.map_from_entries(F.array_sort(F.concat(kept, F.map_entries("props")))))
        return both.withColumn("props", props).withColumns({c: F.when(fresh, F.col(c)).otherwise(F.col(f"old_{c}")) for c in first}).select(*names, fresh.alias("fresh"))

    def _append(self, m: Manifest, kind: str, delta: DataFrame) -> list[Entry]:
        if not m.of(kind):
            before = len(m.entries)
            self._write_whole(m, kind, delta)
            return [e for e in m.entries[before:] if e.kind == kind]
        out = []
        for k in (kind, "inbound") if kind == "edges" else (kind,):
            written = self._write(k, delta, m.buckets[k], m.version + 1, False, [])
            m.entries += written
            out += written if k == kind else []
        return out

    def _due(self, m: Manifest, kind: str) -> set[Bucket]:
        sums: dict[Bucket, list[int]] = {}
        for e in m.of(kind):
            s = sums.setdefault(e.bucket, [0, 0, 0])
            s[0] += e.rows if e.base else 0
            s[1] += 0 if e.base else e.rows
            s[2] += 0 if e.base else 1
        return {b for b, (base, delta, files) in sums.items() if files and (delta > self.share * base or files > self.max_deltas)}

    def _compact(self, m: Manifest, all_of_them: bool = False) -> None:
        """Writes buckets anew that are due, as base files, split where they have grown."""
        for kind in KINDS:
            due = {b for b in m.buckets.get(kind, []) if all_of_them} or self._due(m, kind)
            if not due:
                continue
            old = [e for e in m.of(kind) if e.bucket in due]
            for bucket in due:
                size, made = sum(e.rows if e.base else e.fresh for e in old if e.bucket == bucket), [bucket]
                while size > self.split_rows:
                    made, size = [half for b in made for half in split(b)], size / 2
                at = m.buckets[kind].index(bucket)
                m.buckets[kind] = [*m.buckets[kind][:at], *made, *m.buckets[kind][at + 1 :]]
            rows = cut_lineage(self.spark, self._rows(kind, old).withColumn("fresh", F.lit(True)), f"{kind}-compacted")
            rows_of, keys_of = Counter(), Counter()
            for e in old:
                rows_of[e.t] += e.rows
                keys_of.update({(e.t, k): c for k, c in e.keys.items()})
            counts = [(k, c, rows_of[t]) for (t, k), c in keys_of.items()]
            m.entries = [e for e in m.entries if e not in old] + self._write(kind, rows, m.buckets[kind], m.version + 1, True, frequent(counts))

    def compact(self) -> int:
        """Compacts all buckets."""
        m = self.manifest()
        new = Manifest(m.version, dict(m.buckets), list(m.entries))
        self._compact(new, True)
        return self.manifests.publish(new)

    def expire(self, keep: int = 2) -> None:
        """Removes manifests but the latest ones, and the files that only these had."""
        fs, latest = self.manifests.file_system(), self.version()
        held = {e.path for n in range(max(1, latest - keep + 1), latest + 1) for e in self.manifest(n).entries}
        for n in range(1, latest - keep + 1):
            path = self.manifests.path("manifests", f"{n:012d}.json")
            if fs.exists(path):
                for e in self.manifest(n).entries:
                    if e.path not in held:
                        fs.delete(self.manifests.path("data", e.path), False)
                fs.delete(path, False)

    # ------------------------------------------------------------ description

    def describe(self, kind: str = "vertices", version: int | None = None) -> list[tuple[str | None, int, list[str]]]:
        """(type, rows, names of properties) of vertices or edges, the most frequent first; from the manifest alone."""
        counts: dict[str | None, int] = {}
        keys: dict[str | None, set[str]] = {}
        for e in self.manifest(version).of(kind):
            counts[e.t] = counts.get(e.t, 0) + (e.rows if e.base else e.fresh)
            keys.setdefault(e.t, set()).update(e.keys)  # properties are never taken away, so older versions add no other names
        return [(t, n, sorted(keys[t])) for t, n in sorted(counts.items(), key=lambda x: (-x[1], x[0] or ""))]

    def totals(self, version: int | None = None) -> dict[str, int]:
        return {kind: sum(n for _, n, _ in self.describe(kind, version)) for kind in ("vertices", "edges")}


@dataclass
class StoredGraph(Graph):
    """A store's graph as of one version; look-ups by id or property open few files."""

    store: ParquetStore
    manifest: Manifest
    types: set[str] | None = None

    def vertices_of(self, ids: list[str]) -> DataFrame:
        return self.store._rows("vertices", self.manifest.holding("vertices", ids, self.types), F.col("id").isin(ids))

    def edges_at(self, ids: list[str], direction: str = "outbound", t: str | None = None) -> DataFrame:
        kind = "edges" if direction == "outbound" else "inbound"
        types = self.types if t is None else {t} if self.types is None or t in self.types else set()
        return self.store._rows(kind, self.manifest.holding(kind, ids, types), F.col(f"{direction}_id").isin(ids))

    def vertices_in(self, ids: DataFrame) -> DataFrame:
        """By the ids if they are few, else from the buckets that they touch."""
        return self._of_types(self.store._known(self.manifest, "vertices", ids, "id"))

    def edges_in(self, keys: DataFrame) -> DataFrame:
        known = self._of_types(self.store._known(self.manifest, "edges", keys, "outbound_id"))
        return known.join(keys.select(*EDGE_KEY), list(EDGE_KEY), "left_semi")

    def _of_types(self, rows: DataFrame) -> DataFrame:
        return rows if self.types is None else rows.where(F.col("t").isin(*sorted(self.types)))

    def vertices_with(self, name: str, value: object) -> DataFrame:
        return self.store._rows("vertices", self.manifest.of("vertices", self.types), prop=(name, value))

    def edges_with(self, name: str, value: object) -> DataFrame:
        return self.store._rows("edges", self.manifest.of("edges", self.types), prop=(name, value))

    def neighbours(self, ends: DataFrame, few: int | None) -> DataFrame:
        """Vertices by the ids of ends (id), one row for each of its rows; few: how many there are at most."""
        if few is None or few > FEW:
            return self.vertices.join(ends, "id")
        ids = [r.id for r in ends.collect()]
        return self.vertices_of(sorted(set(ids))).join(self.store.spark.createDataFrame([(i,) for i in ids], "id string"), "id")


def node_documents(vertices: DataFrame) -> DataFrame:
    """(key, document): a JSON document for each vertex."""
    return vertices.select(document_key("node", F.col("usr")).alias("key"), F.to_json(F.struct("id", "t", "usr", "props")).alias("document"))


def edge_documents(edges: DataFrame) -> DataFrame:
    return edges.select(document_key("edge", F.concat_ws("|", "outbound_id", "t", "inbound_id")).alias("key"), F.to_json(F.struct("outbound_id", "inbound_id", "t", "props")).alias("document"))


def changed_documents(known: DataFrame, documents: DataFrame) -> DataFrame:
    """documents (key, document), one row a key, that aren't known as they are, with is_new: whether the key is new."""
    new = documents.groupBy("key").agg(F.max("document").alias("document"))
    old = known.select("key", F.col("document").alias("old"))
    return new.join(old, "key", "left").where(~F.col("document").eqNullSafe(F.col("old"))).select("key", "document", F.col("old").isNull().alias("is_new"))


@dataclass
class Documents:
    """The manifest of a document store: folders of documents, the later ones' taking the place of the earlier ones'."""

    version: int = 0
    folders: list[str] = field(default_factory=list)

    def dump(self) -> str:
        return json.dumps(self.folders)


class DocumentStore:
    """JSON documents by key: new keys are added, and a known key's changed document takes the place of the old one.

    A write is a folder of its own, which a numbered manifest adds to the others; of two writers that began alike the second
    is refused, so no two documents of a key have one version.
    """

    SCHEMA = "key string, document string"

    def __init__(self, spark: SparkSession, url: str):
        self.spark, self.url = spark, url.rstrip("/")
        self.manifests = Manifests(spark, self.url)

    def manifest(self) -> Documents:
        n = self.manifests.version()
        return Documents(n, json.loads(self.spark.read.text(f"{self.url}/manifests/{n:012d}.json", wholetext=True).first()[0])) if n else Documents()

    def read(self, m: Documents | None = None) -> DataFrame:
        """(key, document), the latest of each key."""
        m, out = m or self.manifest(), None
        for n, folder in enumerate(m.folders):
            part = self.spark.read.schema(self.SCHEMA).json(f"{self.url}/data/{folder}").withColumn("n", F.lit(n))
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], self.SCHEMA)
        return out.groupBy("key").agg(F.max_by("document", "n").alias("document"))

    def upsert(self, documents: DataFrame) -> int:
        """Writes what is new or changed; the number of new keys."""
        m = self.manifest()
        new = cut_lineage(self.spark, changed_documents(self.read(m), documents), "documents")
        counts = new.agg(F.count("*").alias("n"), F.count_if("is_new").alias("new")).first()
        if counts.n:
            folder = f"documents-{uuid.uuid4().hex}"
            new.select("key", "document").write.json(f"{self.url}/data/{folder}")
            self.manifests.publish(Documents(m.version, [*m.folders, folder]))
        return counts.new


SCHEMES = {"parquet": ParquetStore, "documents": DocumentStore}


def open_store(spark: SparkSession, uri: str):
    """The store of an address such as parquet://file:/data/graph (scheme, then the folder's own address)."""
    if "://" not in (uri or ""):
        raise GraphError("INVALID_ARGUMENT", f"the address needs a scheme: {sorted(SCHEMES)}")
    scheme, _, url = uri.partition("://")
    if scheme not in SCHEMES:
        raise GraphError("INVALID_ARGUMENT", f"unknown scheme {scheme!r}; there are {sorted(SCHEMES)}")
    return SCHEMES[scheme](spark, url)
