"""Quality rules with cross-document line frequency (DataFrame functions only).

A line is boilerplate on its host if more distinct documents of the host hold it than the limits allow; exact copies are
one document. Such lines are removed; a document that loses too much of its text is rejected. Lines are compared by a 64-bit hash of their
normalised form (lower case, runs of white space as one space, digits as 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, words

#: A line goes if more than MIN_DOCS of the host's distinct texts, and more than this share of them, hold it.
MIN_DOCS, MAX_SHARE = 20, 0.01
#: A document is depleted if the lines it keeps have less than this share of its characters (ends of lines trimmed).
MIN_LEFT = 0.5
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def chars_left(text: Column, chars: str) -> Column:
    return F.length(F.translate(F.coalesce(text, F.lit("")), chars, ""))


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Each array is a column of its own step: a later lambda then reads it and doesn't compute it anew for each element.
    Only texts in which some window comes twice are sorted.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    df = docs.withColumns({
        "__w": words(F.col("text")), "__l": lines,
        "word_chars": chars_left(text, WHITE).cast("long"),
        "n_symbols": (F.length(text) - chars_left(text, "#*$%&|<>")).cast("long"),
    })
    df = df.withColumns({
        "n_words": F.size("__w").cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "__h": F.transform("__w", lambda w: F.xxhash64(w)),
    }).drop("__w", "__l")
    windows = F.transform(F.sequence(F.lit(1), F.size("__h") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__h", i, WINDOW)))
    df = df.withColumn("__x", F.when(F.size("__h") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>"))).drop("__h")
    ranked = F.array_sort(F.transform("__x", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__x")) < F.size("__x"), ranked)).drop("__x")
    twice = F.filter("__s", lambda x, i: (F.get("__s", i - 1)["h"] == x["h"]) | (F.get("__s", i + 1)["h"] == x["h"]))
    df = df.withColumn("__p", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("__s")
    covered = F.aggregate(
        "__p", F.struct(F.lit(0).alias("e"), F.lit(0).cast("long").alias("c")),
        lambda a, p: F.struct((p + WINDOW).alias("e"), (a["c"] + p + WINDOW - F.greatest(p, a["e"])).alias("c")),
        lambda a: a["c"],
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("__p")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def split_lines(docs: DataFrame, host: str) -> DataFrame:
    """(doc_id, host, text_hash, pos, line_hash, chars) for each line with a word."""
    norm = F.regexp_replace(F.regexp_replace(F.lower("text"), r"[ \t\x0B\f\r]+", " "), "[0-9]", "0")
    df = docs.select("doc_id", F.coalesce(F.col(host), F.lit("")).alias("host"), F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(norm, "\n")).alias("pos", "line"))
    df = df.withColumn("line", F.btrim("line"))
    return df.where("line <> ''").select("doc_id", "host", "text_hash", "pos", F.xxhash64("line").alias("line_hash"), F.length("line").alias("chars"), "line")


def frequent_lines(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, line_hash, n_docs) of the lines above the limits. The line's and the host's documents are both counted by distinct
    text, so exact copies count once and don't raise the limit.

    Both counts are aggregated before they are shuffled, so a line that a third of the documents hold is one row a task.
    """
    counted = split_lines(docs, host).groupBy("host", "line_hash").agg(F.count_distinct("text_hash").alias("n_docs")).where(F.col("n_docs") > min_docs)
    hosts = docs.groupBy(F.coalesce(F.col(host), F.lit("")).alias("host")).agg(F.count_distinct(F.xxhash64(F.coalesce("text", F.lit("")))).alias("host_docs"))
    return counted.join(hosts, "host").where(F.col("n_docs") > max_share * F.col("host_docs")).select("host", "line_hash", "n_docs")


def apply_line_rules(docs: DataFrame, host: str = "source", *, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per row of docs: doc_id, the counts of base_counts, n_lines_removed, chars_removed, kept.

    kept is false for rows that fail the base rules and for depleted ones. Null and empty texts have no words and fail
    the base rules; a null host is a host of its own; repeated rows get the same verdict each; null ids are kept apart by
    their text's hash. An empty table gives an empty result; extra columns are ignored.
    """
    docs = docs.select("doc_id", "text", host)
    base = base_counts(docs).withColumn("host", F.coalesce(F.col(host), F.lit(""))).withColumn("text_hash", F.xxhash64("text"))
    lengths = F.coalesce(F.length(F.regexp_replace(F.lower("text"), r"[ \t\x0B\f\r]+", " ")), F.lit(0))
    base = base.withColumn("norm_chars", lengths).drop("text")
    lines = split_lines(docs, host).drop("line")
    bad = frequent_lines(docs, host, min_docs, max_share)
    gone = lines.join(bad, ["host", "line_hash"], "left_semi").dropDuplicates(["doc_id", "host", "text_hash", "pos"])
    gone = gone.groupBy("doc_id", "host", "text_hash").agg(F.count("*").alias("n_lines_removed"), F.sum("chars").alias("chars_removed"))
    same = base["doc_id"].eqNullSafe(gone["doc_id"]) & (base["host"] == gone["host"]) & (base["text_hash"] == gone["text_hash"])
    out = base.join(gone, same, "left").select(
        base["doc_id"], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce("n_lines_removed", F.lit(0).cast("long")).alias("n_lines_removed"), F.coalesce("chars_removed", F.lit(0).cast("long")).alias("chars_removed"), "norm_chars",
    )
    depleted = F.col("chars_removed") > (1 - min_left) * F.col("norm_chars")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("norm_chars")


def remove_frequent_lines(docs: DataFrame, host: str = "source", **limits: float) -> DataFrame:
    """docs without the lines above the limits, each text put together again from the lines it keeps, in order.

    Rows whose texts hold no such line are not touched. Lines are gathered by row, never by host or line.
    """
    bad = frequent_lines(docs, host, **limits)
    rows = docs.withColumn("__id", F.xxhash64("doc_id", host, "text"))
    hit = split_lines(docs.select("doc_id", "text", host), host).join(bad, ["host", "line_hash"], "left_semi")
    hit = hit.groupBy("doc_id", "host", "text_hash").agg(F.collect_set("pos").alias("__gone"))
    joined = rows.join(hit, rows["doc_id"].eqNullSafe(hit["doc_id"]) & (F.coalesce(rows[host], F.lit("")) == hit["host"]) & (F.xxhash64(rows["text"]) == hit["text_hash"]), "left")
    kept = F.array_join(F.filter(F.split(rows["text"], "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    return joined.select(*[(F.when(F.col("__gone").isNull(), rows[c]).otherwise(kept) if c == "text" else rows[c]).alias(c) for c in docs.columns])


RULES_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT doc_id, host, text, list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS ls FROM d),
n AS (SELECT doc_id, host, text, len(ws) AS n_words, length(regexp_replace(text, '[ \\t-\\r]', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM w),
win AS (SELECT doc_id, i, list_aggregate(ws[i:i + {WINDOW - 1}], 'string_agg', ' ') AS x
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY doc_id),
norm AS (SELECT doc_id, host, text, regexp_replace(lower(text), '[ \\t\\x0B\\f\\r]+', ' ', 'g') AS t FROM d),
lines AS (SELECT doc_id, host, text, pos, line FROM (
        SELECT doc_id, host, text, unnest(range(0, len(ls))) AS pos, trim(unnest(ls), ' ') AS line
        FROM (SELECT doc_id, host, text, string_split(regexp_replace(t, '[0-9]', '0', 'g'), chr(10)) AS ls FROM norm)) WHERE line <> ''),
freq AS (SELECT host, line, count(DISTINCT text) AS c FROM lines GROUP BY ALL),
hosts AS (SELECT host, count(DISTINCT text) AS h FROM d GROUP BY host),
bad AS (SELECT host, line FROM freq JOIN hosts USING (host) WHERE c > {MIN_DOCS} AND c > {MAX_SHARE} * h),
gone AS (SELECT doc_id, count(*) AS n, sum(length(line)) AS c FROM lines JOIN bad USING (host, line) GROUP BY doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, (n_words < {MIN_WORDS} OR 100 * coalesce(rep.n, 0) > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  coalesce(gone.n, 0)::BIGINT AS n_lines_removed, coalesce(gone.c, 0)::BIGINT AS chars_removed,
  NOT (n_words < {MIN_WORDS} OR 100 * coalesce(rep.n, 0) > {MAX_REPEAT_PERCENT} * n_words) AND NOT (coalesce(gone.c, 0) > {1 - MIN_LEFT} * length(norm.t)) AS kept
FROM n JOIN norm USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
