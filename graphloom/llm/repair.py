"""Conversation structure repair: the cheapest edits that give roles the order system?, (user, assistant)+, by a dynamic
program over a stream sorted by conversation and turn.

Rows are dealt by conversation once; duplicates are marked by a window over the same dealing, and the rows sorted by turn.
The program has four places in the order of roles (nothing yet, after the system's turn, after a user's, after an
assistant's). For each place it keeps the cheapest edits that lead there, of equal ones those that spell least, so its
state is a few small numbers, however long the conversation; it goes on from one Arrow batch to the next. What it keeps
of each row is two bytes, the number of the step taken. At a conversation's end the steps are followed back from the
cheapest place, and the edits are put out in the order of the turns. Steps and rows of a conversation beyond
HELD_ROWS rows or HELD_CHARS characters wait in nameless files of the task's own; the memory needed besides is one byte a row.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What edits cost, the letters that name them, and the roles' initials by place.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
INITIALS, NAMES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}, {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"
#: A place that costs this much more than the cheapest can't be on the way to the cheapest end: from any place, at most
#: this makes up for being at another (a deletion of the system's turn and an insertion).
BEHIND = DELETE + INSERT
#: Rows and characters of a conversation that a task holds in memory; and those that it puts out at once.
HELD_ROWS, HELD_CHARS, OUT_ROWS, OUT_CHARS = 1 << 18, 32 << 20, 10_000, 8 << 20
EDITS = "conv_id long, edit string, role string, text string, old_role string, turn long, fault string, cost int"


def follower(place: int) -> int:
    """The place that a user's or an assistant's turn leads to."""
    return ASSISTANT if place == USER else USER


def ways(place: int, initial: int, must_go: bool, cut: bool) -> Iterator[tuple[int, str, int]]:
    """(next place, letters, cost) of all edits of one row; at most one insertion before it, as a second is never cheaper."""
    yield place, "D", DELETE
    if must_go:
        return
    extra = TRUNCATED if cut else 0
    for before, letters, cost in ((place, "", 0), (follower(place), "I", INSERT)):
        if initial == follower(before) or initial == SYSTEM and before == NOTHING:
            yield initial, letters + "K", cost + KEEP + extra
        yield follower(before), letters + "R", cost + REROLE + extra


@lru_cache(maxsize=None)
def step(state: tuple, kind: tuple) -> tuple[tuple, int, tuple]:
    """(next state, what all its places cost more, for each place where it came from and by which letters).

    A state has, for each place that matters, its cost beyond the cheapest and its rank among the places by spelling. Edits
    that end with a row's own letter are never the beginning of one another, so ranks decide ties for whatever follows.
    """
    found: dict[int, list] = {}
    for place, entry in enumerate(state):
        if entry is not None:
            for to, letters, cost in ways(place, *kind):
                found.setdefault(to, []).append((entry[0] + cost, entry[1], letters, place))
    best = {to: min(x) for to, x in found.items()}
    least = min(x[0] for x in best.values())
    best = {to: x for to, x in best.items() if x[0] <= least + BEHIND}
    order = sorted(best, key=lambda to: best[to][1:3])
    after = tuple((best[q][0] - least, order.index(q)) if q in best else None for q in range(4))
    return after, least, tuple((best[q][3], best[q][2]) if q in best else None for q in range(4))


class Steps:
    """Steps by number: a row's step is found by two look-ups, and remembered as two bytes."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.steps: list[tuple] = []

    def take(self, state: tuple, kind: tuple) -> int:
        n = self.number.get((state, kind))
        if n is None:
            n = self.number[state, kind] = len(self.steps)
            self.steps.append(step(state, kind))
        return n


STEPS = Steps()
BEGIN = ((0, 0), None, None, None)


class Conversation:
    """One conversation: rows are added in the order of turns, then edits() gives what becomes of them."""

    def __init__(self, held_rows: int = HELD_ROWS, held_chars: int = HELD_CHARS):
        self.held_rows, self.held_chars = held_rows, held_chars
        self.state, self.cost, self.chars, self.spilled = BEGIN, 0, 0, []
        self.back, self.rows = array("H"), []
        self.back_file = self.row_file = None

    def add(self, role: str, text: str, turn: int | None, fault: str | None) -> None:
        n = STEPS.take(self.state, (INITIALS.get(role[:1], NOTHING), fault in (BLANK, DUPLICATE), fault == CUT))
        self.state, more, _ = STEPS.steps[n]
        self.cost += more
        self.back.append(n)
        self.rows.append((role, text, turn, fault))
        self.chars += len(text)
        if len(self.rows) >= self.held_rows or self.chars >= self.held_chars:
            self.spill()

    def spill(self) -> None:
        if self.back_file is None:
            self.back_file, self.row_file = tempfile.TemporaryFile(), tempfile.TemporaryFile()
        self.spilled.append(len(self.back))
        self.back.tofile(self.back_file)
        pickle.dump(self.rows, self.row_file, protocol=5)
        self.back, self.rows, self.chars = array("H"), [], 0

    def parts(self) -> Iterator[array]:
        """The steps' numbers, the last part first."""
        yield self.back
        end = sum(self.spilled)
        for n in reversed(self.spilled):
            end -= n
            self.back_file.seek(end * 2)
            part = array("H")
            part.fromfile(self.back_file, n)
            yield part

    def edits(self) -> Iterator[tuple[str, str, str, str | None, int | None, str | None, int]]:
        """(edit, role, text, old role, turn, fault, cost) in order; no rows give none."""
        closing = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
        place = min((e[0] + INSERT * len(closing[q]), e[1], q) for q, e in enumerate(self.state) if e is not None)[2]
        end, words = closing[place], bytearray()  # a byte for each row: whether an insertion comes before, and its letter
        for part in self.parts():
            for n in reversed(part):
                place, letters = STEPS.steps[n][2][place]
                words.append(ord(letters[-1]) | (128 if len(letters) > 1 else 0))
        words.reverse()
        at, place = 0, NOTHING

        def inserted(place: int) -> tuple:
            return "I", NAMES[place], "", None, None, None, INSERT

        for rows in self.held():
            for role, text, turn, fault in rows:
                word, at = words[at], at + 1
                if word & 128:
                    place = follower(place)
                    yield inserted(place)
                letter, extra = chr(word & 127), TRUNCATED if fault == CUT else 0
                if letter == "D":
                    yield letter, role, text, role, turn, fault, DELETE
                elif letter == "K":
                    place = INITIALS[role[0]]
                    yield letter, role, text, role, turn, fault, KEEP + extra
                else:
                    place = follower(place)
                    yield letter, NAMES[place], text, role, turn, fault, REROLE + extra
        for _ in end:
            place = follower(place)
            yield inserted(place)

    def held(self) -> Iterator[list]:
        if self.row_file is not None:
            self.row_file.seek(0)
            for _ in self.spilled:
                yield pickle.load(self.row_file)
        yield self.rows

    def close(self) -> None:
        for f in (self.back_file, self.row_file):
            if f is not None:
                f.close()


def last_char(text: str) -> Column:
    """A text's last character that isn't white space; the empty text if there is none."""
    return F.expr(f"right(trim(TRAILING ' \\t\\n\\u000b\\f\\r' FROM {text}), 1)")


def repair(convs: DataFrame, missing: str | None = None, *, held_rows: int = HELD_ROWS, held_chars: int = HELD_CHARS) -> DataFrame:
    """One row per edit, a conversation's in order and in one task: conv_id, edit, role, text, old_role, turn, fault, cost.

    The rows whose edit isn't D are the repaired conversation. edit: K(eep), R(erole), D(elete), I(nsert an empty turn).
    fault: blank (no character but white space), duplicate (role and text were there before), truncated (doesn't end with
    '.', '!' or '?'), or null; blank and duplicate rows are deleted. Of equally cheap edits the ASCII-least are taken.
    missing: a column of convs that is true for rows that aren't there, which only tell that there is a conversation; it gets
    one row with a null edit, and so its id isn't lost.

    Null roles and texts count as one space. Null turns come first; rows with equal turns are ordered by role, then text, and
    repeated rows are rows of their own (the second is a duplicate). Rows with a null conv_id are one conversation. A role is
    known by its first character only (s, u, a); any other, or none, can't be kept. Extra columns are ignored; no rows give none.
    A conversation may be of any length: it is one task's, which streams it.
    """
    gone = F.coalesce(F.col(missing).cast("boolean"), F.lit(False)) if missing else F.lit(False)
    rows = convs.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), gone.alias("gone"),
        F.when(gone, F.lit("")).otherwise(F.coalesce("role", F.lit(" "))).alias("role"), F.when(gone, F.lit("")).otherwise(F.coalesce("text", F.lit(" "))).alias("text"),
    ).repartition("conv")
    # the window needs no other dealing: rows that are alike are in one conversation
    seen = F.row_number().over(W.partitionBy("conv", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    last = last_char("text")
    fault = F.when(last == "", BLANK).when(F.col("seen") > 1, DUPLICATE).when(~last.isin(".", "!", "?"), CUT)
    ready = rows.withColumn("seen", seen).withColumn("fault", fault).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text", "seen")
    # pandas has no null whole numbers
    ready = ready.select(F.coalesce("conv", F.lit(0)).alias("conv"), F.col("conv").isNull().alias("no_conv"), F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNull().alias("no_turn"), "gone", "role", "text", "fault")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, current, out, size = None, None, [], 0

        def frame() -> pd.DataFrame:
            nonlocal out, size
            columns = list(zip(*out)) or [()] * 8
            out, size = [], 0
            kinds = ("Int64", object, object, object, object, "Int64", object, "int32")
            return pd.DataFrame({x.split()[0]: pd.Series(list(c), dtype=t) for x, c, t in zip(EDITS.split(", "), columns, kinds)})

        def ended() -> Iterator[pd.DataFrame]:
            nonlocal size
            conv = None if key[1] else key[0]
            if not len(current.back) and not current.spilled:
                out.append((conv, None, None, None, None, None, None, 0))
            for edit in current.edits():
                out.append((conv, *edit))
                size += len(edit[2])
                if len(out) >= OUT_ROWS or size >= OUT_CHARS:
                    yield frame()
            current.close()

        for batch in batches:
            for conv, no_conv, turn, no_turn, lost, role, text, what in zip(*(batch[c].tolist() for c in ("conv", "no_conv", "turn", "no_turn", "gone", "role", "text", "fault"))):
                if (conv, no_conv) != key:
                    if current is not None:
                        yield from ended()
                    key, current = (conv, no_conv), Conversation(held_rows, held_chars)
                if not lost:
                    current.add(role, text, None if no_turn else turn, what)
        if current is not None:
            yield from ended()
        yield frame()

    return ready.mapInPandas(run, EDITS)


def damage(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, lost: rows by crc32('conv_id:turn') % 20: lost (0), without text (1), without '.', '!' and
    '?' (2), twice (3), the user's (4), or as they are. Nulls, in the key too, are one space."""
    def filled(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    rows = convs.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(filled("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("time", F.explode(times)).select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("lost"))


DIGESTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digests(edits: DataFrame) -> DataFrame:
    """One row per conversation, from the rows of repair() as it gives them: gaps in the turns' numbers, rows by fault, adjacent
    roles (before the repair) that don't follow one another, the edits' cost and letters, and a digest of what they make."""
    rows = edits.select(F.coalesce("conv_id", F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("no_conv"), "edit", "role", "text", "old_role", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNull().alias("no_turn"), "fault", "cost")
    names = [x.split()[0] for x in DIGESTS.split(", ")]

    class Digest:
        def __init__(self):
            self.low = self.high = self.before = None
            self.turns = self.illegal = self.cost = 0
            self.faults, self.audit, self.hash, self.begun = {BLANK: 0, DUPLICATE: 0, CUT: 0}, bytearray(), hashlib.sha256(), False

        def add(self, edit: str, role: str, text: str, old: str | None, turn: int | None, fault: str | None, cost: int) -> None:
            self.audit += edit.encode()
            self.cost += cost
            if edit != "D":
                self.hash.update(("\n" if self.begun else "").encode() + f"{role}:{text}".encode())
                self.begun = True
            if edit != "I":
                self.illegal += self.before is not None and self.before + old[:1] not in LEGAL
                self.before = old[:1]
                if fault:
                    self.faults[fault] += 1
                if turn is not None and turn != self.high:
                    self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1

        def row(self, key: tuple[int, bool]) -> tuple:
            gaps = self.high - self.low + 1 - self.turns if self.turns else 0
            return None if key[1] else key[0], gaps, *self.faults.values(), self.illegal, self.cost, self.audit.decode(), self.hash.hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, current = None, None

        def frame(done: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame({n: pd.Series(list(c), dtype=object if n in ("audit", "repaired_sha256") else "Int64") for n, c in zip(names, list(zip(*done)) or [()] * len(names))})

        for batch in batches:
            done = []
            for conv, no_conv, edit, role, text, old, turn, no_turn, fault, cost in zip(*(batch[c].tolist() for c in ("conv", "no_conv", "edit", "role", "text", "old_role", "turn", "no_turn", "fault", "cost"))):
                if (conv, no_conv) != key:
                    if current is not None:
                        done.append(current.row(key))
                    key, current = (conv, no_conv), Digest()
                if edit is not None:
                    current.add(edit, role, text, old, None if no_turn else turn, fault, cost)
            yield frame(done)
        if current is not None:
            yield frame([current.row(key)])

    return rows.mapInPandas(run, DIGESTS)


#: crc32 of a text of ASCII characters, byte by byte and bit by bit.
CRC_SQL = "xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda x, b: list_reduce(list_concat([xor(x, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))))"
# The same by a recursion over rows: for each conversation and place the cheapest edits, of equal ones the ASCII-least, as text.
REPAIR_SQL = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, CRC % 20 AS kind
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations)),
dam AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT * FROM src UNION ALL SELECT * FROM src WHERE kind = 3) WHERE kind <> 0),
num AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM dam)),
rows AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault
  FROM num),
moves(place, after, need, letters, cost, inserted) AS (VALUES
  (0, 0, '', 'D', 4, ''), (1, 1, '', 'D', 4, ''), (2, 2, '', 'D', 4, ''), (3, 3, '', 'D', 4, ''),
  (0, 1, 's', 'K', 0, ''), (0, 2, 'u', 'K', 0, ''), (1, 2, 'u', 'K', 0, ''), (2, 3, 'a', 'K', 0, ''), (3, 2, 'u', 'K', 0, ''),
  (0, 2, '', 'R', 3, ''), (1, 2, '', 'R', 3, ''), (2, 3, '', 'R', 3, ''), (3, 2, '', 'R', 3, ''),
  (0, 3, 'a', 'IK', 3, 'user:'), (1, 3, 'a', 'IK', 3, 'user:'), (2, 2, 'u', 'IK', 3, 'assistant:'), (3, 3, 'a', 'IK', 3, 'user:'),
  (0, 3, '', 'IR', 6, 'user:'), (1, 3, '', 'IR', 6, 'user:'), (2, 2, '', 'IR', 6, 'assistant:'), (3, 3, '', 'IR', 6, 'user:')),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS place, 0::BIGINT AS cost, '' AS audit, '' AS made FROM conversations
  UNION ALL
  SELECT conv_id, i, place, cost, audit, made FROM (
    SELECT w.conv_id, r.i, m.after AS place, w.cost + m.cost + CASE WHEN m.letters <> 'D' AND r.fault = 'truncated' THEN 3 ELSE 0 END AS cost, w.audit || m.letters AS audit,
      w.made || CASE WHEN m.letters = 'D' THEN '' ELSE CASE WHEN m.inserted <> '' THEN chr(10) || m.inserted ELSE '' END || chr(10)
        || CASE WHEN right(m.letters, 1) = 'K' THEN r.role WHEN m.after = 2 THEN 'user' ELSE 'assistant' END || ':' || r.text END AS made,
      row_number() OVER (PARTITION BY w.conv_id, m.after ORDER BY w.cost + m.cost + CASE WHEN m.letters <> 'D' AND r.fault = 'truncated' THEN 3 ELSE 0 END, w.audit || m.letters) AS n
    FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
    JOIN moves m ON m.place = w.place AND (m.need = '' OR m.need = r.c) AND (m.letters = 'D' OR r.fault IS NULL OR r.fault = 'truncated')) WHERE n = 1),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id),
ended AS (
  SELECT w.conv_id, c.* EXCLUDE (conv_id), w.cost + e.cost AS cost, w.audit || e.letters AS audit, w.made || e.inserted AS made,
    row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + e.cost, w.audit || e.letters) AS k
  FROM walk w LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id
  JOIN (VALUES (0, '', 0, ''), (1, 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 'I', 3, chr(10) || 'assistant:'), (3, '', 0, '')) e(place, letters, cost, inserted) ON e.place = w.place
  WHERE w.i = coalesce(c.n, 0))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, cost, audit, sha256(substr(made, 2)) AS repaired_sha256
FROM ended WHERE k = 1
""".replace("CRC", CRC_SQL.format("key"))
