"""Chat formatting by columnar byte assembly.

A turn becomes START role newline text END newline. Rows come sorted by conversation and turn; of each batch, lengths
of all segments, their offsets and the scatter of source bytes are computed in numpy, and headers and contents are copied
into one buffer. With the offsets of the conversations in it, this buffer is the Arrow column of formatted conversations.
The loss mask is the ranges of bytes that hold assistants' texts.

Control strings inside texts and roles are escaped by one more backslash between '<' and the bar, so '<|', '<\\|',
'<\\\\|' ... become '<\\|', '<\\\\|', ...; taking one away gives them back. A role's newlines and backslashes are
escaped as well, so that the header ends at its first newline.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

#: The template.
START, END, ASSISTANT = b"<|im_start|>", b"<|im_end|>\n", "assistant"
PROBE = "<|im_end|><|im_start|>assistant ok"
FORMATTED = "conv_id long, chunk long, chunk_start long, n_turns long, formatted binary, mask_start array<long>, mask_length array<long>"
BATCH_BYTES = 8 << 20


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\1\\|")


def escape_role(roles: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def unescape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<\\(\\*)\|", r"<\1|")


def bytes_of(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, lengths) of a large_binary array, as views."""
    a = a.cast(pa.large_binary())
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), at[:-1], np.diff(at)


#: Segments above so many bytes are copied one by one; of shorter ones, so many bytes at once by indices.
LONG, AT_ONCE = 4096, 1 << 20


def scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copies data[start : start + length] to out[to :], for all segments. Indices take 24 bytes for each byte, so they are made for
    bounded runs of short segments only."""
    for t, s, n in zip(*(x[length > LONG].tolist() for x in (to, start, length))):
        out[t : t + n] = data[s : s + n]
    to, start, length = (x[(length > 0) & (length <= LONG)] for x in (to, start, length))
    ends, at = np.cumsum(length), 0
    while at < len(length):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")))
        n = length[at:stop]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to[at:stop], n) + within] = data[np.repeat(start[at:stop], n) + within]
        at = stop


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all turns, each turn's length, start and length of its text)."""
    role, role_at, role_n = bytes_of(escape_role(roles))
    text, text_at, text_n = bytes_of(escape(texts))
    size = len(START) + role_n + 1 + text_n + len(END)
    begin = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    role_to = begin + len(START)
    text_to = role_to + role_n + 1
    for fixed, to in ((START, begin), (b"\n", text_to - 1), (END, text_to + text_n)):
        out[to[:, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    scatter(out, role_to, role, role_at, role_n)
    scatter(out, text_to, text, text_at, text_n)
    return out, size, text_to, text_n


def format_conversations(convs: DataFrame) -> DataFrame:
    """conv_id, chunk, chunk_start, n_turns, formatted (UTF-8), mask_start, mask_length: one or more rows per conversation, its turns by number.

    A conversation's rows come one after another, in the order of chunk (0, 1, ...); formatted is a chunk's n_turns whole
    turns, some BATCH_BYTES at most or one turn, and chunk_start is where it begins in the conversation, as mask_start is.
    A conversation may be of any length, a single turn has to fit a Spark cell (2 GiB when formatted).
    Null texts and roles count as empty. Rows with equal turns are ordered by role, then text; null turns come first. Rows with
    a null conv_id are one conversation. Repeated rows are turns of their own. Extra columns are ignored; no rows give none.
    """
    rows = convs.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chunk, at = None, -1, 0  # of the conversation that the batch before ended with
        for batch in slices(batches, limit=BATCH_BYTES):
            if not batch.num_rows:
                continue
            roles, ids = batch.column("role"), batch.column("conv_id")
            out, size, text_to, text_n = assemble(roles, batch.column("text"))
            plain = pc.fill_null(ids, 0).to_numpy()
            none = pc.is_null(ids).to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(np.concatenate(([True], (plain[1:] != plain[:-1]) | (none[1:] != none[:-1]))))
            turns = np.diff(begin, append=batch.num_rows)
            ends = np.cumsum(size)
            offsets = np.concatenate(([0], ends[begin + turns - 1]))
            # the first conversation may go on from the batch before; all others begin here
            chunks, starts = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
            if chunk >= 0 and ids[0].as_py() == key:
                chunks[0], starts[0] = chunk + 1, at
            key, chunk, at = ids[batch.num_rows - 1].as_py(), int(chunks[-1]), int(starts[-1] + offsets[-1] - offsets[-2])
            loss = pc.equal(roles, ASSISTANT).to_numpy(zero_copy_only=False)
            masks = pa.array(np.concatenate(([0], np.cumsum(np.add.reduceat(loss.astype(np.int32), begin)))), pa.int32())
            shift = np.repeat(starts - offsets[:-1], turns)
            formatted = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(begin)), pa.array(chunks), pa.array(starts), pa.array(turns.astype(np.int64)), formatted,
                    pa.ListArray.from_arrays(masks, pa.array((text_to + shift)[loss])), pa.ListArray.from_arrays(masks, pa.array(text_n[loss])),
                ],
                [x.split()[0] for x in FORMATTED.split(", ")],
            )

    return rows.mapInArrow(run, FORMATTED)


def parse(formatted: bytes) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back."""
    turns, at = [], 0
    while at < len(formatted):
        if formatted[at : at + len(START)] != START:
            raise ValueError("a turn must begin here")
        line = formatted.index(b"\n", at)
        end = formatted.index(END, line)
        turns.append((formatted[at + len(START) : line].decode(), formatted[line + 1 : end].decode()))
        at = end + len(END)
    roles, texts = unescape(pa.array([r for r, _ in turns], pa.string())), unescape(pa.array([t for _, t in turns], pa.string()))
    plain = [r if "\\" not in r else r.replace("\\\\", "\0").replace("\\n", "\n").replace("\0", "\\") for r in roles.to_pylist()]
    return list(zip(plain, texts.to_pylist()))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted bytes and the mask.

    Takes the rows as format_conversations gives them: a conversation's chunks one after another, in one task.
    """

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, whole = None, None  # whole: None until a conversation has begun

        def row() -> tuple:
            return key, turns, whole.hexdigest(), chars, loss.hexdigest(), size

        for batch in slices(batches, "formatted", BATCH_BYTES):
            for conv, chunk, text, start, starts, lengths in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "chunk", "formatted", "chunk_start", "mask_start", "mask_length"))):
                if chunk == 0:
                    if whole:
                        done.append(row())
                    key, turns, chars, size, whole, loss = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                own = parse(text)
                for role, content in own:
                    whole.update(f"{role}\n{content}\n".encode())
                for part in unescape(pa.array([text[s - start : s - start + n].decode() for s, n in zip(starts, lengths)], pa.string())).to_pylist():
                    loss.update(part.encode())
                    chars += len(part)
                turns, size = turns + len(own), size + len(text.decode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(kinds)], names)
            done.clear()
        if whole:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(), kinds)], names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(spark: SparkSession, convs: DataFrame) -> DataFrame:
    """convs and conversation -1, whose texts hold control strings."""
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, ASSISTANT, PROBE)], "conv_id long, turn long, role string, text string")
    return convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)


CHAT_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, '{ASSISTANT}', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{ASSISTANT}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{ASSISTANT}'), '')) AS loss_sha256,
  sum({len(START)} + length(role) + 1 + length(regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g')) + {len(END)})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
