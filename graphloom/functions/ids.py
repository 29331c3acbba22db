"""Identifiers as column expressions, and the same in SQL for comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of vertex ids.
NAMESPACE = "8f6e2c1b7d3a4f599a4b1c0d2e5f8a91"


def vertex_id(usr: Column) -> Column:
    """The version 5 UUID of a symbol's usr, in lower-case text.

    Made of functions that are null for null arguments only: where a usr can't be null, the id can't be either, and a join
    on it needs no filter for nulls, which would compute the hash once more for each of its parts.
    """
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), usr.cast("binary")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def vertex_id_sql(usr: str) -> str:
    h = f"sha1(unhex('{NAMESPACE}') || encode({usr}))"
    nibble = f"(position(substr({h}, 17, 1) in '0123456789abcdef') - 1) % 4"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', ({nibble} + 1)::INT, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


def type_usr(spelling: Column) -> Column:
    return F.concat(F.lit("type:"), F.sha1(F.encode(spelling, "UTF-8")))


def file_usr(path: Column) -> Column:
    return F.concat(F.lit("file://"), F.coalesce(path, F.lit("")))


def document_key(kind: str, key: Column) -> Column:
    """Key of a node or edge document: its kind and the first 16 hexadecimal digits of a SHA-256."""
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(key.cast("binary"), 256), 1, 16))
