"""Bulk text export (COPY TEXT): lines of tab-separated fields with backslash escapes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import types as reg

# Single-letter escapes.
LETTERS = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
#: A field's pieces: an escape, or text up to the next one.
PIECE = r"(?s)\\(?:x[0-9A-Fa-f]{1,2}|[0-7]{1,3}|.|\z)|[^\\]+"


def unescape(text: str) -> str:
    """What ``copy_unescape`` does, for one text: in one pass, so that an escaped backslash never starts another escape."""
    raw, plain = b"", ""
    for piece in re.findall(PIECE.replace(r"\z", r"\Z"), text):
        if re.match(r"\\(x[0-9A-Fa-f]|[0-7])", piece):
            code = int(piece[2:], 16) if piece[1] == "x" else int(piece[1:], 8) & 0xFF
            raw, plain = raw + bytes([code]), plain + chr(code)
        else:
            shown = LETTERS.get(piece[1:], piece[1:] or "\\") if piece[0] == "\\" else piece
            raw, plain = raw + shown.encode(), plain + shown
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return plain


def _number(token: Column) -> Column:
    """The code that a hexadecimal or octal escape names, null for any other piece."""
    hexadecimal = F.conv(F.substring(token, 3, 2), 16, 10).cast("int")
    octal = F.conv(F.substring(token, 2, 3), 8, 10).cast("int").bitwiseAND(F.lit(255))
    return F.when(token.rlike(r"^\\x[0-9A-Fa-f]"), hexadecimal).when(token.rlike(r"^\\[0-7]"), octal)


def _plain(token: Column) -> Column:
    """The text of any other piece: itself, a letter's control character, what a backslash stands before, or the backslash at the end."""
    letter = F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair])[F.substring(token, 2, 1)]
    return F.when(~token.startswith("\\") | (token == "\\"), token).otherwise(F.coalesce(letter, F.substring(token, 2, 1)))


def copy_unescape(field: Column) -> Column:
    """Decoded field, null for ``\\N``, by SQL functions alone: pieces become bytes, which form UTF-8 (else each code is a character)."""
    tokens = F.regexp_extract_all(field, F.lit(PIECE), F.lit(0))
    as_hex = F.transform(tokens, lambda t: F.coalesce(F.lpad(F.hex(_number(t)), 2, "0"), F.hex(_plain(t).cast("binary"))))
    whole = F.unhex(F.array_join(as_hex, "")).cast("string")
    each = F.array_join(F.transform(tokens, lambda t: F.coalesce(F.char(_number(t)), _plain(t))), "")
    return F.when(field == "\\N", F.lit(None)).when(field.contains("\\"), F.when(F.is_valid_utf8(whole), whole).otherwise(each)).otherwise(field)


def parse_lines(lines: DataFrame, columns: list[tuple[str, int]], value: str = "value") -> DataFrame:
    """Typed rows of raw ``lines``; ``columns`` are (name, type OID).  Missing fields are null."""
    parts = F.split(F.col(value), "\t")
    fields = [F.get(parts, F.lit(i)) for i in range(len(columns))]
    return lines.where(F.col(value) != "\\.").select(*[reg.parse(copy_unescape(f), oid).alias(n) for f, (n, oid) in zip(fields, columns)])


def read(spark: SparkSession, path: str, columns: list[tuple[str, int]]) -> DataFrame:
    """Only a line feed ends a line: carriage returns belong to the field."""
    return parse_lines(spark.read.text(path, lineSep="\n"), columns)
