"""Schema evolution by field identity."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import types as T

from ..functions import types as reg

FIELD_ID, DEFAULT = "parquet.field.id", "default_text"


@dataclass(frozen=True)
class Field:
    name: str
    oid: int
    is_key: bool = False
    typmod: int = -1


@dataclass(frozen=True)
class Change:
    kind: str  # ADD, DROP, TYPE, KEY
    name: str
    field: Field | None = None


def diff_fields(old: list[Field], new: list[Field]) -> list[Change]:
    """By name: fields added, dropped, of another type, and whether the key differs."""
    before, after = {f.name: f for f in old}, {f.name: f for f in new}
    out = [Change("ADD", f.name, f) for f in new if f.name not in before]
    out += [Change("DROP", f.name, f) for f in old if f.name not in after]
    out += [Change("TYPE", f.name, f) for f in new if f.name in before and before[f.name].oid != f.oid]
    if [f.name for f in old if f.is_key] != [f.name for f in new if f.is_key]:
        out.append(Change("KEY", ",".join(f.name for f in new if f.is_key)))
    return out


def initial(fields: list[Field], decimals: bool = False) -> T.StructType:
    return T.StructType([T.StructField(f.name, reg.spark_type(f.oid, f.typmod, decimals), True, {FIELD_ID: i, "oid": f.oid, "is_key": f.is_key}) for i, f in enumerate(fields, 1)])


def fields_of(schema: T.StructType) -> list[Field]:
    return [Field(f.name, f.metadata.get("oid", reg.TEXT), f.metadata.get("is_key", False)) for f in schema.fields]


def literal(default: str | None) -> str | None:
    """The text of a constant default such as ``'active'::text``; None for anything that is computed."""
    if default is None:
        return None
    m = re.fullmatch(r"\s*(?:'((?:[^']|'')*)'|(-?\d+(?:\.\d+)?)|(true|false))(?:::[\w\s\"\[\]()]+)?\s*", default)
    return None if m is None else m[1].replace("''", "'") if m[1] is not None else m[2] or m[3]


def evolve(schema: T.StructType, changes: list[Change], last_id: int, defaults: dict[str, str] | None = None) -> tuple[T.StructType, int]:
    """The schema after ``changes`` and the last field ID.  IDs are never used again; only int -> long and float -> double widen."""
    fields = list(schema.fields)
    for c in changes:
        at = next((i for i, f in enumerate(fields) if f.name == c.name), None)
        if c.kind == "DROP" and at is not None:
            del fields[at]
        elif c.kind == "TYPE":
            new = reg.spark_type(c.field.oid, c.field.typmod)
            if at is None or not reg.can_widen(fields[at].dataType, new):
                raise ValueError(f"column {c.name}: {fields[at].dataType.simpleString() if at is not None else 'missing'} can't become {new.simpleString()}")
            fields[at] = T.StructField(c.name, new, True, {**fields[at].metadata, "oid": c.field.oid})
        elif c.kind == "ADD" and at is None:
            last_id += 1
            meta = {FIELD_ID: last_id, "oid": c.field.oid, "is_key": c.field.is_key}
            if (text := literal((defaults or {}).get(c.name))) is not None:
                meta[DEFAULT] = text
            fields.append(T.StructField(c.name, reg.spark_type(c.field.oid, c.field.typmod), True, meta))
        elif c.kind == "KEY":
            keys = set(c.name.split(","))
            fields = [T.StructField(f.name, f.dataType, True, {**f.metadata, "is_key": f.name in keys}) for f in fields]
    return T.StructType(fields), last_id


def reconcile(stored: T.StructType, stream: list[Field]) -> list[Change]:
    """What changed while nobody watched: the stored schema against the stream's description."""
    return [c for c in diff_fields(fields_of(stored), stream) if c.kind != "TYPE" or reg.spark_type(c.field.oid) != stored[c.name].dataType]


def to_json(schema: T.StructType) -> dict:
    return json.loads(schema.json())


def from_json(data: dict) -> T.StructType:
    return T.StructType.fromJson(data)
