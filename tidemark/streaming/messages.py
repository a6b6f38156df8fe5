"""A stream of change rows from a log of binary replication messages.

The log is a folder of ``*.log`` files, read in the order of their names; each holds frames: position (LSN, eight
bytes), length (four bytes, both big-endian) and a message.  A keepalive is the message ``k``: it moves the
position and carries nothing else.  A batch ends at the first commit after ``flushRows`` rows, so
no transaction is split; a transaction that is not complete yet waits.  The offset holds what the decoder
knows of the tables, so any batch can be read again by itself.

A *slot* remembers up to where batches are done; a new stream of the same slot goes on there.  A
*publication* names the tables (``schema.table`` or ``table``, comma-separated) whose changes are passed on;
empty passes all.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..config import split_tables
from ..plans.evolve import Field
from ..plans.merge import CHANGELOG
from ..sources.pgoutput import Decoder, Relation

HEADER = struct.Struct(">QI")
COLUMNS = [c.split()[0] for c in CHANGELOG.split(", ")]


def frame(lsn: int, message: bytes) -> bytes:
    return HEADER.pack(lsn, len(message)) + message


class Files:
    """The log through Arrow's file systems, so stores other than the local disk will do."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        self.root = self.root.rstrip("/")

    def names(self) -> list[str]:
        from pyarrow import fs

        return sorted(f.base_name for f in self.fs.get_file_info(fs.FileSelector(self.root, allow_not_found=True)) if f.is_file and f.base_name.endswith(".log"))

    def read(self, name: str, at: int = 0) -> bytes:
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            f.seek(min(at, f.size()))
            return f.read()

    def write(self, name: str, text: str) -> None:
        path = f"{self.root}/{name}"
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with self.fs.open_output_stream(f"{path}.tmp") as f:
            f.write(text.encode())
        self.fs.move(f"{path}.tmp", path)

    def text(self, name: str) -> str | None:
        try:
            return self.read(name).decode()
        except FileNotFoundError:
            return None


class Slot:
    """Created on first use, then used again: the offset up to which a consumer is done."""

    def __init__(self, files: Files, name: str):
        self.files, self.path = files, f"_slots/{name}.json"

    def confirmed(self) -> dict | None:
        text = self.files.text(self.path)
        return json.loads(text) if text else None

    def confirm(self, offset: dict) -> None:
        self.files.write(self.path, json.dumps(offset))


def restored(offset: dict) -> Decoder:
    out = Decoder(announce=True)
    for rel, (schema, table, version, fields) in offset["relations"].items():
        out.relations[int(rel)] = Relation(int(rel), schema, table, [Field(**f) for f in fields], version)
    return out


def remembered(decoder: Decoder) -> dict:
    return {str(r.rel_id): [r.schema, r.table, r.version, [vars(f) for f in r.fields]] for r in decoder.relations.values()}


class MessageReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.files = Files(options["path"])
        self.slot = Slot(self.files, options["slot"]) if options.get("slot") else None
        self.tables = split_tables(options.get("publication", ""))
        self.most = int(options.get("flushrows", options.get("flushRows", 10_000)))

    def initialOffset(self) -> dict:
        found = self.slot.confirmed() if self.slot else None
        return found or {"file": "", "at": 0, "lsn": 0, "seq": 0, "relations": {}}

    def _frames(self, start: dict) -> Iterator[tuple[str, int, int, bytes]]:
        """File, end, position and message of each whole frame."""
        for name in self.files.names():
            if name < start["file"]:
                continue
            base = start["at"] if name == start["file"] else 0
            data, at = self.files.read(name, base), 0
            while at + HEADER.size <= len(data):
                lsn, size = HEADER.unpack_from(data, at)
                if at + HEADER.size + size > len(data):
                    return  # still being written
                yield name, base + at + HEADER.size + size, lsn, data[at + HEADER.size : at + HEADER.size + size]
                at += HEADER.size + size

    def _wanted(self, row: dict) -> bool:
        return not self.tables or row["table_name"] in self.tables or f"{row['schema_name']}.{row['table_name']}" in self.tables

    def _batch(self, start: dict, until: dict | None) -> tuple[list[tuple], dict]:
        decoder, rows, open_, end, seq = restored(start), [], [], start, start["seq"]
        inside = False
        for name, at, lsn, message in self._frames(start):
            kind = message[:1]
            if kind == b"B":
                inside = True
            elif kind == b"C":
                inside = False
            elif kind != b"k":
                for row in decoder.decode(lsn, message, seq):
                    seq = row["seq"] + 1
                    open_.append(row)
            if not inside:
                rows += [tuple(r[c] for c in COLUMNS) for r in open_ if self._wanted(r)]
                open_ = []
                end = {"file": name, "at": at, "lsn": lsn, "seq": seq, "relations": remembered(decoder)}
                if (until and (name, at) >= (until["file"], until["at"])) or (not until and len(rows) >= self.most):
                    break
        return rows, end

    def read(self, start: dict):
        rows, end = self._batch(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._batch(start, end)[0])

    def commit(self, end: dict) -> None:
        if self.slot:
            self.slot.confirm(end)


class MessageLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_messages"

    def schema(self) -> str:
        return CHANGELOG

    def simpleStreamReader(self, schema) -> MessageReader:
        return MessageReader(self.options)
