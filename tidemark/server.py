"""A server for SQL clients over the PostgreSQL wire protocol (version 3): simple and extended queries, results as text."""

from __future__ import annotations

import logging
import re
import socketserver
import struct
import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import Engine
from .functions import types as reg

log = logging.getLogger("tidemark")

# Codes that a client sends first, and what the server says of itself.
SSL, GSS, CANCEL = 80877103, 80877104, 80877102
STATUS = {"server_version": "14.0", "server_encoding": "UTF8", "client_encoding": "UTF8", "DateStyle": "ISO, MDY", "TimeZone": "UTC", "integer_datetimes": "on", "standard_conforming_strings": "on"}
QUOTED = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/|;|\$\d+", re.S)


def statements(text: str) -> list[str]:
    """The statements of ``text``; semicolons in quotes and comments don't end one."""
    cuts = [m.start() for m in QUOTED.finditer(text) if m[0] == ";"]
    return [part for a, b in zip([-1, *cuts], [*cuts, len(text)]) if (part := text[a + 1 : b].strip())]


def named(text: str) -> str:
    """``$1`` as ``:p1``, outside of quotes and comments."""
    return QUOTED.sub(lambda m: f":p{m[0][1:]}" if m[0][0] == "$" else m[0], text)


def cstr(text: str) -> bytes:
    return text.encode() + b"\0"


class Session(socketserver.StreamRequestHandler):
    server: Server

    def say(self, kind: bytes, body: bytes = b"") -> None:
        self.wfile.write(kind + struct.pack(">I", len(body) + 4) + body)

    def ready(self) -> None:
        self.say(b"Z", b"I")
        self.wfile.flush()

    def take(self, n: int) -> bytes:
        data = self.rfile.read(n)
        if len(data) < n:
            raise ConnectionError
        return data

    def greet(self) -> bool:
        while True:
            (size,) = struct.unpack(">I", self.take(4))
            (code,) = struct.unpack(">I", self.take(size - 4)[:4])
            if code in (SSL, GSS):
                self.wfile.write(b"N")
            elif code == CANCEL:
                return False
            else:
                break
        self.say(b"R", struct.pack(">I", 0))
        for k, v in STATUS.items():
            self.say(b"S", cstr(k) + cstr(v))
        self.say(b"K", struct.pack(">II", threading.get_ident() & 0x7FFFFFFF, 0))
        self.ready()
        return True

    def handle(self) -> None:
        try:
            if self.greet():
                self.talk()
        except (ConnectionError, BrokenPipeError):
            pass

    def fail(self, error: Exception) -> None:
        text = str(error).split("\n")[0] or type(error).__name__
        log.info("query failed: %s", text)
        self.say(b"E", b"SERROR\0C42601\0" + b"M" + cstr(text) + b"\0")

    def described(self, df: DataFrame) -> None:
        body = struct.pack(">H", len(df.columns))
        for f in df.schema.fields:
            body += cstr(f.name) + struct.pack(">IHIhih", 0, 0, reg.wire_oid(f.dataType), -1, -1, 0)
        self.say(b"T", body)

    def sent(self, df: DataFrame) -> int:
        neutral = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        plain = neutral.select(*[reg.render(F.col(f"c{i}"), reg.wire_oid(f.dataType)).alias(f"c{i}") for i, f in enumerate(df.schema.fields)])
        n = 0
        for row in plain.toLocalIterator(prefetchPartitions=True):  # a partition at a time
            cells = (struct.pack(">i", -1) if v is None else struct.pack(">i", len(b := v.encode())) + b for v in row)
            self.say(b"D", struct.pack(">H", len(row)) + b"".join(cells))
            n += 1
        return n

    def run(self, text: str, args: dict, describe: bool) -> None:
        df = self.server.engine.sql(text, fresh=False, **args)
        if df is None:
            self.say(b"I")
        elif not df.columns:
            self.say(b"C", cstr(text.split()[0].upper()))
        else:
            if describe:
                self.described(df)
            self.say(b"C", cstr(f"SELECT {self.sent(df)}"))

    def talk(self) -> None:
        prepared: dict[str, tuple[str, list[int]]] = {}
        bound: dict[str, tuple[str, dict]] = {}
        skip = False  # after an error, to the next Sync
        while True:
            kind = self.take(1)
            (size,) = struct.unpack(">I", self.take(4))
            body = self.take(size - 4)
            if kind == b"X":
                return
            if kind == b"S":
                skip = False
                self.ready()
                continue
            if skip:
                continue
            try:
                if kind == b"Q":
                    found = statements(body[:-1].decode())
                    for text in found or [""]:
                        self.run(text, {}, True)
                elif kind == b"P":
                    name, text, rest = body.split(b"\0", 2)
                    (n,) = struct.unpack(">H", rest[:2])
                    prepared[name.decode()] = named(text.decode()), list(struct.unpack(f">{n}I", rest[2 : 2 + 4 * n]))
                    self.say(b"1")
                elif kind == b"B":
                    portal, name, rest = body.split(b"\0", 2)
                    text, oids = prepared[name.decode()]
                    bound[portal.decode()] = text, {f"p{i}": v for i, v in enumerate(self.values(rest, oids), 1)}
                    self.say(b"2")
                elif kind == b"D":
                    name = body[1:-1].decode()
                    text, args = bound[name] if body[:1] == b"P" else (prepared[name][0], {f"p{m}": None for m in re.findall(r":p(\d+)", prepared[name][0])})
                    if body[:1] == b"S":
                        self.say(b"t", struct.pack(">H", len(args)) + b"".join(struct.pack(">I", reg.TEXT) for _ in args))
                    df = self.server.engine.sql(text, fresh=False, **args)
                    self.say(b"n") if df is None or not df.columns else self.described(df)
                elif kind == b"E":
                    text, args = bound[body.split(b"\0", 1)[0].decode()]
                    self.run(text, args, False)
                elif kind == b"C":
                    (prepared if body[:1] == b"S" else bound).pop(body[1:-1].decode(), None)
                    self.say(b"3")
            except ConnectionError:
                raise
            except Exception as e:
                self.fail(e)
                skip = kind != b"Q"
            if kind == b"Q":
                self.ready()
            elif kind == b"H":
                self.wfile.flush()

    @staticmethod
    def values(rest: bytes, oids: list[int]) -> Iterator[object]:
        (n,) = struct.unpack(">H", rest[:2])
        formats = struct.unpack(f">{n}H", rest[2 : 2 + 2 * n])
        at = 2 + 2 * n
        (count,) = struct.unpack(">H", rest[at : at + 2])
        at += 2
        for i in range(count):
            (size,) = struct.unpack(">i", rest[at : at + 4])
            at += 4
            if size < 0:
                yield None
                continue
            raw, at = rest[at : at + size], at + size
            if formats and formats[min(i, len(formats) - 1)]:
                yield int.from_bytes(raw, "big", signed=True) if size in (2, 4, 8) else raw
                continue
            text, oid = raw.decode(), oids[i] if i < len(oids) else 0
            yield int(text) if oid in (reg.INT2, reg.INT4, reg.INT8) else float(text) if oid in (reg.FLOAT4, reg.FLOAT8) else text == "t" if oid == reg.BOOL else text


class Server(socketserver.ThreadingTCPServer):
    allow_reuse_address, daemon_threads = True, True

    def __init__(self, engine: Engine, address: str | None = None, refresh_every: float = 5.0):
        host, _, port = (address or engine.config.listen_addr).rpartition(":")
        self.engine, self.refresh_every, self.ending = engine, refresh_every, threading.Event()
        engine.refresh()
        super().__init__((host, int(port)), Session)

    def _refreshing(self) -> None:
        while not self.ending.wait(self.refresh_every):
            try:
                self.engine.refresh()
            except Exception:
                log.exception("refresh failed; the views stay as they are")

    def start(self) -> Server:
        for run in (self.serve_forever, self._refreshing):
            threading.Thread(target=run, daemon=True).start()
        return self

    def stop(self) -> None:
        self.ending.set()
        self.shutdown()
        self.server_close()
