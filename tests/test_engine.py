import random

import pytest

from tidemark.config import Config, mask_url, split_tables
from tidemark.engine import Engine
from tidemark.functions import types as reg
from tidemark.operators.snapshot import CommitConflict, SnapshotTable
from tidemark.plans import evolve, merge
from tidemark.plans.evolve import Change, Field
from tidemark.sources import pgoutput as pg
from tidemark.sources.copytext import unescape

FIELDS = [Field("id", reg.INT8, True), Field("name", reg.TEXT), Field("big", reg.TEXT)]
NAME = ("public", "t")


def change(lsn, op, key=None, row=None, toast=(), seq=0):
    text = lambda d: None if d is None else {k: None if v is None else str(v) for k, v in d.items()}
    return (lsn, seq, *NAME, 1, op, text(key), text(row), list(toast))


def rows(engine):
    return {r["id"]: (r["name"], r["big"]) for r in engine.table(*NAME).read().collect()}


def apply(engine, *changes, batch=None):
    return engine.apply(engine.spark.createDataFrame(list(changes), merge.CHANGELOG), {NAME: FIELDS}, batch)


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path))


def full(i, name="a", big="b"):
    return {"id": i, "name": name, "big": big}


def test_update_delete_revive_and_key_change(engine):
    apply(engine, change(1, "I", None, full(1)), change(2, "I", None, full(2)), change(3, "I", None, full(3)))
    apply(engine, change(4, "D", {"id": 3}), change(5, "I", None, full(3, "again")), change(6, "U", {"id": 1}, full(9, "moved")), change(7, "U", {"id": 2}, full(2, "x")), change(8, "D", {"id": 99}))
    assert rows(engine) == {9: ("moved", "b"), 2: ("x", "b"), 3: ("again", "b")}


def test_replay_changes_nothing(engine):
    batch = [change(1, "I", None, full(1)), change(2, "U", {"id": 1}, full(1, "z"))]
    apply(engine, *batch)
    version = engine.table(*NAME).version()
    assert apply(engine, *batch) == {} and engine.table(*NAME).version() == version


def test_truncate_is_a_barrier_and_needs_a_table(engine):
    assert apply(engine, change(1, "T")) == {}
    apply(engine, change(2, "I", None, full(1)))
    apply(engine, change(3, "I", None, full(2)), change(4, "T"), change(5, "I", None, full(3)))
    assert set(rows(engine)) == {3}


def test_unchanged_large_value_is_kept(engine):
    apply(engine, change(1, "I", None, full(1, "a", "huge")))
    apply(engine, change(2, "U", {"id": 1}, {"id": 1, "name": "n", "big": None}, ["big"]))
    assert rows(engine) == {1: ("n", "huge")}


def test_changes_of_one_position_in_two_batches(engine):
    apply(engine, change(5, "I", None, full(1), seq=0))
    apply(engine, change(5, "I", None, full(1), seq=0), change(5, "I", None, full(2), seq=1))
    assert set(rows(engine)) == {1, 2}
    apply(engine, change(9, "T", seq=0), change(9, "I", None, full(3), seq=1))
    assert set(rows(engine)) == {3}


def test_inserts_append_and_deletes_of_a_missing_table_do_nothing(engine):
    assert apply(engine, change(1, "D", {"id": 1})) == {} and not engine.table(*NAME).exists()
    for i in (2, 3, 4):
        apply(engine, change(i, "I", None, full(i)))
    facts = [(s["operation"], s["n_files"]) for s in engine.table(*NAME).snapshots()]
    assert [o for o, _ in facts] == ["append"] * 3 and facts[-1][1] >= 3
    old = set(engine.table(*NAME).files())
    apply(engine, change(5, "U", {"id": 3}, full(3, "new")))
    assert len(old & set(engine.table(*NAME).files())) == 2 and rows(engine)[3] == ("new", "b")


@pytest.mark.parametrize("on_read", [False, True])
def test_random_feeds_in_both_modes(engine, on_read):
    engine.config.merge_on_read = on_read
    rng, live, log = random.Random(17), {}, []
    for lsn in range(1, 60):
        key = rng.randrange(6)
        if key in live and rng.random() < 0.4:
            del live[key]
            log.append(change(lsn, "D", {"id": key}))
        elif key in live:
            live[key] = (str(lsn), "b")
            log.append(change(lsn, "U", {"id": key}, full(key, lsn)))
        else:
            live[key] = (str(lsn), "b")
            log.append(change(lsn, "I", None, full(key, lsn)))
    for a in range(0, len(log), 13):
        apply(engine, *log[a : a + 13])
    assert rows(engine) == live
    engine.table(*NAME).compact()
    assert rows(engine) == live and engine.table(*NAME).entries(kind="delete") == []


def test_updates_without_a_key_are_counted(engine):
    apply(engine, change(1, "I", None, full(1)), change(2, "D"))
    assert engine.table(*NAME).snapshots()[-1]["summary"]["skipped-keyless"] == "1" and set(rows(engine)) == {1}


def test_an_undescribed_table_fails_after_the_others(engine):
    rows_ = [change(1, "I", None, full(1)), (2, 0, "public", "other", 1, "I", None, {"x": "1"}, [])]
    with pytest.raises(KeyError, match="other"):
        apply(engine, *rows_)
    assert set(rows(engine)) == {1}


def test_stale_views_go(engine):
    apply(engine, change(1, "I", None, full(1)))
    assert engine.refresh() == ["public_t", "t"] and engine.sql("select count(*) as n from t").first()["n"] == 1
    engine.cleanup(["public.t"])
    assert engine.refresh() == []
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        engine.sql("select * from t")


def test_null_key_delete(spark):
    base = spark.createDataFrame([(None, "a"), (1, "b")], "k int, v string")
    gone = spark.createDataFrame([(None,)], "k int")
    assert [r["v"] for r in merge.anti_join(base, gone, ["k"]).collect()] == ["b"]


def test_random_feeds_match_a_replay(engine):
    rng, live, log = random.Random(7), {}, []
    for lsn in range(1, 80):
        key = rng.randrange(8)
        if key not in live:
            live[key] = (str(lsn), "b")
            log.append(change(lsn, "I", None, full(key, lsn)))
        elif rng.random() < 0.3:
            del live[key]
            log.append(change(lsn, "D", {"id": key}))
        else:
            to = rng.choice([key, *[k for k in range(12) if k not in live]])
            del live[key]
            live[to] = (str(lsn), "b")
            log.append(change(lsn, "U", {"id": key}, full(to, lsn)))
    for a in range(0, len(log), 27):
        apply(engine, *log[a : a + 27])
    assert rows(engine) == live


@pytest.mark.parametrize("part", ["/manifest-", "/list-", "/v3.json", "version-hint"])
def test_after_a_failed_commit_the_old_version_shows_and_the_next_write_succeeds(spark, tmp_path, monkeypatch, part):
    t = SnapshotTable(spark, str(tmp_path), "s", "t").create(evolve.initial(FIELDS))
    two = spark.createDataFrame([(2, "a", "b")], "id bigint, name string, big string")
    t.append(spark.createDataFrame([(1, "a", "b")], "id bigint, name string, big string"))
    write = t.store.write

    def broken(name, text, overwrite):
        if part in name:
            raise OSError("disk on fire")
        write(name, text, overwrite)

    monkeypatch.setattr(t.store, "write", broken)
    with pytest.raises(OSError):
        t.overwrite(two)
    monkeypatch.setattr(t.store, "write", write)
    assert [r["id"] for r in t.read().collect()] == [1]
    assert t.append(two) == 3 and sorted(r["id"] for r in t.read().collect()) == [1, 2]


def test_another_writer_replaces_an_orphan_only_when_it_is_old(spark, tmp_path, monkeypatch):
    from tidemark.operators import snapshot

    one = spark.createDataFrame([(1, "a", "b")], "id bigint, name string, big string")
    t = SnapshotTable(spark, str(tmp_path), "s", "t").create(evolve.initial(FIELDS))
    t.store.write(t._meta("v2.json"), '{"owner": "someone"}', overwrite=False)
    other = SnapshotTable(spark, str(tmp_path), "s", "t")
    with pytest.raises(CommitConflict):
        other.append(one)
    monkeypatch.setattr(snapshot, "GRACE", -1)
    assert other.append(one) == 2 and other.read().count() == 1


def test_second_writer_of_a_version_fails(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path), "s", "t").create(evolve.initial(FIELDS))
    one = spark.createDataFrame([(1, "a", "b")], "id bigint, name string, big string")
    t.commit(one, "append", base=1)
    with pytest.raises(CommitConflict):
        t.commit(one, "append", base=1)


def test_evolution_guards_and_ids():
    s = evolve.initial([Field("a", reg.INT4), Field("b", reg.TEXT)])
    s, last = evolve.evolve(s, [Change("DROP", "b"), Change("ADD", "b", Field("b", reg.TEXT)), Change("TYPE", "a", Field("a", reg.INT8))], 2)
    assert last == 3 and s["b"].metadata[evolve.FIELD_ID] == 3 and s["a"].dataType.simpleString() == "bigint"
    with pytest.raises(ValueError):
        evolve.evolve(s, [Change("TYPE", "a", Field("a", reg.TEXT))], last)


def test_expire_keeps_the_live_files(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path), "s", "t").create(evolve.initial(FIELDS))
    for i in range(3):
        t.overwrite(spark.createDataFrame([(i, "a", "b")], "id bigint, name string, big string"))
    assert t.expire() == 2 and [r["id"] for r in t.read().collect()] == [2]


@pytest.mark.parametrize("rows_per_file, files", [(2, 3), (0, 1)])
def test_files_are_split_by_rows_as_configured(spark, tmp_path, rows_per_file, files):
    engine = Engine(spark, str(tmp_path), Config(rows_per_file=rows_per_file))
    table = engine.table(*NAME).create(evolve.initial(FIELDS))
    table.append(spark.createDataFrame([(i, "a", "b") for i in range(5)], "id long, name string, big string").coalesce(1))
    assert len(table.files()) == files and table.read().count() == 5


def test_pruned_merge_counts_three_files_whatever_the_split(spark, tmp_path, monkeypatch):
    from tidemark.plans import queries

    monkeypatch.setattr(queries, "_engine", lambda s: Engine(s, str(tmp_path), Config(rows_per_file=100)))
    got = queries.t_pruned_merge(spark, "/root/testdata/sf0.001").collect()
    assert {r["files_kept"] for r in got} == {2} and not {r["event_id"] for r in got} & set(range(120, 131))


def test_decoder():
    d = pg.Decoder()
    assert d.decode(1, pg.relation(5, "public", "t", FIELDS)) == []
    assert d.decode(2, pg.insert(5, ["1", None, "x"]))[0]["new_row"] == {"id": "1", "name": None, "big": "x"}
    u = d.decode(3, pg.update(5, ["1", "n", pg.SAME]))[0]
    assert u["old_key"] == {"id": "1"} and u["toast"] == ["big"] and d.warnings
    u = d.decode(4, pg.update(5, ["2", "n", pg.SAME], ["1", "m", "old"], "O"))[0]
    assert u["old_key"] == {"id": "1"} and u["new_row"]["big"] == "old" and u["toast"] == []
    assert d.decode(5, pg.delete(5, ["1", None, None]))[0]["old_key"] == {"id": "1"}
    assert [r["op"] for r in d.decode(6, pg.truncate([5, 77]))] == ["T"]
    with pytest.raises(ValueError):
        d.decode(7, pg.insert(99, []))
    d.decode(8, pg.relation(5, "public", "t", FIELDS[:2]))
    assert [c.kind for c in d.relations[5].changes] == ["DROP"] and d.relations[5].version == 2


@pytest.mark.parametrize("raw,out", [("a\\tb", "a\tb"), ("\\\\n", "\\n"), ("\\x41\\101", "AA"), ("\\q", "q"), ("end\\", "end\\"), ("\\xc3\\xa9", "é")])
def test_copy_escapes(raw, out):
    assert unescape(raw) == out


def test_backfill_then_changes(engine, tmp_path):
    (tmp_path / "dump").write_text("1\ta\\tb\t\\N\n2\tz\tq\n")
    engine.resync(*NAME, str(tmp_path / "dump"), FIELDS, 10)
    apply(engine, change(10, "D", {"id": 1}), change(11, "D", {"id": 2}))
    assert rows(engine) == {1: ("a\tb", None)}
    assert engine.sql("select count(*) as n from t where id > :low", low=0).first()["n"] == 1
    assert engine.sql(" ;") is None and engine.resolve("t") == NAME
    assert engine.cleanup(["public.t"], dry_run=True) and engine.cleanup(["public.t"]) and not engine.tables()


def test_config():
    c = Config.load({"TIDEMARK_SOURCE_URL": "x", "TIDEMARK_FLUSH_ROWS": "5"}, root="r", include_tables="a, b,")
    assert c.flush_rows == 5 and c.include_tables == ["a", "b"]
    c.validate()
    with pytest.raises(ValueError):
        Config.load({}, exclude_tables="a", include_tables="b").validate()
    assert mask_url("postgres://u:secret@h/d") == "postgres://u:***@h/d" and split_tables(" a,,b ") == ["a", "b"]


def messages(path, batches):
    """A log of one file; each batch of messages is a transaction."""
    from tidemark.streaming.messages import frame

    lsn, out = 0, b""
    for batch in batches:
        for m in (b"B" + bytes(20), *batch, b"C" + bytes(25)):
            lsn += 1
            out += frame(lsn, m)
    path.mkdir(exist_ok=True)
    (path / "1.log").write_bytes(out)
    return out


def test_message_log_keeps_transactions_whole(tmp_path):
    from tidemark.streaming.messages import MessageReader

    batches = [[pg.relation(5, *NAME, FIELDS), pg.insert(5, ["1", "a", "b"])], [pg.insert(5, [str(i), "a", "b"]) for i in range(2, 6)], [pg.truncate([5, 5])]]
    data = messages(tmp_path / "log", batches)
    reader = MessageReader({"path": str(tmp_path / "log"), "slot": "s", "flushRows": "3"})
    start = reader.initialOffset()
    first, middle = reader.read(start)
    first = list(first)
    assert [r[5] for r in first] == ["R", "I", "I", "I", "I", "I"]
    rest, end = reader.read(middle)
    rest = list(rest)
    assert [(r[5], r[1]) for r in rest] == [("T", first[-1][1] + 1), ("T", first[-1][1] + 2)]
    assert list(reader.readBetweenOffsets(start, middle)) == first and list(reader.read(end)[0]) == []
    reader.commit(middle)
    assert MessageReader({"path": str(tmp_path / "log"), "slot": "s"}).initialOffset() == middle
    (tmp_path / "log" / "1.log").write_bytes(data[:-30])  # the last commit isn't there yet
    assert list(reader.read(middle)[0]) == []
    assert list(MessageReader({"path": str(tmp_path / "log"), "publication": "public.other"}).read(start)[0]) == []


def test_sync_by_command_line(spark, tmp_path, capsys):
    from tidemark import cli

    messages(tmp_path / "log", [[pg.relation(5, *NAME, FIELDS), pg.insert(5, ["1", "a", "b"]), pg.insert(5, ["2", "x", None])], [pg.relation(5, *NAME, [*FIELDS, Field("n", reg.INT4)]), pg.update(5, ["2", "y", None, "7"])]])
    root = str(tmp_path / "lake")
    assert cli.main(["--root", root, "sync", "--source-url", str(tmp_path / "log"), "--checkpoint", str(tmp_path / "ck"), "--once", "--flush-rows", "1"]) == 0
    assert cli.main(["--root", root, "query", "select id, name, n from t order by id"]) == 0
    assert capsys.readouterr().out.splitlines() == ['{"id": 1, "name": "a", "n": null}', '{"id": 2, "name": "y", "n": 7}']
    assert cli.main(["--root", root, "cleanup", "--table", "public.t", "--dry-run"]) == 0 and "public/t" in capsys.readouterr().out
    assert cli.main(["--root", root, "cleanup", "--table", "public.t", "--force"]) == 0
    (tmp_path / "dump").write_text("5\tq\t\\N\n")
    (tmp_path / "fields.json").write_text('{"public.t": [{"name": "id", "oid": 20, "is_key": true}, {"name": "name", "oid": 25}, {"name": "big", "oid": 25}]}')
    assert cli.main(["--root", root, "resync", "--table", "public.t", "--dump", str(tmp_path / "dump"), "--fields", str(tmp_path / "fields.json"), "--lsn", "0/10", "--force"]) == 0
    assert [r["id"] for r in Engine(spark, root).table(*NAME).read().collect()] == [5]


class Client:
    """As much of a wire client as the test needs."""

    def __init__(self, port):
        import socket
        import struct

        self.struct, self.s = struct, socket.create_connection(("127.0.0.1", port))
        self.s.sendall(struct.pack(">II", 8, 80877103))
        assert self.s.recv(1) == b"N"
        body = struct.pack(">I", 196608) + b"user\0u\0\0"
        self.s.sendall(struct.pack(">I", len(body) + 4) + body)
        self.until_ready()

    def send(self, kind, body=b""):
        self.s.sendall(kind + self.struct.pack(">I", len(body) + 4) + body)

    def take(self, n):
        out = b""
        while len(out) < n:
            out += self.s.recv(n - len(out))
        return out

    def until_ready(self):
        out = []
        while True:
            kind = self.take(1)
            body = self.take(self.struct.unpack(">I", self.take(4))[0] - 4)
            if kind == b"Z":
                return out
            out.append((kind, body))

    def rows(self, found):
        out = []
        for kind, body in found:
            if kind == b"D":
                at, row = 2, []
                for _ in range(self.struct.unpack(">H", body[:2])[0]):
                    (n,) = self.struct.unpack(">i", body[at : at + 4])
                    row.append(None if n < 0 else body[at + 4 : at + 4 + n].decode())
                    at += 4 + max(n, 0)
                out.append(tuple(row))
        return out


def test_wire_server(engine):
    import struct

    from tidemark.server import Server, named, statements

    assert statements("select ';' ; -- a;b\n select 2;") == ["select ';'", "-- a;b\n select 2"] and named("select $1, '$2'") == "select :p1, '$2'"
    apply(engine, change(1, "I", None, full(1)), change(2, "I", None, {"id": 2, "name": None, "big": "é"}))
    server = Server(engine, "127.0.0.1:0", refresh_every=0.2).start()
    try:
        c = Client(server.server_address[1])
        c.send(b"Q", b"select id, name, big from t order by id; select true as yes\0")
        found = c.until_ready()
        assert c.rows(found) == [("1", "a", "b"), ("2", None, "é"), ("t",)] and [b for k, b in found if k == b"C"] == [b"SELECT 2\0", b"SELECT 1\0"]
        c.send(b"Q", b"select nothing from nowhere\0")
        assert [k for k, _ in c.until_ready()] == [b"E"]
        c.send(b"Q", b";\0")
        assert [k for k, _ in c.until_ready()] == [b"I"]
        c.send(b"P", b"s\0select name from t where id = $1\0" + struct.pack(">HI", 1, reg.INT8))
        c.send(b"B", b"\0s\0" + struct.pack(">HHi", 0, 1, 1) + b"1" + struct.pack(">H", 0))
        c.send(b"D", b"P\0")
        c.send(b"E", b"\0" + struct.pack(">I", 0))
        c.send(b"S")
        found = c.until_ready()
        assert [k for k, _ in found] == [b"1", b"2", b"T", b"D", b"C"] and c.rows(found) == [("a",)]
        c.send(b"X")
    finally:
        server.stop()


def test_ack_and_lsn():
    assert merge.safe_ack(100, [50, 70]) == 49 and merge.safe_ack(100, []) == 100
    assert reg.parse_lsn(reg.format_lsn(0x1_0000_00FF)) == 0x1_0000_00FF
