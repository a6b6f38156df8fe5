"""Command line: ``python -m tidemark.cli query|serve|cleanup|resync|sync``."""

from __future__ import annotations

import argparse
import json
import sys

from .config import Config
from .plans.evolve import Field


def fields_from(path: str) -> dict[tuple[str, str], list[Field]]:
    """``{"schema.table": [{"name":, "oid":, "is_key":}, ...]}``"""
    with open(path) as f:
        return {tuple(k.split(".", 1)): [Field(**x) for x in v] for k, v in json.load(f).items()}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark")
    top.add_argument("--root")
    top.add_argument("--log-level")
    sub = top.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query")
    q.add_argument("sql")
    v = sub.add_parser("serve")
    v.add_argument("--listen-addr")
    c = sub.add_parser("cleanup")
    c.add_argument("--table", action="append", required=True)
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--force", action="store_true")
    r = sub.add_parser("resync")
    r.add_argument("--table", required=True)
    r.add_argument("--dump", required=True)
    r.add_argument("--fields", required=True)
    r.add_argument("--lsn", required=True)
    r.add_argument("--force", action="store_true")
    s = sub.add_parser("sync")
    s.add_argument("--source-url", required=True, help="folder of message logs, or with --parquet of change-log Parquet files")
    s.add_argument("--fields", help="columns of the tables, where the stream doesn't tell them")
    s.add_argument("--parquet", action="store_true")
    s.add_argument("--slot-name")
    s.add_argument("--publication")
    s.add_argument("--merge-on-read", action="store_const", const=True)
    s.add_argument("--checkpoint", required=True)
    s.add_argument("--flush-rows", type=int)
    s.add_argument("--flush-interval", type=float)
    s.add_argument("--include-tables")
    s.add_argument("--exclude-tables")
    s.add_argument("--once", action="store_true")
    return top


def confirmed(what: str, force: bool) -> bool:
    return force or input(f"Delete {what}? [y/N] ").strip().lower() == "y"


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from .engine import Engine
    from .functions import types as reg
    from .plans import merge

    args = parser().parse_args(argv)
    flags = {k: v for k, v in vars(args).items() if k in Config.__dataclass_fields__}
    config = Config.load(**flags)
    config.validate() if args.command == "sync" else config.validate_query()
    spark = SparkSession.builder.getOrCreate()
    engine = Engine(spark, config.root, config)
    if args.command == "query":
        out = engine.sql(args.sql)
        for row in out.toLocalIterator() if out is not None else ():
            print(json.dumps(row.asDict(recursive=True), default=str))
    elif args.command == "serve":
        from .server import Server

        Server(engine).start().ending.wait()
    elif args.command == "cleanup":
        found = engine.cleanup(args.table, dry_run=True)
        if not args.dry_run and found and confirmed(", ".join(found), args.force):
            engine.cleanup(args.table)
        print("\n".join(found))
    elif args.command == "resync":
        schema, _, table = args.table.partition(".")
        if confirmed(f"and copy {args.table} again", args.force):
            engine.resync(schema, table, args.dump, fields_from(args.fields)[schema, table], reg.parse_lsn(args.lsn))
    else:
        fields = fields_from(args.fields) if args.fields else None

        def source():
            # Admission: a message log ends batches after flush_rows rows, a Parquet log takes a file at a time.
            return spark.readStream.schema(merge.CHANGELOG).option("maxFilesPerTrigger", 1).parquet(config.source_url) if args.parquet else engine.stream()

        if args.once:
            engine.catch_up(source(), fields, args.checkpoint)
        else:
            engine.supervise(lambda: engine.sync(source(), fields, args.checkpoint))
    return 0


if __name__ == "__main__":
    sys.exit(main())
