"""Command line: ``python -m vecframe.cli --root DIR COMMAND``."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Sequence
from typing import Any

from vecframe.cache.registry import cache_stats, clear_all, configure, get_cache
from vecframe.errors import VecframeError


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vecframe")
    p.add_argument("--root", required=True)
    p.add_argument("--database", default="default")
    sub = p.add_subparsers(dest="command", required=True)
    sync = sub.add_parser("sync", help="create the collections of a module's models")
    sync.add_argument("module")
    sync.add_argument("--drop-existing", action="store_true")
    stats = sub.add_parser("stats", help="row counts, fields, indexes, partitions")
    stats.add_argument("names", nargs="*")
    stats.add_argument("--json", action="store_true")
    drop = sub.add_parser("drop", help="drop collections")
    drop.add_argument("names", nargs="+")
    drop.add_argument("--yes", action="store_true")
    query = sub.add_parser("query", help="rows by a filter text")
    query.add_argument("name")
    query.add_argument("--filter", default="")
    query.add_argument("--fields", nargs="*")
    query.add_argument("--limit", type=int, default=100)
    sub.add_parser("cache-stats", help="statistics of this process's caches")
    sub.add_parser("cache-clear", help="empty this process's caches")
    warm = sub.add_parser("cache-warm", help="run searches for the vectors of a JSON file")
    warm.add_argument("name")
    warm.add_argument("file")
    warm.add_argument("--field")
    warm.add_argument("--limit", type=int, default=10)
    return p


def main(argv: Sequence[str] | None = None, spark: Any = None, out: Any = None) -> int:
    args = _parser().parse_args(argv)
    say = lambda *x: print(*x, file=out or sys.stdout)
    if args.command == "cache-stats":
        say(json.dumps(cache_stats(), indent=1))
        return 0
    if args.command == "cache-clear":
        clear_all()
        return 0
    from pyspark.sql import SparkSession

    from vecframe.plans.model import Model
    from vecframe.sources.storage import connect
    from vecframe.sources.vectorfile import read_vectors

    spark = spark or SparkSession.builder.appName("vecframe").getOrCreate()
    try:
        catalog = connect(spark, args.root, args.database, get_cache() or configure())
        if args.command == "sync":
            module = importlib.import_module(args.module)
            for m in vars(module).values():
                if isinstance(m, type) and issubclass(m, Model) and m is not Model:
                    say(m.options.collection_name, "created" if catalog.create(m, drop_existing=args.drop_existing) else "exists")
        elif args.command == "stats":
            for name in args.names or catalog.list():
                d = catalog.describe(name)
                say(json.dumps(d) if args.json else f"{name}: {d['row_count']} rows, {len(d['fields'])} fields, partitions {d['partitions']}, version {d['version']}")
        elif args.command == "drop":
            if not args.yes:
                say("nothing dropped; say --yes")
                return 1
            for name in args.names:
                say(name, "dropped" if catalog.drop(name) else "not there")
        elif args.command == "query":
            for row in catalog.collection(args.name).query_raw(args.filter, args.fields, args.limit):
                say(json.dumps(row, default=str))
        else:
            c = catalog.collection(args.name)
            jobs = [lambda v=list(r["vector"]), n=r["limit"]: c.objects.cache().search(v, args.field, n or args.limit).rows() for r in read_vectors(spark, args.file).collect()]
            done, failed = catalog.cache.warm(jobs)
            say(f"{done} warmed, {len(failed)} failed")
            return int(bool(failed))
    except VecframeError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
