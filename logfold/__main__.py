"""Command line: rebuild, inspect, compact and serve."""

from __future__ import annotations

import argparse
import json
import logging
import os

from logfold.http import server
from logfold.operators.compact import compact
from logfold.plans.rebuild import inspect, rebuild, report
from logfold.runtime import JsonLines, Service
from logfold.session import build
from logfold.sources.files import Files
from logfold.stores import SnapshotStore
from logfold.streaming.projector import SnapshotReads, Snapshots


def tables_in(spark, folder: str) -> dict:
    """Every Parquet file or folder in a folder, by name."""
    names = {n.removesuffix(".parquet"): n for n in sorted(os.listdir(folder)) if not n.startswith(("_", "."))}
    return {k: spark.read.parquet(os.path.join(folder, v)) for k, v in names.items() if v.endswith(".parquet") or os.path.isdir(os.path.join(folder, v))}


def serve(spark, a) -> int:
    """Serves until interrupted, then projects what is left and ends."""
    snapshots = Snapshots(spark, a.tables)
    store = SnapshotStore(snapshots, a.log, os.path.join(a.tables, "_stream"))
    if a.source:
        store.bulk_import(tables_in(spark, a.source))
    service = Service(spark, a.log, SnapshotReads(snapshots), store)
    service.start()
    web = server(service, a.host, a.port)
    try:
        web.serve_forever()
    except KeyboardInterrupt:
        pass
    finally:
        web.server_close()
        service.stop()
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="logfold")
    sub = p.add_subparsers(dest="what", required=True)
    r = sub.add_parser("rebuild")
    r.add_argument("--log", required=True)
    r.add_argument("--output", required=True)
    r.add_argument("--overwrite", action="store_true")
    i = sub.add_parser("inspect")
    i.add_argument("--source", required=True)
    i.add_argument("--top", type=int, default=10)
    i.add_argument("--text", action="store_true")
    c = sub.add_parser("compact")
    c.add_argument("--source", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--dry-run", action="store_true")
    v = sub.add_parser("serve")
    v.add_argument("--log", required=True)
    v.add_argument("--tables", required=True)
    v.add_argument("--host", default="127.0.0.1")
    v.add_argument("--port", type=int, default=8000)
    v.add_argument("--import", dest="source", help="tables to start from, before the first projection")
    a = p.parse_args(argv)
    handler = logging.StreamHandler()
    handler.setFormatter(JsonLines())
    logging.getLogger("logfold").addHandler(handler)
    spark = build(None if os.environ.get("MASTER") else "local[*]")
    if a.what == "serve":
        return serve(spark, a)
    if a.what == "rebuild":
        out = rebuild(spark, a.log, a.output, a.overwrite)
    elif a.what == "inspect":
        tables = tables_in(spark, a.source)
        files = Files(spark)
        out = inspect(spark, tables, top=a.top, sizes={n: files.size(os.path.join(a.source, n if files.exists(os.path.join(a.source, n)) else n + ".parquet")) for n in tables})
    else:
        out = compact(spark, tables_in(spark, a.source), a.output, a.dry_run, source=a.source)
    print(report(out, a.top) if a.what == "inspect" and a.text else json.dumps(out, default=str, ensure_ascii=False))
    return 1 if out.get("failures") else 0


if __name__ == "__main__":
    raise SystemExit(main())
