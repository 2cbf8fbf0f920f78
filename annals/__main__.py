"""``python -m annals``: lists and runs queries, shows their SQL, and looks into files."""

from __future__ import annotations

import argparse
import sys


def _config(args):
    from annals.sources.texts import Config, parse_config

    c = Config(parse_config(open(args.file, encoding="utf-8").read(), lambda p: open(p, encoding="utf-8").read()))
    parts = args.key.split(".")
    print(c.string(parts[0], ".".join(parts[1:-1]) or None, parts[-1], ""))


def _refs(args):
    from annals.sources.reftables import Reftable

    for r in Reftable(open(args.file, "rb").read()).with_prefix(args.prefix):
        print(r.oid or f"ref: {r.target}" if r.kind else "deleted", r.name)


def _verify(args):
    from annals.sources.packs import parsed

    rows, _ = parsed(open(args.file, "rb"))
    for oid, at, _, kind, size in sorted(rows, key=lambda r: r[1]):
        print(oid, kind, size, at)


def _index(args):
    from annals.sources.staging import decode

    for e in decode(open(args.file, "rb").read()):
        print(f"{e.mode:o} {e.oid} {e.stage}\t{e.path.decode('utf-8', 'replace')}")


def _run(args):
    from annals import catalog
    from annals.session import local_session

    spark = local_session(args.cpus)
    catalog.queries()[args.name](spark, args.data).show(args.rows, truncate=False)
    spark.stop()


def _list(args):
    from annals import catalog

    sql = catalog.oracle_sql()
    for name in sorted(catalog.queries()):
        print(name, "" if name in sql else "(no SQL)")


def _sql(args):
    from annals import catalog

    print(catalog.oracle_sql()[args.name])


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="annals")
    sub = p.add_subparsers(required=True)

    def command(name, work, *arguments):
        one = sub.add_parser(name)
        one.set_defaults(work=work)
        for a, more in arguments:
            one.add_argument(a, **more)

    command("list", _list)
    command("sql", _sql, ("name", {}))
    command("run", _run, ("name", {}), ("data", {}), ("--rows", {"type": int, "default": 20}), ("--cpus", {"type": int, "default": 8}))
    command("config", _config, ("file", {}), ("key", {}))
    command("refs", _refs, ("file", {}), ("--prefix", {"default": ""}))
    command("verify-pack", _verify, ("file", {}))
    command("ls-index", _index, ("file", {}))
    args = p.parse_args(argv)
    args.work(args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
