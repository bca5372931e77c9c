"""python -m kinora STORE COMMAND: the catalog from the command line; indexing needs a detector, see ``--detector``."""

from __future__ import annotations

import argparse
import importlib

from kinora.engine import Catalog
from kinora.session import local_session, ship


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kinora")
    parser.add_argument("store")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("init", "list-roots", "stats", "jobs", "groups", "summary"):
        commands.add_parser(name)
    commands.add_parser("add-root").add_argument("path")
    for name in ("index-all", "index-root"):
        one = commands.add_parser(name)
        one.add_argument("--detector", required=True, help="module:expression that makes a detector")
        one.add_argument("--fresh", action="store_true")
        one.add_argument("--batch-size", type=int)
        if name == "index-root":
            one.add_argument("path")
    rebuild = commands.add_parser("rebuild")
    rebuild.add_argument("--k", type=int)
    rebuild.add_argument("--threshold", type=float)
    commands.add_parser("show").add_argument("group", type=int)
    commands.add_parser("toggle").add_argument("face", type=int)
    commands.add_parser("reset").add_argument("--clear-roots", action="store_true")
    given = parser.parse_args(args)

    spark = local_session("*")
    ship(spark)
    catalog = Catalog(spark, given.store)
    catalog.init()
    shown = {"list-roots": catalog.list_roots, "stats": catalog.stats, "jobs": lambda: catalog.admin()[2], "groups": catalog.group_list, "summary": catalog.group_summary}
    if given.command in shown:
        shown[given.command]().show(truncate=False)
    elif given.command == "add-root":
        print(catalog.add_root(given.path))
    elif given.command in ("index-all", "index-root"):
        module, _, maker = given.detector.partition(":")
        detector = eval(maker, vars(importlib.import_module(module)))  # noqa: S307  the user's own expression
        only = [catalog.add_root(given.path)] if given.command == "index-root" else None
        counts = catalog.index(detector, only, given.fresh, given.batch_size)
        print(counts)
        return int(counts.get("errors", 0) > 0 and counts.get("files_reindexed", 0) == 0)
    elif given.command == "rebuild":
        print(catalog.rebuild(given.k, given.threshold))
    elif given.command == "show":
        catalog.group_detail(given.group).show(truncate=False)
    elif given.command == "toggle":
        print(catalog.toggle(given.face))
    elif given.command == "reset":
        print(catalog.reset(given.clear_roots))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
