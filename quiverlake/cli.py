"""python -m quiverlake show|check|validate|import ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators.validate import DatasetValidator
from .plans.info import load_graph_info
from .sources.importers import run_import


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quiverlake")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, what in (("show", "print metadata"), ("check", "check metadata"), ("validate", "check the stored data too")):
        p = sub.add_parser(name, help=what)
        p.add_argument("--path", "-p", required=True)
        if name == "show":
            p.add_argument("--vertex", "-v")
            p.add_argument("--edge-src", "-es")
            p.add_argument("--edge", "-e")
            p.add_argument("--edge-dst", "-ed")
        if name == "validate":
            p.add_argument("--strict", action="store_true")
    sub.add_parser("import", help="import by a config").add_argument("--config", "-c", required=True)
    got = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if got.command == "import":
        print(run_import(spark, got.config).dump())
        return 0
    info = load_graph_info(spark, got.path)
    if got.command == "show":
        ends = (got.edge_src, got.edge, got.edge_dst)
        if any(ends) and not all(ends):
            parser.error("an edge type is named by --edge-src, --edge and --edge-dst")
        print(info.vertex(got.vertex).dump() if got.vertex else info.edge(*ends).dump() if all(ends) else info.dump())
        return 0
    if got.command == "check":
        issues = info.issues()
        print("\n".join(issues) or "valid")
        return int(bool(issues))
    found = DatasetValidator(spark, info, got.strict).validate()
    print("\n".join(f"{i.code}\t{i.path}\t{i.message}" for i in found) or "valid")
    return int(bool(found))


if __name__ == "__main__":
    sys.exit(main())
