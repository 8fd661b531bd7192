"""Command line: infer, to-spec, validate and load; JSON in, JSON out."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomwright", description=__doc__)
    p.add_argument("command", choices=("infer", "to-spec", "validate", "load", "schema"))
    p.add_argument("input", nargs="?", help="a folder, a file, a pattern, or a description in JSON (- reads it from standard input)")
    p.add_argument("--base", default=".", help="the folder that names are relative to")
    p.add_argument("--out", help="load: a folder to write the package to")
    args = p.parse_args(argv)
    from .errors import AssemblyError
    from .spec.schema import json_schema

    if args.command == "schema":
        print(json.dumps(json_schema(), indent=2))
        return 0
    if args.input is None:
        p.error("an input is needed")
    given = json.load(sys.stdin) if args.input == "-" else args.input
    from pyspark.sql import SparkSession

    from . import api, package

    try:
        if args.command == "validate":
            spark = None if isinstance(given, dict) else SparkSession.builder.getOrCreate()
            problems = api.validate(given if isinstance(given, dict) else api._document(spark, given))
            print(json.dumps({"valid": not problems, "problems": problems}, indent=2))
            return 1 if problems else 0
        spark = SparkSession.builder.getOrCreate()
        if args.command == "infer":
            print(json.dumps(api.infer(spark, given, args.base).to_dict(), indent=2, default=str))
        elif args.command == "to-spec":
            print(json.dumps(api.to_spec(spark, given, args.base)[0].to_dict(), indent=2, default=str))
        else:
            data = api.load(spark, given, args.base)
            if args.out:
                package.write(data, args.out)
            print(package.canonical_json(package.summary(data)))
    except AssemblyError as e:
        print(json.dumps({"error": type(e).__name__, "message": str(e)}, indent=2))
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
