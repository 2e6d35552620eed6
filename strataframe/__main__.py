"""``python -m strataframe list`` and ``python -m strataframe run NAME TABLES [--out FOLDER]``."""

from __future__ import annotations

import argparse

from .plans.catalog import QUERIES


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strataframe")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("name", choices=sorted(QUERIES))
    run.add_argument("tables")
    run.add_argument("--out", help="folder for the result as Parquet; without it the first rows are shown")
    given = parser.parse_args(arguments)
    if given.command == "list":
        print(*sorted(QUERIES), sep="\n")
        return 0
    from pyspark.sql import SparkSession

    result = QUERIES[given.name](SparkSession.builder.appName("strataframe").getOrCreate(), given.tables)
    if given.out:
        result.write.mode("overwrite").parquet(given.out)
    else:
        result.show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
