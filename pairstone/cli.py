"""Run a registered query over a folder of tables: python -m pairstone.cli QUERY FOLDER [--out PATH | --show N | --explain]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from pairstone.plans import catalogue


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pairstone", description=__doc__)
    parser.add_argument("query", help="a query's name, or 'list'")
    parser.add_argument("folder", nargs="?", help="where the tables are")
    parser.add_argument("--out", help="write the rows there as Parquet")
    parser.add_argument("--show", type=int, default=20, help="print so many rows")
    parser.add_argument("--explain", action="store_true", help="print the plan only")
    args = parser.parse_args(arguments)
    if args.query == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    if args.query not in catalogue.QUERIES or not args.folder:
        parser.error(f"no query {args.query!r}" if args.folder else "no folder of tables")
    spark = spark or SparkSession.builder.appName(args.query).getOrCreate()
    rows = catalogue.QUERIES[args.query](spark, args.folder)
    if args.explain:
        rows.explain("formatted")
    elif args.out:
        rows.write.mode("overwrite").parquet(args.out)
    else:
        rows.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
