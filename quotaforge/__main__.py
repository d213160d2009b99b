"""`python -m quotaforge QUERY TABLES OUT`: runs one registered query over a folder of tables and writes Parquet; `--list` names them."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quotaforge.plans.registry import QUERIES


def main(given: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quotaforge", description=__doc__)
    parser.add_argument("--list", action="store_true", help="name the queries and stop")
    parser.add_argument("--mode", default="errorifexists", choices=["errorifexists", "overwrite", "append"])
    parser.add_argument("query", nargs="?", choices=sorted(QUERIES))
    parser.add_argument("tables", nargs="?")
    parser.add_argument("out", nargs="?")
    asked = parser.parse_args(given)
    if asked.list:
        print("\n".join(sorted(QUERIES)))
        return
    if not asked.out:
        parser.error("a query, a folder of tables and an output folder are needed")
    spark = SparkSession.builder.appName(f"quotaforge {asked.query}").getOrCreate()
    QUERIES[asked.query](spark, asked.tables).write.mode(asked.mode).parquet(asked.out)


if __name__ == "__main__":
    main()
