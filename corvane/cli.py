"""``python -m corvane.cli``: list and run queries, audit, sample and execute statements over a folder of tables."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from corvane.operators import audit, results, sampling
from corvane.plans import catalogue
from corvane.sources.databases import register_database


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corvane")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries", help="names of the queries")
    run = commands.add_parser("run", help="run a query; print it or write Parquet")
    run.add_argument("name", choices=sorted(catalogue.queries()))
    run.add_argument("folder")
    run.add_argument("--out")
    check = commands.add_parser("audit", help="audit a training table against an evaluation table; exit 1 if it fails")
    check.add_argument("train")
    check.add_argument("evaluation")
    check.add_argument("--threshold", default="0.85")
    draw = commands.add_parser("sample", help="write nested samples of a table")
    draw.add_argument("table")
    draw.add_argument("out")
    draw.add_argument("--sizes", type=int, nargs="+", required=True)
    draw.add_argument("--seed", type=int, default=42)
    sql = commands.add_parser("sql", help="execute one read-only statement on a folder of tables")
    sql.add_argument("folder")
    sql.add_argument("statement")
    sql.add_argument("--timeout", type=float, default=10.0)
    chosen = parser.parse_args(args)
    if chosen.command == "queries":
        print("\n".join(sorted(catalogue.queries())))
        return 0
    spark = SparkSession.builder.appName("corvane").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if chosen.command == "run":
        frame = catalogue.queries()[chosen.name](spark, chosen.folder)
        if chosen.out:
            frame.write.mode("overwrite").parquet(chosen.out)
        else:
            frame.show(50, truncate=False)
        return 0
    if chosen.command == "audit":
        row = audit.audit_report(spark.read.parquet(chosen.train), {"evaluation": spark.read.parquet(chosen.evaluation)}, threshold=chosen.threshold).first()
        print("\n".join(f"{k}: {v}" for k, v in row.asDict().items()))
        return 0 if row["passed"] else 1
    if chosen.command == "sample":
        order = sampling.global_order(spark.read.parquet(chosen.table), chosen.seed)
        sampling.nested_samples(order, chosen.sizes).write.mode("overwrite").partitionBy("size").parquet(chosen.out)
        return 0
    register_database(spark, chosen.folder)
    status, rows, error = results.run_sql(spark, chosen.statement, chosen.timeout)
    print(status if error is None else f"{status}: {error}")
    for row in rows or []:
        print(*row, sep="\t")
    return 0 if status == "SUCCESS" else 1


if __name__ == "__main__":
    sys.exit(main())
