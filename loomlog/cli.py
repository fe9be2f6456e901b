"""Reduce a log from standard input or files: ``python -m loomlog.cli [--level L] [--grep P] [--contains T] [--context N] [file ...]``.

``--metrics`` prints what each step saves instead, ``--sql`` runs a query over the view ``log_lines``.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators.focus import Focus
from .plans.reduction import reduce_lines, step_measures
from .sources.lines import from_texts, join_lines, read_logs


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomlog", description=__doc__)
    parser.add_argument("files", nargs="*")
    parser.add_argument("--level", choices=("error", "warning", "info", "debug"))
    parser.add_argument("--grep")
    parser.add_argument("--contains")
    parser.add_argument("--component")
    parser.add_argument("--time-range")
    parser.add_argument("--not-grep")
    parser.add_argument("--context", type=int)
    parser.add_argument("--limit", type=int)
    parser.add_argument("--skip", type=int)
    parser.add_argument("--summary", action="store_true")
    parser.add_argument("--metrics", action="store_true")
    parser.add_argument("--sql")
    got = vars(parser.parse_args(args))
    files, metrics, query = got.pop("files"), got.pop("metrics"), got.pop("sql")
    spark = SparkSession.builder.appName("loomlog").getOrCreate()
    lines = read_logs(spark, ",".join(files)) if files else from_texts(spark, [("stdin", sys.stdin.buffer.read().decode("utf-8", "replace"))])
    if query:
        lines.createOrReplaceTempView("log_lines")
        spark.sql(query).show(truncate=False)
    elif metrics:
        step_measures(lines).orderBy("log_id", "step_no").show(1000, truncate=False)
    else:
        for row in join_lines(reduce_lines(lines, focus=Focus(**got))).orderBy("log_id").toLocalIterator():
            sys.stdout.write(row["text"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
