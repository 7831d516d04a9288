"""``python -m twinstring.cli [-d N] [-n THREADS] [-z] [FILE_QUERY [FILE_REFERENCE]]``"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from twinstring.errors import NonAsciiError
from twinstring.operators.join import neighbors_across, neighbors_within
from twinstring.sources.text import from_iterable, read_lines, write_pairs


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(
        prog="twinstring",
        description="Pairs of similar lines: row,col,dist. With one input, pairs within it;"
        " with two, pairs of a query line and a reference line. Lines count from one.",
    )
    p.add_argument("-d", "--max-distance", type=int, default=1)
    p.add_argument("-n", "--num-threads", type=int, default=0, help="0: one per core")
    p.add_argument("-z", "--zero-index", action="store_true")
    p.add_argument("--version", action="version", version="0.1.0")
    p.add_argument("file_query", nargs="?", help="standard input if absent")
    p.add_argument("file_reference", nargs="?")
    return p


def _source(spark: SparkSession, path: str | None, stdin) -> DataFrame:
    if path is None:
        return from_iterable(spark, (s.removesuffix("\n").removesuffix("\r") for s in stdin))
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(f"{path}: no such file")
    return read_lines(spark, path)


def main(argv: list[str] | None = None, stdin=None, stdout=None, spark=None) -> int:
    args = parser().parse_args(argv)
    stdin, stdout = stdin or sys.stdin, stdout or sys.stdout
    spark = spark or (
        SparkSession.builder.master(f"local[{args.num_threads or '*'}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    try:
        query = _source(spark, args.file_query, stdin)
        if args.file_reference is None:
            pairs = neighbors_within(query, max_distance=args.max_distance)
        else:
            reference = _source(spark, args.file_reference, stdin)
            pairs = neighbors_across(query, reference, max_distance=args.max_distance)
        write_pairs(pairs, stdout, args.zero_index)
    except NonAsciiError as e:
        print(f"non-ASCII input is unsupported: '{e.text}' at line {e.position + 1}", file=sys.stderr)
        return 1
    except (ValueError, OverflowError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
