"""python -m stemline.cli INPUT OUTPUT [MEMORY] [--chunk-size N] [--verify] [--raw]

Builds the suffix array of a file as a table at OUTPUT (with --raw also as files of 64-bit positions in OUTPUT-raw), and prints
each round. With --verify checks it; a failed check ends with status 1.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .config import Config, parse_count, parse_size
from .operators import symbols, verify
from .plans import build
from .sources import sinks
from .sources.ranges import ByteRanges


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("memory", nargs="?", type=parse_size)
    parser.add_argument("--chunk-size", type=parse_count)
    parser.add_argument("--verify", action="store_true")
    parser.add_argument("--raw", action="store_true")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("stemline").getOrCreate()
    build._workers_import_this(spark.range(0))
    spark.dataSource.register(ByteRanges)
    config = Config(memory=args.memory, chunk=args.chunk_size, max_byte=253)
    began = time.time()

    def pieces_of(overlap: int):
        return spark.read.format("byte_ranges").option("path", args.input).option("overlap", overlap).load()

    result = build.from_pieces(pieces_of, config)
    for m in result.metrics:
        print(f"round {m['round']}: by {2 * m['length']} bytes, {m['active_in']} to {m['active_out']} active, {m['seconds']:.1f} s")
    sinks.write_table(result.sa, args.output)
    if args.raw:
        sinks.write_raw(result.sa, f"{args.output}-raw", config.chunk_size).collect()  # a row a file
    print(f"total {time.time() - began:.1f} s")
    if args.verify:
        rows = verify.report(symbols.symbols(pieces_of(0)), result.isa, spark.read.parquet(args.output)).collect()
        for r in rows:
            print(f"{r['check']}: {r['violations']} of {r['n_positions']}")
        return int(any(r["violations"] for r in rows))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
