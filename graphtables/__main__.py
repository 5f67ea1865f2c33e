"""Command line: rank a TAB-separated edge file and print the time of each stage.

    spark-submit run_rank.py PROGRAM ITERS PATH [--output DIR] [--partitions N]
    python -m graphtables PROGRAM ITERS PATH ...        (where pyspark is importable)

PROGRAM picks the variant: ``dataframe`` (= R5, the first program as written),
``lowlevel`` (= R7, the second program as written, with its routing tables built over the
blocks of the input; ``--partitions`` are its vertex partitions, 200 as in the original), or one of ``R5 R6 R7 R8``.
With ``--state DIR`` the rounds are kept there, and a later call continues after the last finished one.
Each stage prints ``<stage>: <ms> ms`` like the original programs; with
``--output`` the final ranks are written as parquet (the originals only count
them).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from graphtables.plans.durable import DurableRankLoop
from graphtables.plans.loop import RankLoop
from graphtables.plans.routed import RoutedLoop
from graphtables.sources.edges import BLOCK_BYTES, block_splits, read_block_edges, read_edges

VARIANTS = {
    "R5": dict(init="incidence", missing="drop"),
    "R6": dict(init="unique", missing="drop"),
    "R7": dict(contribution="source_id", missing="retain"),
    "R8": dict(init="unique", missing="retain"),
}
PROGRAMS = {"dataframe": "R5", "lowlevel": "R7"}


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="graphtables", description=__doc__.split("\n")[0])
    ap.add_argument("program", choices=sorted(PROGRAMS) + sorted(VARIANTS))
    ap.add_argument("iters", type=int)
    ap.add_argument("path")
    ap.add_argument("--output", help="write the final ranks as parquet here")
    ap.add_argument("--partitions", type=int, help="partitions of the round loop; of lowlevel, of its vertices (200)")
    ap.add_argument("--state", help="folder of a resumable loop (not for lowlevel)")
    ap.add_argument("--block-bytes", type=int, default=BLOCK_BYTES, help="bytes of an edge partition of lowlevel")
    ap.add_argument("--checkpoint-every", type=int, default=10)
    ap.add_argument("--mode", choices=["failfast", "permissive"], default="failfast")
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName("graphtables").getOrCreate()
    variant = VARIANTS[PROGRAMS.get(args.program, args.program)]
    if args.program == "lowlevel" and args.state:
        ap.error("--state is for the other programs")
    if args.program == "lowlevel":
        edges = read_block_edges(spark, args.path, args.mode, args.block_bytes)
        loop = RoutedLoop(edges, contribution="source_id", checkpoint_every=args.checkpoint_every,
                          vertex_partitions=args.partitions or 200)
        with block_splits(spark, args.block_bytes):
            ranks = loop.run(args.iters)
    elif args.state:
        loop = DurableRankLoop(spark, args.state, read_edges(spark, args.path, mode=args.mode),
                               partitions=args.partitions, **variant)
        ranks = loop.run(args.iters)
    else:
        loop = RankLoop(read_edges(spark, args.path, mode=args.mode), partitions=args.partitions,
                        checkpoint_every=args.checkpoint_every, **variant)
        ranks = loop.run(args.iters)
    print(loop.timer.report())
    print(f"ranks: {ranks.count()} rows")
    if args.output:
        ranks.write.mode("errorifexists").parquet(args.output)
    ranks.unpersist()
    return 0


if __name__ == "__main__":
    sys.exit(main())
