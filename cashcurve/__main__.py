"""Command line: list the registered queries or run one and write its result.

    python -m cashcurve list
    python -m cashcurve run <key> <source_dir> <out_path> [--format parquet|json] [--master local[8]]
"""

from __future__ import annotations

import argparse
import sys


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="cashcurve")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("key")
    run.add_argument("source_dir")
    run.add_argument("out_path")
    run.add_argument("--format", choices=["parquet", "json"], default="parquet")
    run.add_argument("--master", default=None)
    args = ap.parse_args(argv)

    from cashcurve.plans.catalog import ORACLE, QUERIES
    from cashcurve.plans.descriptions import DESCRIPTIONS
    if args.cmd == "list":
        for k in QUERIES:
            ids, text = DESCRIPTIONS.get(k, ("", ""))
            print(f"{k:26s} {'oracle' if k in ORACLE else '      '}  {ids:28s} {text}")
        return 0

    from cashcurve.operators.sinks import to_api_columns
    from cashcurve.session import build_session
    spark = build_session(args.master)
    df = QUERIES[args.key](spark, args.source_dir)
    out = to_api_columns(df) if args.format == "json" else df
    getattr(out.write.mode("overwrite"), args.format)(args.out_path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
