"""Run registered queries on a cluster or locally and write their results.

    zip -r quire.zip quire
    spark-submit --conf spark.checkpoint.dir=<shared folder> --py-files quire.zip \\
        quire/plans/run.py --tables <folder of table parquet> --out <folder> newsletter_html outbox_rows

    python -m quire.plans.run --tables /root/testdata/sf0.01 --out /tmp/out newsletter_html
    python -m quire.plans.run --tables /root/testdata/sf0.01 --list

Each query's result is written to ``<out>/<query>`` as Parquet (overwrite). The session
that ``spark-submit`` provides is used as it is; the result-relevant settings (UTC, map
key policy) are applied to it, and checkpoints go to the folder it names.
"""

from __future__ import annotations

import argparse
import os
import sys
import time

if __package__ in (None, ""):  # run as a script path (spark-submit): make the package importable
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from quire.plans.queries import QUERIES
from quire.session import apply_required, ensure_checkpoint_dir, get_spark


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="quire.plans.run", description=__doc__.splitlines()[0])
    ap.add_argument("queries", nargs="*", help="registered query names")
    ap.add_argument("--tables", required=True, help="folder with <table>.parquet inputs")
    ap.add_argument("--out", help="output folder; one Parquet folder per query")
    ap.add_argument("--list", action="store_true", help="list the registered queries and exit")
    args = ap.parse_args(argv)
    if args.list:
        print("\n".join(sorted(QUERIES)))
        return 0
    unknown = [q for q in args.queries if q not in QUERIES]
    if unknown or not args.queries or not args.out:
        ap.error(f"unknown queries: {unknown}" if unknown else "name queries and --out")
    spark = get_spark(app="quire-run")
    apply_required(spark)
    ensure_checkpoint_dir(spark)
    for name in args.queries:
        t0 = time.time()
        QUERIES[name](spark, args.tables).write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/{name}")
        print(f"{name}\t{time.time() - t0:.1f}s", flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
