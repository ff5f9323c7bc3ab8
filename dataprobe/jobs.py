"""The programs of this package as jobs. Run from anywhere:

    spark-submit dataprobe/jobs.py inds --path tables/
    spark-submit dataprobe/jobs.py keys --path table.csv --max-size 3
    spark-submit dataprobe/jobs.py audit --path records.csv --out resolved/
    spark-submit dataprobe/jobs.py primes --low 1 --high 1000 --out primes/

``inds`` reads a folder with a CSV file for each table, ``keys`` and ``audit`` one file (id, name, characters, length,
token and any number of hints, by position). Results that grow with the data are written as parquet.
"""

from __future__ import annotations

import argparse
import os
import sys
import time

if __package__ in (None, ""):       # started as a script: its parent folder is not on the path
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dataprobe.operators.audit import records_from_positions, resolve_tokens  # noqa: E402
from dataprobe.operators.generate import primes  # noqa: E402
from dataprobe.operators.inclusion import discover_inds, ind_report  # noqa: E402
from dataprobe.operators.uniqueness import discover_uccs  # noqa: E402
from dataprobe.session import JobConfig, build_session, ship_package  # noqa: E402
from dataprobe.sources.readers import CsvSpec, read_csv, read_csv_folder  # noqa: E402


def parse(arguments: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    general = argparse.ArgumentParser(add_help=False)
    general.add_argument("--cores", type=int, default=4)
    general.add_argument("--shuffle-partitions", type=int, help="twice the cores if not given")
    general.add_argument("--master", help="left to spark-submit if not given")
    files = argparse.ArgumentParser(add_help=False)
    files.add_argument("--path", required=True)
    files.add_argument("--separator", default=";")
    jobs = parser.add_subparsers(dest="job", required=True)
    jobs.add_parser("inds", parents=[general, files])
    keys = jobs.add_parser("keys", parents=[general, files])
    keys.add_argument("--max-size", type=int)
    audit = jobs.add_parser("audit", parents=[general, files])
    audit.add_argument("--out", required=True)
    search = jobs.add_parser("primes", parents=[general])
    search.add_argument("--low", type=int, default=1)
    search.add_argument("--high", type=int, required=True)
    search.add_argument("--out", required=True)
    return parser.parse_args(arguments)


def main(arguments: list[str] | None = None) -> None:
    options = parse(arguments)
    spark = build_session(JobConfig(getattr(options, "path", None), options.cores, options.shuffle_partitions, options.master))
    ship_package(spark)
    start = time.perf_counter()
    if options.job == "inds":
        # one line per dependent column, so no more lines than columns
        for row in ind_report(discover_inds(read_csv_folder(spark, options.path, options.separator))).orderBy("dep").collect():
            print(row["line"])
    elif options.job == "keys":
        for columns in discover_uccs(read_csv(spark, CsvSpec(options.path, separator=options.separator)), options.max_size):
            print(", ".join(columns))
    elif options.job == "audit":
        records = records_from_positions(read_csv(spark, CsvSpec(options.path, separator=options.separator)))
        resolve_tokens(records).write.parquet(options.out)
    else:
        primes(spark, options.low, options.high).write.parquet(options.out)
    print(f"{options.job} took {time.perf_counter() - start:.1f} s")


if __name__ == "__main__":
    main()
