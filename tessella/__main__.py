"""python -m tessella CATALOGUE TAXONOMY OUT [--limit N] [--master FILE] [--delivery FOLDER] [--layout FILE] [--snapshot FOLDER]: enrich a catalogue file and print the report."""

import argparse
import json

from pyspark.sql import SparkSession

from tessella.operators.metrics import print_report
from tessella.plans.run import run
from tessella.sources.tables import checked_limit


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessella", description=__doc__)
    for name, what in (("catalogue", "CSV, JSON, Parquet or Excel file of catalogue rows"), ("taxonomy", "Parquet table of classes"), ("out", "folder for the products")):
        parser.add_argument(name, help=what)
    parser.add_argument("--limit", type=checked_limit, default=None, help="take the first rows only")
    parser.add_argument("--master", help="CSV, JSON, Parquet or Excel file of manufacturers and brands")
    parser.add_argument("--delivery", help="folder for the delivery table as CSV")
    parser.add_argument("--layout", help="CSV whose header is the delivery layout")
    parser.add_argument("--snapshot", help="folder where all results become visible together")
    a = parser.parse_args(args)
    report = run(SparkSession.builder.appName("tessella").getOrCreate(), a.catalogue, a.taxonomy, a.out, a.limit, a.master, a.delivery, a.layout, a.snapshot)
    print(print_report(report, a.catalogue))
    print(json.dumps(report))


if __name__ == "__main__":
    main()
