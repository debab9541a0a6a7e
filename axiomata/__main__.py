"""Command line: ``python -m axiomata build|show|search|check``.

build   documents (Parquet) to published tables under a folder
show    rows of a published table, a page at a time, filtered by column=value
search  concepts that queries find
check   faults of the provenance of the published relations; exits with 1 if there are any
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from . import flow
from .operators import lookups, provenance, sinks
from .session import get_session


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="axiomata", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--master", default="local[*]")
    commands = parser.add_subparsers(dest="command", required=True)
    b = commands.add_parser("build")
    b.add_argument("documents")
    b.add_argument("out")
    b.add_argument("--doc", default="doc_id")
    b.add_argument("--text", default="text")
    b.add_argument("--label", default="source")
    b.add_argument("--codes", help="a tab-separated code list")
    b.add_argument("--min-docs", type=int, default=3)
    b.add_argument("--dim", type=int, default=16)
    s = commands.add_parser("show")
    s.add_argument("out")
    s.add_argument("table", choices=flow.TABLES)
    s.add_argument("--where", nargs="*", default=[], metavar="COLUMN=VALUE")
    s.add_argument("--page", type=int, default=0)
    q = commands.add_parser("search")
    q.add_argument("out")
    q.add_argument("query", nargs="+")
    q.add_argument("--top", type=int, default=5)
    c = commands.add_parser("check")
    c.add_argument("out")
    c.add_argument("--release", default="r1")
    given = parser.parse_args(args)
    spark = get_session(given.master, app="axiomata")
    if given.command == "build":
        from .sources import readers

        rows = spark.read.parquet(given.documents)
        docs = rows.select(F.col(given.doc).alias("doc"), F.col(given.text).alias("text"))
        several = dict(rows.dtypes)[given.label].startswith("array")
        labels = rows.select(F.col(given.doc).alias("doc"), (F.explode(given.label) if several else F.col(given.label)).alias("label"))
        codes = readers.subject_codes(spark, given.codes).withColumn("position", F.monotonically_increasing_id()) if given.codes else None
        made = flow.build(docs, labels, given.out, codes, given.min_docs, given.dim)
        for name, df in made.items():
            print(f"{name}\t{df.count()}")
    elif given.command == "show":
        df = sinks.published(spark, f"{given.out}/{given.table}")
        equal = dict(x.split("=", 1) for x in given.where)
        lookups.listing(df, df.columns, [x for x, kind in df.dtypes if not kind.startswith("array")], given.page, **equal).show(50, truncate=80)
    elif given.command == "search":
        flow.find(spark, given.out, given.query, given.top).orderBy("query", "tier", "rank").show(1000, truncate=80)
    else:
        assertions, evidence = flow.provenance_of(spark, given.out, given.release)
        faults = provenance.schema_violations(assertions).select("id").union(assertions.join(evidence.select(F.col("assertion_id").alias("id")), "id", "left_anti").select("id"))
        n = faults.count()
        print(f"{assertions.count()} assertions, {evidence.count()} pieces of evidence, {n} faults")
        return int(n > 0)
    return 0


if __name__ == "__main__":
    sys.exit(main())
