"""Command line: list the queries, run one over a folder of tables, or ask read-only SQL over a cohort."""

from __future__ import annotations

import argparse
import sys


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="genolith", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list", help="names of all queries")
    for name, word in (("run", "query"), ("sql", "statement")):
        s = sub.add_parser(name)
        s.add_argument(word)
        s.add_argument("folder")
        s.add_argument("--format", default="Pretty")
    o = p.parse_args(args)
    from .plans.queries import QUERIES

    if o.what == "list":
        print("\n".join(QUERIES))
        return 0
    from pyspark.sql import SparkSession

    from .functions.guard import Refused, ask
    from .plans.fixtures import PARTS, cohort
    from .sources.sinks import rendered

    spark = SparkSession.builder.getOrCreate()
    try:
        if o.what == "run":
            df = QUERIES[o.query](spark, o.folder)
        else:
            c = cohort(spark, o.folder)
            df = ask(spark, o.statement, {name: getattr(c, name) for name in PARTS})
    except (KeyError, Refused) as e:
        print(f"refused: {e}", file=sys.stderr)
        return 2
    for line in rendered(df, o.format):
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
