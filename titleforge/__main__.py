"""Commands on landed tables: normalize, start, status, export."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="titleforge")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("normalize", help="show the forms of one title")
    one.add_argument("text")
    start = commands.add_parser("start", help="run all phases on a landed pages table and write the run's tables")
    start.add_argument("pages", help="Parquet table (url, html)")
    start.add_argument("out")
    start.add_argument("--sites", required=True, help="site URLs, by commas")
    start.add_argument("--responses", help="Parquet table (query, response)")
    start.add_argument("--categories", default="")
    start.add_argument("--topic", default="")
    start.add_argument("--all-pages", action="store_true", help="don't ask for product signals")
    commands.add_parser("status", help="show the run's counts").add_argument("out")
    export = commands.add_parser("export", help="write the sheets as a workbook, and what is to be reviewed")
    export.add_argument("out")
    export.add_argument("--csv", action="store_true", help="one CSV file a sheet instead")
    args = parser.parse_args(argv)
    if args.command == "normalize":
        from titleforge.functions.entities import Scanner
        from titleforge.functions.text import Rules, plain

        scanner = Scanner(Rules())
        tokens, sources, base = scanner.read(args.text)
        print(json.dumps({"display": plain(args.text, Rules()), "normalized": " ".join(scanner.meaningful(scanner.words(args.text))), "entities": sources, "base": base}, ensure_ascii=False))
        return 0

    from titleforge.operators import reports
    from titleforge.plans import run as R
    from titleforge.session import session
    from titleforge.sources.landing import Site

    spark = session()
    if args.command == "start":
        given = {"run": {"categories": [c for c in args.categories.split(",") if c], "target_topic": args.topic}}
        responses = spark.read.parquet(args.responses) if args.responses else None
        made = R.run(spark, spark.read.parquet(args.pages).select("url", "html"), [Site.of(s) for s in args.sites.split(",")], responses, given, {"require_product_signals": not args.all_pages})
        for name, df in made.items():
            df.write.mode("overwrite").parquet(f"{args.out}/{name}")
        return 0
    read = lambda name: spark.read.parquet(f"{args.out}/{name}")
    if args.command == "status":
        print(json.dumps(reports.counters(read("raw_products"), read("canonical_products"), read("lsi_keywords")).first().asDict()))
        return 0
    # sheets are made anew: their order is not kept in the written tables
    made = reports.sheets(*(read(n) for n in ("canonical_products", "product_mapping", "raw_products", "lsi_keywords")))
    if args.csv:
        reports.csv_bundle(made, args.out, "output")
    else:
        reports.to_xlsx(made, str(Path(args.out, "output.xlsx")))
    reports.borderline_csv(read("raw_products"), str(Path(args.out, "review")), "output")
    return 0


if __name__ == "__main__":
    sys.exit(main())
