"""Command line: insert, query, range, stats, compact and count."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from tidemark.engine import Engine, open_engine

SHOWN = 1000


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidemark", description="Tick analytics on Spark")
    parser.add_argument("--db", default="./tidemark-data")
    verbs = parser.add_subparsers(dest="verb", required=True)
    insert = verbs.add_parser("insert")
    insert.add_argument("symbol")
    insert.add_argument("timestamp", type=int)
    for name in ("open", "high", "low", "close"):
        insert.add_argument(f"--{name}", type=float, default=0.0)
    insert.add_argument("--volume", type=int, default=0)
    query = verbs.add_parser("query")
    query.add_argument("text")
    query.add_argument("--json", action="store_true")
    for verb in ("range", "count"):
        sub = verbs.add_parser(verb)
        sub.add_argument("symbol")
        sub.add_argument("start", type=int)
        sub.add_argument("end", type=int)
        sub.add_argument("--json", action="store_true")
    verbs.add_parser("stats")
    verbs.add_parser("compact")
    return parser


def render(df: DataFrame, as_json: bool) -> str:
    """All rows as a JSON array, or a count and the first thousand rows as text."""
    if as_json:
        return "[" + ",".join(df.toJSON().toLocalIterator()) + "]"
    total = df.count()
    lines = [f"{total} rows", *("\t".join(str(v) for v in row) for row in df.limit(SHOWN).collect())]
    return "\n".join([*lines, f"... {total - SHOWN} more rows"] if total > SHOWN else lines)


def run(engine: Engine, args: argparse.Namespace) -> str:
    if args.verb == "insert":
        return str(engine.insert(args.symbol, args.timestamp, args.open, args.high, args.low, args.close, args.volume))
    if args.verb == "query":
        return render(engine.query(args.text), args.json)
    if args.verb == "range":
        return render(engine.query_range(args.symbol, args.start, args.end), args.json)
    if args.verb == "count":
        return str(engine.count_range(args.symbol, args.start, args.end))
    return json.dumps(engine.stats()) if args.verb == "stats" else str(engine.compact())


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(run(open_engine(spark, args.db), args))


if __name__ == "__main__":
    main()
