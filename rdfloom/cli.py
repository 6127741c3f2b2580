"""Command line: build, query, serve and stats."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from rdfloom import model
from rdfloom.config import Settings
from rdfloom.engine import Dataset
from rdfloom.results import as_table, serialise
from rdfloom.sources.ntriples import Input, input_list


def session(settings: Settings) -> SparkSession:
    spark = SparkSession.builder.appName("rdfloom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
    if settings.shuffle_partitions:
        spark = spark.config("spark.sql.shuffle.partitions", settings.shuffle_partitions)
    return spark.getOrCreate()


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rdfloom", description=__doc__)
    p.add_argument("--config", help="TOML file of settings")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="load N-Triples and N-Quads into a store")
    b.add_argument("store")
    b.add_argument("inputs", nargs="*", help="files; PATH=GRAPH puts triples into a named graph")
    b.add_argument("--list", help="file with a path and perhaps a graph on each line, - for standard input")
    q = sub.add_parser("query", help="run a query")
    q.add_argument("store")
    q.add_argument("query", help="text, or @FILE")
    q.add_argument("--format", default="table", choices=["table", "json", "xml", "csv", "tsv", "nt"])
    q.add_argument("--explain", action="store_true")
    s = sub.add_parser("serve", help="answer SPARQL over HTTP")
    s.add_argument("store")
    s.add_argument("--port", type=int)
    t = sub.add_parser("stats", help="rows, subjects and objects of each predicate")
    t.add_argument("store")
    return p


def main(args: list[str] | None = None) -> int:
    a = arguments().parse_args(args)
    settings = Settings.read(a.config) if a.config else Settings()
    spark = session(settings)
    if a.command == "build":
        inputs = [Input(*x.split("=", 1)) if "=" in x else Input(x) for x in a.inputs]
        if a.list:
            inputs += input_list(sys.stdin if a.list == "-" else open(a.list))  # noqa: SIM115
        if not inputs:
            sys.exit("nothing to load")
        Dataset.build(spark, inputs, a.store, settings=settings)
        return 0
    data = Dataset.open(spark, a.store, settings)
    if settings.model:
        for chain in model.read(settings.model):
            data.cache_path(chain)
    if a.command == "stats":
        for p, s in sorted(data.statistics().items(), key=lambda x: -x[1].triples):
            print(f"{s.triples}\t{s.subjects}\t{s.objects}\t{p}")
    elif a.command == "serve":
        from rdfloom import server

        with server.make(data, port=a.port) as at:
            print(f"http://{at.server_address[0]}:{at.server_address[1]}/")
            at.serve_forever()
    else:
        text = open(a.query[1:]).read() if a.query.startswith("@") else a.query  # noqa: SIM115
        if a.explain:
            print(data.explain(text))
            return 0
        r = data.run(text)
        for h in r.hints:
            print(f"hint: {h}", file=sys.stderr)
        sys.stdout.writelines([as_table(r)] if a.format == "table" else serialise(r, a.format))
    return 0


if __name__ == "__main__":
    sys.exit(main())
