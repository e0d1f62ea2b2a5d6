"""Command line over the stores: ``python -m quadrel`` or spark-submit.

ping; upload [--clear] [--dry-run] [FOLDER ...]; lpg [--clear] [--embed] [--embedder KIND] [--dry-run].
Exit code 1: a store that does not answer, or files that could not be read; those are named.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession, functions as F

from .functions.terms import graph_uri
from .operators import convert
from .operators.store import QuadStore
from .settings import Settings
from .sources import rdf


def _ping(spark: SparkSession, settings: Settings, args) -> int:
    down = 0
    for name, store in (("quads", QuadStore(spark, settings.store)), ("graph", convert.GraphStore(spark, settings.graph_store).versions)):
        try:
            print(f"{name} up: {store.current() or 'empty'}")
        except Exception as e:  # noqa: BLE001 - whatever the file system says
            print(f"{name} down: {str(e).splitlines()[0]}", file=sys.stderr)
            down = 1
    return down


def _upload(spark: SparkSession, settings: Settings, args) -> int:
    files = rdf.discover(spark, args.folders or settings.folders.split(","))
    if args.dry_run:
        listed = files.select(graph_uri(rdf.relative(F.col("path"), args.root) if args.root else F.col("path")).alias("g"), F.length("content").alias("n"))
        total = listed.agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        print(f"{total.files} files, {total.n / 1e6:.1f} MB")
        for row in listed.orderBy("g").toLocalIterator():
            print(f"  {row.g}")
        return 0
    store = QuadStore(spark, settings.store)
    report = store.load_files(rdf.parse_files(files, args.root or ""), args.clear)
    failed = 0
    for row in report.filter("error is not null").orderBy("path").toLocalIterator():
        print(f"failed: {row.path}: {row.error}", file=sys.stderr)
        failed += 1
    print(f"{report.count() - failed} files loaded, {failed} failed; the store holds {store.count_triples()} triples")
    return 1 if failed else 0


def _lpg(spark: SparkSession, settings: Settings, args) -> int:
    made = convert.extract_transform(QuadStore(spark, settings.store).quads())
    print("projection:", made.stats())
    if args.dry_run:
        return 0
    vectors = made.embeddings(args.embedder) if args.embed else None
    print("loaded:", convert.GraphStore(spark, settings.graph_store).load(made.nodes, made.edges, vectors, args.clear))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quadrel", description="Load RDF into a quad store, project it to a property graph.")
    parser.add_argument("--settings", help="file of KEY=VALUE lines")
    parser.add_argument("--store", help="folder of the quad store")
    parser.add_argument("--graph-store", help="folder of the property graph")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("ping", help="do the stores answer").set_defaults(run=_ping)
    upload = sub.add_parser("upload", help="load RDF files, a named graph each")
    upload.add_argument("folders", nargs="*")
    upload.add_argument("--root", help="graphs are named by the path below it")
    upload.add_argument("--clear", action="store_true", help="in place of all that is stored")
    upload.add_argument("--dry-run", action="store_true", help="only list the graphs")
    upload.set_defaults(run=_upload)
    project = sub.add_parser("lpg", help="project the classes to a property graph")
    project.add_argument("--clear", action="store_true", help="in place of all that is stored")
    project.add_argument("--embed", action="store_true", help="with an embedding a node")
    project.add_argument("--embedder", default="hash", help="hash or sentence-transformers")
    project.add_argument("--dry-run", action="store_true", help="only count")
    project.set_defaults(run=_lpg)
    args = parser.parse_args(argv)
    settings = Settings.load(args.settings, store=args.store, graph_store=args.graph_store)
    return args.run(spark or SparkSession.builder.appName("quadrel").getOrCreate(), settings, args)


if __name__ == "__main__":
    raise SystemExit(main())
