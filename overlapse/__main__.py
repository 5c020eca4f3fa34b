"""Command line: scan, report, review, eval, calibrate, apply, restore, purge.

``--catalog`` names the folder of a library's tables. Sound and pictures are decoded by the
external programs, or read from Parquet tables ``probes``, ``frames`` and ``audio`` below
``--decoded``. Single settings are changed by ``--set section.key=value``.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from overlapse.config import Config
from overlapse.operators import decide, quality
from overlapse.plans import ingest
from overlapse.sources import actions, files, media
from overlapse.sources.catalog import Catalog


def settings(path: str | None, changes: list[str]) -> Config:
    """Defaults, then a file, then changes ``section.key=value`` with values in JSON; what isn't JSON is a string."""
    out: dict[str, dict] = {}
    for change in changes:
        name, _, text = change.partition("=")
        section, _, key = name.partition(".")
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        out.setdefault(section, {})[key] = value
    return Config.load(path, out)


def library(spark: SparkSession, root: str, decoded: str | None, cfg: Config) -> ingest.Library:
    decoder = media.TableDecoder(cfg, *[spark.read.parquet(f"{decoded}/{x}") for x in ("probes", "frames", "audio")]) if decoded else media.FfmpegDecoder(cfg)
    return ingest.Library(spark, root, decoder, cfg)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser("overlapse", description=__doc__)
    parser.add_argument("--catalog", default="library")
    parser.add_argument("--config")
    parser.add_argument("--set", action="append", default=[], metavar="SECTION.KEY=VALUE")
    parser.add_argument("--decoded")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("scan")
    p.add_argument("roots", nargs="+")
    p.add_argument("--one-pass", action="store_true")
    p.add_argument("--html")
    sub.add_parser("report").add_argument("--html")
    sub.add_parser("review").add_argument("--answers", help="JSON lines of a, b and verdict, to be stored")
    sub.add_parser("eval").add_argument("pairs")
    sub.add_parser("calibrate").add_argument("--write")
    p = sub.add_parser("apply")
    p.add_argument("folder", nargs="?")
    p.add_argument("--yes", action="store_true")
    sub.add_parser("restore").add_argument("folder")
    p = sub.add_parser("purge")
    p.add_argument("folder")
    p.add_argument("--days", type=float)
    args = parser.parse_args(argv)
    cfg = settings(args.config, args.set)
    if args.command == "restore":
        print(actions.restore(args.folder))
        return 0
    if args.command == "purge":
        print(actions.purge(args.folder, cfg.action.quarantine_ttl_days if args.days is None else args.days))
        return 0
    spark = spark or SparkSession.builder.appName("overlapse").getOrCreate()
    if args.command == "scan":
        lib = library(spark, args.catalog, args.decoded, cfg)
        status, _ = ingest.run(lib, files.scan(spark, args.roots), two_pass=not args.one_pass)
        for r in status.groupBy("status").count().orderBy("status").toLocalIterator():
            print(f"{r['status']}: {r['count']}")
    c = Catalog(spark, f"{args.catalog}/catalog")
    known, dups = c.read("file"), c.read("dup_path")
    if args.command in ("scan", "report"):
        rows = actions.report_rows(_decided(c), known)
        if args.html:
            actions.html_report(rows, args.html)
        print(*actions.text_report(rows, verbose=True), sep="\n")
        print(*actions.review_report(_queue(c), known), sep="\n")
    elif args.command == "review":
        if args.answers:
            c.upsert("review_verdict", spark.read.json(args.answers))
        print(*actions.review_report(_queue(c), known), sep="\n")
    elif args.command == "eval":
        members = c.read("timeline").select(F.col("cluster_id").alias("cluster"), F.col("content_id").alias("node"))
        evaluated = decide.evaluate(files.ground_truth(spark.read.text(args.pairs, wholetext=True)), known, dups, members)
        for r in evaluated.orderBy("left", "right").toLocalIterator():
            print(f"{r['outcome']}: {r['left']} - {r['right']}")
        found = decide.recall(evaluated).head()
        print(f"{found['found']} of {found['n']} pairs found")
    elif args.command == "calibrate":
        floors = {r["knob"]: r["floor"] for r in quality.floors(c.read("measure")).collect()}  # a row a knob
        print(json.dumps(floors, indent=2))
        if args.write:
            with open(args.write, "w", encoding="utf-8") as f:
                json.dump({"quality": {k: v for k, v in floors.items() if v is not None}}, f, indent=2)
    elif args.command == "apply":
        plan = decide.safe_plan(decide.prune_plan(c.read("decision"), known, dups), c.read("decision"), known)
        for x in actions.apply_plan(plan, args.folder or cfg.action.quarantine_dir, dry_run=not args.yes):
            print(x["src"], "->", x["dst"])
    return 0


def _queue(c: Catalog):
    """Pairs to look at that have no verdict yet, by clusters of the last run."""
    members = c.read("timeline").select(F.col("cluster_id").alias("cluster"), F.col("content_id").alias("node"))
    pairs = decide.review_pairs(c.read("match_edge"), members)
    return pairs.join(c.read("review_verdict").select("a", "b"), ["a", "b"], "left_anti")


def _decided(c: Catalog):
    line = c.read("timeline").select(F.col("content_id").alias("vid"), F.col("s_canonical").alias("s"), F.col("e_canonical").alias("e"))
    return c.read("decision").select(F.col("content_id").alias("vid"), F.col("cluster_id").alias("cluster"), "action", "dominated_by").join(line, "vid")


if __name__ == "__main__":
    sys.exit(main())
