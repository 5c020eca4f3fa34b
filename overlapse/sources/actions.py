"""Reversible actions on files, reports and review verdicts. File moves happen on the driver, one by one."""

from __future__ import annotations

import html
import json
import os
import shutil
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlapse.functions.scalar import basename, span_text


def apply_plan(plan: DataFrame, folder: str, dry_run: bool = True, created_at: float | None = None) -> list[dict]:
    """Move the plan's files (content_id, path, reason) to ``folder`` and write manifest.json there.

    The manifest is written before the first move, so that what was moved can be
    restored whatever happens; rows are fetched one partition at a time.
    """
    items = [{"content_id": r["content_id"], "src": r["path"], "dst": os.path.join(folder, f"{i:06d}-{os.path.basename(r['path'])}"), "reason": r["reason"]} for i, r in enumerate(plan.orderBy("path").toLocalIterator()) if os.path.exists(r["path"])]
    if dry_run:
        return items
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "manifest.json"), "w", encoding="utf-8") as f:
        json.dump({"created_at": time.time() if created_at is None else created_at, "items": items}, f, indent=2)
    for x in items:
        shutil.move(x["src"], x["dst"])
    return items


def read_manifest(folder: str) -> dict:
    with open(os.path.join(folder, "manifest.json"), encoding="utf-8") as f:
        return json.load(f)


def restore(folder: str) -> int:
    """Move files back to where they came from; places taken meanwhile are left alone."""
    done = 0
    for x in read_manifest(folder)["items"]:
        if os.path.exists(x["dst"]) and not os.path.exists(x["src"]):
            os.makedirs(os.path.dirname(x["src"]) or ".", exist_ok=True)
            shutil.move(x["dst"], x["src"])
            done += 1
    return done


def purge(folder: str, ttl_days: float, now: float | None = None) -> int:
    """Delete files that have been in ``folder`` for longer than ``ttl_days``."""
    manifest = read_manifest(folder)
    if manifest["created_at"] > (time.time() if now is None else now) - ttl_days * 86400:
        return 0
    there = [x["dst"] for x in manifest["items"] if os.path.exists(x["dst"])]
    for path in there:
        os.remove(path)
    return len(there)


def report_rows(decisions: DataFrame, files: DataFrame) -> DataFrame:
    """One row a cluster of two or more, the largest first: its span and the names kept and dropped."""
    named = decisions.join(files.select(F.col("content_id").alias("vid"), basename(F.col("path")).alias("name")), "vid", "left")
    name = F.coalesce("name", "vid")
    kept = F.sort_array(F.collect_list(F.when(F.col("action") == "keep", name)))
    dropped = F.sort_array(F.collect_list(F.when(F.col("action") == "prune", F.concat(name, F.lit(" <- "), F.coalesce("dominated_by", F.lit("?"))))))
    rows = named.groupBy("cluster").agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("e").alias("hi"), kept.alias("kept"), dropped.alias("dropped"))
    return rows.filter("n > 1").withColumn("span", span_text(F.col("lo"), F.col("hi"))).orderBy(F.desc("n"), "cluster")


def text_report(rows: DataFrame, verbose: bool = False) -> Iterator[str]:
    for r in rows.toLocalIterator():
        yield f"{r['cluster']}: {r['n']} items, {r['span']}, {len(r['dropped'])} to drop"
        if verbose:
            yield from (f"  keep {x}" for x in r["kept"])
            yield from (f"  drop {x}" for x in r["dropped"])


def html_report(rows: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write("<!DOCTYPE html><meta charset=utf-8><title>Report</title><table><tr><th>Cluster<th>Items<th>Span<th>Keep<th>Drop\n")
        for r in rows.toLocalIterator():
            cells = [r["cluster"], str(r["n"]), r["span"], ", ".join(r["kept"]), ", ".join(r["dropped"])]
            f.write("<tr>" + "".join(f"<td>{html.escape(str(x))}" for x in cells) + "\n")
        f.write("</table>\n")


def review_report(queue: DataFrame, files: DataFrame) -> Iterator[str]:
    """The pairs to look at, the surest first, by the names of their files."""
    named = files.select("content_id", basename(F.col("path")).alias("name"))
    for side in ("a", "b"):
        queue = queue.join(named.select(F.col("content_id").alias(side), F.col("name").alias(f"name_{side}")), side, "left")
    for r in queue.orderBy(F.desc("confidence"), "a", "b").toLocalIterator():
        yield f"{r['name_a'] or r['a']} ~ {r['name_b'] or r['b']}: {r['modality']}, offset {r['beta']:.1f} s, {r['a_inliers']} by sound, {r['v_inliers']} by picture, confidence {r['confidence']:.2f}"
