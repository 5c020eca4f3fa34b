"""Quality rules: thresholds from mergeable quantile sketches per language and source.

A sketch is a table of counts over logarithmic buckets (relative error at most
``ACCURACY``). Counts of two sketches add up, whatever the order, so sketches of
sources merge into those of languages and of the corpus, and thresholds are the
same on every run. Fences are found in two steps, both from quantiles alone:

1. each group's core: rows within ``TRIM`` quartile distances of the median, in every
   metric whose quartile differs from the median;
2. from the core's own sketches, the 99 % quantile and ``SLACK`` times its distance from the
   median (and the same below, for metrics with a lower side).

Junk that stands out in one metric so leaves the core, and doesn't widen the fences of the
others; a metric that piles up at zero gets a fence from the upper end of its core. Groups
with few rows take the fences of their language, or of the corpus.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from overlapse.llm.arrowtext import byte_steps, text_stats, trimmed
from overlapse.workspace import materialise, remove

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: Rows that a group needs for a sketch of its own.
MIN_ROWS = 200
#: Quartile distances from the median to the edge of a group's core.
TRIM = 3.0
#: Quantile of the core where fences start, and multiples of its distance from the median that are added to it.
EDGE, SLACK = 0.99, 2.0
#: Name: (value, whether it has a lower fence).
METRICS: dict[str, tuple[str, bool]] = {
    "word_length": ("word_chars / n_words", True),
    "symbols": ("n_symbols / n_words", False),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", False),
    "repeats": ("n_repeat_words / n_words", False),
    "capitals": ("n_upper / greatest(word_chars, 1)", False),
    "marks": ("n_marks / n_words", False),
}
#: A broadcast of fences is limited to this many groups; beyond it they are joined by shuffle.
BROADCAST_GROUPS = 20_000


def with_stats(docs: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with a struct column ``_stats``; without the text unless ``keep_text``."""
    kept = [c for c in docs.columns if keep_text or c != text_col]
    kind = T.StructType([T.StructField(c, T.LongType()) for c in STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(text_col)
            for start, stop in byte_steps(text):
                found = text_stats(text.slice(start, stop - start))
                stats = pa.StructArray.from_arrays([pa.array(found[c], pa.int64()) for c in STATS], names=list(STATS))
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), stats], [*kept, "_stats"])

    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add("_stats", kind)
    return docs.mapInArrow(trimmed(run), schema)


def failed_base() -> Column:
    n, r = F.col("_stats.n_words"), F.col("_stats.n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def metric(name: str) -> Column:
    """A metric's value, from the columns of ``_stats``."""
    at = METRICS[name][0].replace("n_words", "greatest(n_words, 1)")
    return F.expr(re.sub(r"\b(n_\w+|word_chars)\b", r"_stats.\1", at)).cast("double")


def sketch(stats: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): the sketch of each group, from rows that pass the base rules."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), metric(k).alias("value")) for k in METRICS])
    flat = stats.filter(~failed_base()).select("lang", "source", F.explode(pairs).alias("p"))
    bucket = F.when(F.col("p.value") <= 1e-9, F.lit(-100_000)).otherwise(F.ceil(F.log(F.col("p.value")) / math.log(GAMMA)).cast("int"))
    return flat.select("lang", "source", F.col("p.metric").alias("metric"), bucket.alias("bucket")).groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame) -> DataFrame:
    """Sketches at three levels: 2 language and source, 1 language, 0 all; merging is addition."""
    levels = [
        sketches.select(F.lit(2).alias("level"), "lang", "source", "metric", "bucket", "n"),
        sketches.select(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source"), "metric", "bucket", "n"),
        sketches.select(F.lit(0).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "metric", "bucket", "n"),
    ]
    return reduce(DataFrame.unionByName, levels).groupBy("level", "lang", "source", "metric", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, core: bool, min_rows: int = MIN_ROWS) -> DataFrame:
    """(level, lang, source, rows, <metric>_low, <metric>_high) from merged sketches; null where there is no fence.

    Values are buckets' outer edges, so that a group of equal values lies inside its fences.
    """
    group = ["level", "lang", "source", "metric"]
    up = W.partitionBy(*group).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    ranked = sketches.withColumn("upto", F.sum("n").over(up)).withColumn("rows", F.sum("n").over(W.partitionBy(*group)))

    def quantile(q: float, edge: int) -> Column:
        value = F.when(F.col("bucket") == -100_000, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), F.col("bucket") - edge))
        return F.min(F.when(F.col("upto") >= q * F.col("rows"), value))

    near, far = (0.25, 0.75) if core else (1 - EDGE, EDGE)
    found = ranked.groupBy(*group).agg(F.max("rows").alias("rows"), quantile(near, 1).alias("a"), quantile(0.5, 1).alias("b"), quantile(0.5, 0).alias("c"), quantile(far, 0).alias("d"))
    two_sided = F.col("metric").isin([k for k, (_, low) in METRICS.items() if low])
    if core:
        low, high = F.when(two_sided & (F.col("a") < F.col("b")), F.col("b") - TRIM * (F.col("b") - F.col("a"))), F.when(F.col("d") > F.col("c"), F.col("c") + TRIM * (F.col("d") - F.col("c")))
    else:
        low, high = F.when(two_sided, F.col("a") - SLACK * (F.col("b") - F.col("a"))), F.col("d") + SLACK * (F.col("d") - F.col("c"))
    both = found.filter((F.col("rows") >= min_rows) | (F.col("level") == 0)).withColumns({"high": high, "low": low})
    wide = [F.max(F.when(F.col("metric") == k, F.col(c))).alias(f"{k}_{c}") for k in METRICS for c in ("low", "high")]
    return both.groupBy("level", "lang", "source").agg(F.max("rows").alias("rows"), *wide)


def judge(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """``stats`` with ``_kept``: base rules, then each metric within the fences of the row's group."""
    n_groups = limits.count()
    cols = [f"{k}_{c}" for k in METRICS for c in ("low", "high")]
    packed = F.struct(*cols)
    own, lang, everyone = (limits.filter(F.col("level") == i) for i in (2, 1, 0))
    own = own.select(F.col("lang").alias("_gl"), F.col("source").alias("_gs"), packed.alias("_own"))
    lang = lang.select(F.col("lang").alias("_ll"), packed.alias("_lang"))
    hint = F.broadcast if n_groups <= BROADCAST_GROUPS else (lambda x: x)
    rows = stats.join(hint(own), F.col("lang").eqNullSafe(F.col("_gl")) & F.col("source").eqNullSafe(F.col("_gs")), "left")
    rows = rows.join(hint(lang), F.col("lang").eqNullSafe(F.col("_ll")), "left")
    first = everyone.select(packed.alias("x")).head()
    whole = F.struct(*[F.lit(first["x"][c]).cast("double").alias(c) for c in cols]) if first else F.lit(None).cast("struct<" + ",".join(f"{c}:double" for c in cols) + ">")
    rows = rows.withColumn("_at", F.coalesce(F.col("_own"), F.col("_lang"), whole))
    inside = F.lit(True)
    for k in METRICS:
        inside = inside & F.coalesce(metric(k) <= F.col(f"_at.{k}_high"), F.lit(True)) & F.coalesce(metric(k) >= F.col(f"_at.{k}_low"), F.lit(True))
    return rows.withColumn("_kept", ~failed_base() & inside).drop("_gl", "_gs", "_ll", "_own", "_lang", "_at")


def found_fences(stats: DataFrame) -> DataFrame:
    """The fences of all groups, written; ``stats`` (lang, source, _stats) is read three times."""
    thin = stats.select("lang", "source", "_stats")
    core = materialise(fences(merged(sketch(thin)), core=True), "quality-core")
    limits = materialise(fences(merged(sketch(judge(thin, core).filter("_kept"))), core=False), "quality-fences")
    remove(core)
    return limits


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null text has no words and fails the base rules. Null languages and sources
    form groups of their own. Repeated rows and null ids are judged one by one, as
    any other row; an empty table gives an empty result; other columns are not read.
    """
    picked = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    stats = materialise(with_stats(picked), "quality-stats")
    rows = judge(stats, found_fences(stats))
    base = [F.col(f"_stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select("doc_id", *base, failed_base().alias("base_failed"), F.col("_kept").alias("kept"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``.

    Rows are written once with their statistics, so that they need no key: repeated rows
    and null ids are judged like any other.
    """
    names = docs.columns
    at = {c: f"_c{i}" for i, c in enumerate(names)}
    groups = [F.col(f"`{c}`").cast("string").alias(c) for c in ("lang", "source")]
    whole = docs.select(*[F.col(f"`{c}`").alias(at[c]) for c in names], *groups)
    rows = materialise(with_stats(whole, at["text"], keep_text=True), "quality-rows")
    return judge(rows, found_fences(rows)).filter("_kept").select(*[F.col(at[c]).alias(c) for c in names])
