"""Column functions. All are built from Spark's own expressions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from overlapse.config import CODEC_EFFICIENCY, CODEC_RANK, UNKNOWN_LANGS


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def rational(text: Column) -> Column:
    """'30000/1001' to a double; null for '0/0', empty and malformed text."""
    top = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double")
    below = F.when(F.contains(text, F.lit("/")), F.split_part(text, F.lit("/"), F.lit(2)).try_cast("double")).otherwise(F.lit(1.0))
    return F.try_divide(top, below)


def language(tag: Column) -> Column:
    """Lower-cased tag; '' for null and for tags that mean unknown."""
    low = F.lower(F.trim(F.coalesce(tag, F.lit(""))))
    return F.when(low.isin(*UNKNOWN_LANGS), "").otherwise(low)


def codec_rank(codec: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CODEC_RANK.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(codec)), F.lit(0))


def codec_efficiency(codec: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CODEC_EFFICIENCY.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(codec)), F.lit(1.0))


def bits_per_pixel(bitrate: Column, w: Column, h: Column, fps: Column, codec: Column) -> Column:
    """Normalised to H.264; null where any input is missing or 0."""
    known = (bitrate > 0) & (w > 0) & (h > 0) & (fps > 0)
    return F.when(known, bitrate / (w * h * fps) * codec_efficiency(codec))


def audio_rate(bitrate: Column, channels: Column, codec: Column) -> Column:
    """Bits a second and channel, normalised to AAC; null where any input is missing or 0."""
    return F.when((bitrate > 0) & (channels > 0), bitrate / channels * codec_efficiency(codec))


def idf(n: Column, df: Column, smoothing: float = 1.0) -> Column:
    """ln((N + s) / (df + s)) + 0.001."""
    return F.log((n + smoothing) / (df + smoothing)) + 1e-3


def pack_landmark(f1: Column, f2: Column, dt: Column) -> Column:
    """Three 10-bit fields in one 30-bit number."""
    low = [x.cast("bigint").bitwiseAND(F.lit(1023)) for x in (f1, f2, dt)]
    return F.shiftleft(low[0], 20).bitwiseOR(F.shiftleft(low[1], 10)).bitwiseOR(low[2])


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def covered_fraction(s: Column, e: Column, lo: Column, hi: Column) -> Column:
    """Share of [lo, hi] that [s, e] covers; 0 for an empty span."""
    overlap = F.greatest(F.lit(0.0), F.least(e, hi) - F.greatest(s, lo))
    return F.when(hi - lo > 0, overlap / (hi - lo)).otherwise(0.0)


def even_times(duration: Column, n: int) -> Column:
    """n timestamps at the middles of n equal parts."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i + 0.5) * duration / n)


def even_indices(n: Column, wanted: int) -> Column:
    """At most ``wanted`` of the indices 0..n-1, evenly spaced, rounded half to even."""
    few = F.sequence(F.lit(0), F.greatest(n.cast("int") - 1, F.lit(0)))
    many = F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: F.rint(i * (n - 1) / F.lit(wanted - 1)).cast("int"))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= wanted, few).otherwise(many)


def fit_resolution(w: Column, h: Column, long_side: int | None) -> tuple[Column, Column]:
    """Even dimensions with the long side at most ``long_side``; never enlarged, 2 at least when shrunk."""
    if long_side is None:
        return w - w % 2, h - h % 2
    long = F.lit(long_side)
    shrunk_w = F.when(w >= h, long).otherwise(F.greatest(F.lit(2), F.rint(w * long / h).cast("int")))
    shrunk_h = F.when(w >= h, F.greatest(F.lit(2), F.rint(h * long / w).cast("int"))).otherwise(long)
    fits = F.greatest(w, h) <= long
    new_w, new_h = F.when(fits, w).otherwise(shrunk_w), F.when(fits, h).otherwise(shrunk_h)
    return new_w - new_w % 2, new_h - new_h % 2


def confidence(n: Column, span: Column, residual: Column, both: Column) -> Column:
    """(1 - e^(-n/8)) (1 - e^(-span/10)) / (1 + residual), a bonus of 15 % if both channels agree, 1 at most."""
    base = (1 - F.exp(-n / 8)) * (1 - F.exp(-span / 10)) / (1 + residual)
    return F.least(F.lit(1.0), base * F.when(both, 1.15).otherwise(1.0))


def span_text(lo: Column, hi: Column) -> Column:
    """'12 min' from a minute on, '45 s' below."""
    minutes = F.greatest(F.lit(0.0), hi - lo) / 60
    return F.when(minutes >= 1, F.format_string("%d min", F.rint(minutes).cast("int"))).otherwise(F.format_string("%d s", F.floor(minutes * 60).cast("int")))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def unescape(text: Column) -> Column:
    """Shell escapes: a backslash gives way to the character after it."""
    return F.regexp_replace(text, r"\\(.)", "$1")


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(counts, F.lit(0.0), lambda s, x: s - F.when(x > 0, x / total * F.log2(x / total)).otherwise(0.0))


def lexicographic(*columns: Column | Sequence[Column]) -> Column:
    """A struct, whose comparison is that of tuples."""
    return F.struct(*columns)
