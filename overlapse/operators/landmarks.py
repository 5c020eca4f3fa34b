"""Landmarks: (cid, hash, t) from texts, and from ordered peaks by fan-out pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from overlapse.functions.scalar import pack_landmark

TOKEN = r"[^ \t\n\r]+"


def text_hash(text: Column) -> Column:
    """60 bits of the MD5 digest, the same number in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def content_id(text: Column) -> Column:
    return F.sha2(text, 256)


def shingles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """(cid, hash, t): each run of ``size`` tokens with its token position; none in shorter texts.

    ``part`` (i, n) takes those of the i-th of n parts only; all runs of one hash are in one part.
    """
    tokens = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"({TOKEN})"), 1)
    some = docs.select(F.col(id_col).alias("cid"), tokens.alias("tok")).filter(F.size("tok") >= size)
    # tokens are picked one by one: a slice would copy an array for each shingle
    runs = F.transform(F.sequence(F.lit(0), F.size("tok") - size), lambda i: F.concat_ws(" ", *[F.get(F.col("tok"), i + k) for k in range(size)]))
    if part[1] > 1:
        # told by two tokens, before runs are joined and hashed
        own = F.filter(F.sequence(F.lit(0), F.size("tok") - size), lambda i: F.pmod(F.xxhash64(F.get(F.col("tok"), i), F.get(F.col("tok"), i + 1)), F.lit(part[1])) == part[0])
        runs = F.transform(own, lambda i: F.struct(i.alias("t"), F.concat_ws(" ", *[F.get(F.col("tok"), i + k) for k in range(size)]).alias("shingle")))
        return some.select("cid", F.explode(runs).alias("r")).select("cid", text_hash(F.col("r.shingle")).alias("hash"), F.col("r.t").cast("double").alias("t"))
    return some.select("cid", F.posexplode(runs).alias("t", "shingle")).select("cid", text_hash(F.col("shingle")).alias("hash"), F.col("t").cast("double").alias("t"))


def line_landmarks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_tokens: int = 3) -> DataFrame:
    """(cid, hash, t): each line of ``min_tokens`` tokens or more, placed at the token that it begins with."""
    one = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("cid"), F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))
    counted = one.withColumn("n", F.regexp_count("line", F.lit(TOKEN)))
    before = W.partitionBy("cid").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    placed = counted.withColumn("t", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("double"))
    return placed.filter(F.col("n") >= min_tokens).select("cid", text_hash(F.col("line")).alias("hash"), "t")


def fan_out(peaks: DataFrame, fan: int = 15, max_dt: float = 5.0, order: tuple[str, ...] = ("t", "f")) -> DataFrame:
    """(cid, f1, f2, t, dt): each peak with the next ``fan`` of its file, up to ``max_dt`` later."""
    ahead = W.partitionBy("cid").orderBy(*order).rowsBetween(1, fan)
    paired = peaks.withColumn("next", F.collect_list(F.struct("t", "f")).over(ahead))
    each = paired.select("cid", F.col("f").alias("f1"), "t", F.explode("next").alias("n"))
    return each.select("cid", "f1", F.col("n.f").alias("f2"), "t", (F.col("n.t") - F.col("t")).alias("dt")).filter((F.col("dt") >= 0) & (F.col("dt") <= max_dt))


def landmark_hashes(pairs: DataFrame, unit: float = 1.0) -> DataFrame:
    """(cid, hash, t) of fan-out pairs; time differences are counted in ``unit``."""
    return pairs.select("cid", pack_landmark(F.col("f1"), F.col("f2"), F.floor(F.col("dt") / unit)).alias("hash"), "t")


def local_maxima(grid: DataFrame, size: int = 20, by: str = "cid") -> DataFrame:
    """Cells (t, f, v) that are the largest of the ``size`` by ``size`` cells around them.

    Two separable passes of one-dimensional maxima; for an even size the window reaches
    size / 2 back and size / 2 - 1 ahead.
    """
    back, ahead = -(size // 2), (size - 1) // 2
    along_f = W.partitionBy(by, "t").orderBy("f").rangeBetween(back, ahead)
    along_t = W.partitionBy(by, "f").orderBy("t").rangeBetween(back, ahead)
    return grid.withColumn("m1", F.max("v").over(along_f)).withColumn("m2", F.max("m1").over(along_t)).filter(F.col("v") == F.col("m2")).drop("m1", "m2")


def active_frames(frames: DataFrame, energy_pct: float = 20.0, flux_pct: float = 25.0) -> DataFrame:
    """Frames (cid, t, energy, flux) at or above either percentile of their file."""
    p = frames.groupBy("cid").agg(F.percentile("energy", energy_pct / 100).alias("_e"), F.percentile("flux", flux_pct / 100).alias("_f"))
    return frames.join(p, "cid").filter((F.col("energy") >= F.col("_e")) | (F.col("flux") >= F.col("_f"))).drop("_e", "_f")


def spectral_flux(grid: DataFrame) -> DataFrame:
    """(cid, t, flux): the rises of all bands since the frame before; 0 in the first frame."""
    rise = F.col("v") - F.lag("v").over(W.partitionBy("cid", "f").orderBy("t"))
    return grid.withColumn("rise", F.greatest(F.coalesce(rise, F.lit(0.0)), F.lit(0.0))).groupBy("cid", "t").agg(F.sum("rise").alias("flux"))
