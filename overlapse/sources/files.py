"""File scans, delta scans, exact duplicates, probe records and ground-truth lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlapse.config import VIDEO_EXTENSIONS
from overlapse.functions.scalar import basename, rational, unescape

PROBE = "streams array<struct<codec_type:string,codec_name:string,width:int,height:int,pix_fmt:string,duration:string,avg_frame_rate:string,r_frame_rate:string,bit_rate:string,sample_rate:string,channels:int,disposition:struct<attached_pic:int,`default`:int>,tags:struct<language:string>>>, format struct<duration:string,bit_rate:string>"


def scan(spark: SparkSession, roots: str | list[str], extensions: tuple[str, ...] = VIDEO_EXTENSIONS, streaming: bool = False) -> DataFrame:
    """(path, mtime, size_bytes, origin) of files below the roots, by extension in any case; contents aren't read.

    Any store that Spark's file systems reach will do; several roots are one scan.
    """
    reader = (spark.readStream if streaming else spark.read).format("binaryFile").option("recursiveFileLookup", "true")
    if streaming:
        reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
        files = reduce(DataFrame.unionAll, [reader.load(r) for r in ([roots] if isinstance(roots, str) else roots)])
    else:
        files = reader.load(roots)
    kept = files.filter(F.lower("path").rlike(r"\.(" + "|".join(extensions) + ")$"))
    return kept.select("path", F.unix_micros("modificationTime").cast("double").alias("us"), F.col("length").alias("size_bytes")).select("path", (F.col("us") / 1e6).alias("mtime"), "size_bytes", F.split_part("path", F.lit(":"), F.lit(1)).alias("origin"))


def delta(found: DataFrame, known: DataFrame, key: tuple[str, ...] = ("path", "mtime", "size_bytes")) -> DataFrame:
    """Files that are new or changed."""
    return found.join(known.select(*key), list(key), "left_anti")


def known_paths(files: DataFrame, dup_paths: DataFrame) -> DataFrame:
    """Paths that need no probing again, those of exact duplicates included."""
    return files.select("path").union(dup_paths.select("path")).distinct()


def gone(files: DataFrame, found: DataFrame) -> DataFrame:
    """Known files that a scan no longer finds."""
    return files.join(found.select("path"), "path", "left_anti")


def exact_duplicates(items: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """``items`` (content_id, path, ...) with status: new for the first path of an unknown content, else duplicate.

    The first path is an aggregate, so that a content with very many paths is never one task's
    work; rows without a content are new. Of rows with one content and path all have one status.
    """
    first = items.filter("content_id is not null").groupBy("content_id").agg(F.min("path").alias("_first"))
    if catalog is not None:
        had = catalog.select("content_id", F.lit(True).alias("_had")).distinct()
        first = first.join(had, "content_id", "left")
    else:
        first = first.withColumn("_had", F.lit(None).cast("boolean"))
    rows = items.join(first, "content_id", "left")
    new = F.col("content_id").isNull() | (F.col("_had").isNull() & F.col("path").eqNullSafe(F.col("_first")))
    return rows.withColumn("status", F.when(new, "new").otherwise("duplicate")).drop("_first", "_had")


def parse_probe(records: DataFrame, column: str = "probe_json") -> DataFrame:
    """``records`` with stream and audio metadata from a container probe's JSON.

    The first video stream that is no attached picture; the first duration that parses, the
    container's before the stream's; a frame rate that varies by over 1 % counts as variable.
    """
    parsed = records.withColumn("_p", F.from_json(column, PROBE))
    video = F.filter("_p.streams", lambda s: (s["codec_type"] == "video") & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) != 1))
    audio = F.filter("_p.streams", lambda s: s["codec_type"] == "audio")
    rows = parsed.withColumns({"_v": F.get(video, F.lit(0)), "_a": audio})
    avg, base = rational(F.col("_v.avg_frame_rate")), rational(F.col("_v.r_frame_rate"))
    tracks = F.transform("_a", lambda s, i: F.struct(i.alias("track"), s["codec_name"].alias("acodec"), s["sample_rate"].try_cast("int").alias("sample_rate"), s["channels"].alias("channels"), s["bit_rate"].try_cast("bigint").alias("audio_bitrate"), s["tags"]["language"].alias("lang_tag"), F.lit(None).cast("string").alias("lang_detected")))
    default = F.array_position(F.transform("_a", lambda s: F.coalesce(s["disposition"]["default"], F.lit(0))), 1).cast("int")
    return rows.withColumns({
        "declared_w": F.col("_v.width"), "declared_h": F.col("_v.height"), "vcodec": F.col("_v.codec_name"), "pix_fmt": F.col("_v.pix_fmt"),
        "declared_fps": F.coalesce(F.when(avg > 0, avg), base),
        "vfr": F.coalesce(F.abs(avg - base) / F.greatest(base, F.lit(1e-6)) > 0.01, F.lit(False)),
        "declared_bitrate": F.coalesce(F.col("_v.bit_rate").try_cast("bigint"), F.col("_p.format.bit_rate").try_cast("bigint")),
        "declared_duration": F.coalesce(F.col("_p.format.duration").try_cast("double"), F.col("_v.duration").try_cast("double")),
        "has_audio": F.coalesce(F.size("_a") > 0, F.lit(False)), "n_tracks": F.coalesce(F.size("_a"), F.lit(0)), "tracks": tracks,
        "default_track": F.coalesce(F.when(default > 0, default - 1), F.lit(0)),
    }).drop("_p", "_v", "_a")


def ground_truth(text: DataFrame, column: str = "value") -> DataFrame:
    """(left, right): the first two lines of each block between blank lines, unescaped, as base names."""
    blocks = text.select(F.explode(F.split(column, r"\n\s*\n")).alias("block"))
    lines = F.filter(F.transform(F.split("block", "\n"), F.trim), lambda x: x != "")
    pairs = blocks.select(F.transform(lines, lambda x: basename(unescape(x))).alias("l")).filter(F.size("l") >= 2)
    return pairs.select(F.element_at("l", 1).alias("left"), F.element_at("l", 2).alias("right"))


def vmaf_log(records: DataFrame, column: str = "log") -> DataFrame:
    """``records`` with the pooled mean of a full-reference log."""
    return records.withColumn("vmaf", F.get_json_object(column, "$.pooled_metrics.vmaf.mean").try_cast("double"))
