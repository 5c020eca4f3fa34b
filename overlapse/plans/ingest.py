"""From files to decisions: ingest, a cheap pass over all files, a dense pass over those that may match, and the run.

Every step reads what is already stored, so that a run after a failure or with more files does
only what is missing. The decoder is an object of ``sources.media``: one that calls the external
programs, or one that reads tables of decoded frames and sound.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlapse.config import Config
from overlapse.functions import scalar
from overlapse.operators import quality
from overlapse.plans import engine
from overlapse.schemas import DESCRIPTOR, LANDMARK
from overlapse.sources import files, media
from overlapse.sources.catalog import Catalog, FeatureCache
from overlapse.workspace import materialise, remove

Embed = Callable[[np.ndarray], np.ndarray]
#: Frames that a file's picture measures are taken from, and its length where the probe tells none.
MEASURED, UNKNOWN_SECONDS = 24, 30.0


@dataclass(frozen=True)
class Library:
    """Where a run keeps its tables, and how it gets at frames and sound."""

    spark: SparkSession
    root: str
    decoder: media.FfmpegDecoder | media.TableDecoder
    cfg: Config
    embed: Embed | None = None

    @property
    def catalog(self) -> Catalog:
        return Catalog(self.spark, f"{self.root}/catalog")

    @property
    def features(self) -> FeatureCache:
        return FeatureCache(self.spark, f"{self.root}/features")


def ingest(lib: Library, found: DataFrame) -> DataFrame:
    """(path, content_id, status) of scanned files (path, mtime, size_bytes): new, duplicate, known or error.

    A file whose path, time and size are known is skipped. Contents are told by their key
    frames; a file without any stands for itself. What can't be probed is an error and is
    tried again by the next run.
    """
    c = lib.catalog
    known = c.read("file").select("path", "mtime", "size_bytes")
    fresh = files.delta(found, known).join(c.read("dup_path").select("path").distinct(), "path", "left_anti")
    fresh = materialise(fresh.select("path", "mtime", "size_bytes"), "ingest-fresh")
    probed = materialise(fresh.join(lib.decoder.probe(fresh), "path"), "ingest-probed")
    good = files.parse_probe(probed.filter("probe_json is not null"))
    named = good.select(F.col("path").alias("cid"), "path")
    shown = media.picture_measures(lib.decoder.keyframes(named), lib.cfg).select(F.col("cid").alias("path"), "crop", "frame_id")
    own = F.concat(F.lit("stat-"), F.sha2(F.concat_ws(":", "path", F.col("size_bytes").cast("string")), 256).substr(1, 32))
    rows = good.join(shown, "path", "left").withColumn("content_id", F.coalesce("frame_id", own))
    crop = F.from_json("crop", "array<int>")
    rows = rows.withColumn("active_crop", F.when(crop.isNotNull(), F.struct(crop[0].alias("w"), crop[1].alias("h"), crop[2].alias("x"), crop[3].alias("y"))))
    marked = materialise(files.exact_duplicates(rows, c.read("file")).withColumn("ingested_at", F.unix_micros(F.current_timestamp()) / 1e6), "ingest-marked")
    new = marked.filter("status = 'new'")
    c.insert_absent("dup_path", marked.filter("status = 'duplicate'").join(c.read("file").select(F.col("path").alias("_p")), F.col("path") == F.col("_p"), "left_anti"))
    c.upsert("stream_meta", new)
    c.upsert("audio_meta", new)
    c.upsert("file", new)
    status = marked.select("path", "content_id", "status").unionByName(probed.filter("probe_json is null").select("path", F.lit(None).cast("string").alias("content_id"), F.lit("error").alias("status")))
    skipped = found.select("path").join(fresh.select("path"), "path", "left_anti").select("path", F.lit(None).cast("string").alias("content_id"), F.lit("known").alias("status"))
    return status.unionByName(skipped)


def decodable(lib: Library) -> DataFrame:
    """(cid, path, track, has_audio, width, height, crop, seconds) of all files on record."""
    c = lib.catalog
    meta = c.read("stream_meta").select("content_id", "declared_w", "declared_h", "declared_duration", F.col("active_crop").alias("crop"))
    sound = c.read("audio_meta").select("content_id", "has_audio")
    rows = c.read("file").select("content_id", "path").join(meta, "content_id", "left").join(sound, "content_id", "left")
    w, h = F.coalesce("crop.w", "declared_w", F.lit(2)), F.coalesce("crop.h", "declared_h", F.lit(2))
    fit_w, fit_h = scalar.fit_resolution(w, h, max(lib.cfg.vision.embed_size, 224))
    return rows.select(F.col("content_id").alias("cid"), "path", F.lit(0).alias("track"), F.coalesce("has_audio", F.lit(False)).alias("has_audio"), fit_w.cast("int").alias("width"), fit_h.cast("int").alias("height"), "crop", F.coalesce("declared_duration", F.lit(UNKNOWN_SECONDS)).alias("seconds"))


def _stored(lib: Library, kind: str, schema: str, wanted: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All features of a kind, after those of ``wanted`` files that lack them have been made; files without any are noted too."""
    parsed, done = lib.spark.createDataFrame([], schema).schema, lib.spark.createDataFrame([], "cid string").schema
    todo = materialise(lib.features.missing(f"{kind}-done", wanted, done), f"todo-{kind}")
    if todo.head(1):
        lib.features.save(kind, make(todo).select(*parsed.names))
        lib.features.save(f"{kind}-done", todo.select("cid").distinct())
    remove(todo)
    return lib.features.load(kind, parsed)


def first_pass(lib: Library) -> tuple[DataFrame, DataFrame]:
    """(landmarks, coarse descriptors) of all files: sound whole, pictures at a few even times."""
    rows = decodable(lib)
    heard = _stored(lib, "audio", LANDMARK, rows, lambda x: media.audio_landmarks(lib.decoder.audio(x.filter("has_audio")), lib.cfg))
    times = scalar.even_times(F.col("seconds"), lib.cfg.vision.coarse_frames)
    coarse = _stored(lib, "coarse", DESCRIPTOR, rows, lambda x: media.descriptors(lib.decoder.sparse(x.withColumn("times", times)), lib.cfg, lib.embed, every=True))
    return heard, coarse


def second_pass(lib: Library, active: DataFrame) -> DataFrame:
    """Dense descriptors of the active files (cid), whose quality is scored too."""
    rows = materialise(decodable(lib).join(active, "cid", "left_semi"), "active")
    dense = _stored(lib, "dense", DESCRIPTOR, rows, lambda x: media.descriptors(lib.decoder.dense(x), lib.cfg, lib.embed))
    score(lib, rows)
    return dense.join(active, "cid", "left_semi")


def score(lib: Library, rows: DataFrame) -> None:
    """Store the quality of files that have none."""
    c = lib.catalog
    todo = materialise(rows.join(c.read("quality").select(F.col("content_id").alias("cid")), "cid", "left_anti"), "todo-quality")
    if not todo.head(1):
        return
    seen = media.picture_measures(lib.decoder.sparse(todo.withColumn("times", scalar.even_times(F.col("seconds"), MEASURED))), lib.cfg)
    heard = media.audio_measures(lib.decoder.audio(todo.filter("has_audio"), measured=True))
    track = F.get("tracks", F.lit(0))
    sound = c.read("audio_meta").select(F.col("content_id").alias("cid"), track["channels"].alias("channels"), track["audio_bitrate"].alias("audio_bitrate"), track["acodec"].alias("acodec"))
    meta = c.read("stream_meta").select(F.col("content_id").alias("cid"), F.coalesce("active_crop.w", "declared_w", F.lit(0)).alias("width"), F.coalesce("active_crop.h", "declared_h", F.lit(0)).alias("height"), F.col("declared_bitrate").alias("bitrate"), F.col("declared_fps").alias("fps"), "vcodec")
    items = todo.select("cid", "has_audio").join(meta, "cid", "left").join(sound, "cid", "left").join(seen.select("cid", "detail", "blockiness", "banding"), "cid", "left").join(heard.drop("track"), "cid", "left")
    items = items.withColumns({"detail": F.coalesce("detail", F.lit(0.0)), "technical": F.lit(None).cast("double"), "artifact": F.greatest(F.coalesce("blockiness", F.lit(0.0)), F.coalesce("banding", F.lit(0.0))), **{x: F.coalesce(x, F.lit(0.0)) for x in ("bw", "clip_ratio", "dropout")}})
    scored = materialise(quality.score(items, lib.cfg.quality, lib.cfg.audio.measured_sr).withColumn("content_id", F.col("cid")), "scored")
    c.upsert("measure", scored)
    c.upsert("quality", scored)
    remove(scored)
    remove(todo)


def run(lib: Library, found: DataFrame, two_pass: bool = True) -> tuple[DataFrame, engine.Result]:
    """Ingest scanned files, match all that are on record, decide, and store the derived tables: (status of files, result)."""
    status = ingest(lib, found)
    landmarks, coarse = first_pass(lib)
    c = lib.catalog
    known = c.read("file")
    everyone = known.select(F.col("content_id").alias("cid"))
    active = materialise(engine.active_files(landmarks, coarse, known, lib.cfg) if two_pass else everyone, "active-files")
    dense = second_pass(lib, active)
    primitives = engine.Primitives(known, c.read("stream_meta"), c.read("audio_meta"), c.read("quality"), landmarks.join(active, "cid", "left_semi").join(everyone, "cid", "left_semi"), dense.join(everyone, "cid", "left_semi"))
    result = engine.run(primitives, lib.cfg)
    engine.persist(lib.spark, f"{lib.root}/catalog", result, uuid.uuid4().hex[:12], lib.cfg.align.cycle_residual_tol)
    return status, result
