"""Media primitives: decoding by an external program where there is one, and features from decoded tables.

Decoded tables are frames(cid, t, height, width, data) with one or three bytes a pixel, and
audio(cid, track, sr, data) with little-endian floats. Everything downstream takes these
tables, whatever made them.
"""

from __future__ import annotations

import json
import shutil
import subprocess
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlapse.config import Config
from overlapse.functions import image, signal

FRAMES = "cid string, t double, height int, width int, data binary"
AUDIO = "cid string, track int, sr int, data binary"


def filter_graph(fps: float | None = None, width: int | None = None, height: int | None = None, crop: tuple[int, int, int, int] | None = None, gray: bool = True) -> str:
    """The decoder's filters: times from 0, then crop, rate, size and pixel format."""
    parts = ["setpts=PTS-STARTPTS"]
    if crop:
        parts.append("crop={}:{}:{}:{}".format(*crop))
    if fps:
        parts.append(f"fps={fps}")
    if width and height:
        parts.append(f"scale={width}:{height}")
    return ",".join([*parts, f"format={'gray' if gray else 'rgb24'}"])


def has_decoder() -> bool:
    return shutil.which("ffmpeg") is not None and shutil.which("ffprobe") is not None


def _output(command: list[str]) -> bytes | None:
    """What a program writes; None where it fails or there is none."""
    try:
        got = subprocess.run(command, capture_output=True)
    except OSError:
        return None
    return got.stdout if got.returncode == 0 else None


class FfmpegDecoder:
    """Frames and sound of files by the external programs, a file a row; what can't be read gives nothing."""

    def __init__(self, cfg: Config) -> None:
        self.cfg = cfg

    def probe(self, files: DataFrame) -> DataFrame:
        """(path, probe_json) of files(path); null where the prober fails."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [_output(["ffprobe", "-v", "quiet", "-of", "json", "-show_streams", "-show_format", p]) for p in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.decode(errors="replace") if x else None for x in found], pa.string())], ["path", "probe_json"])

        return files.select("path").mapInArrow(run, "path string, probe_json string")

    def _frames(self, files: DataFrame, grab: Callable[[dict], Iterator[tuple[float, int, int, bytes]]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    found = list(grab(row))
                    if found:
                        t, h, w, data = zip(*found)
                        yield pa.RecordBatch.from_arrays([pa.array([row["cid"]] * len(t)), pa.array(t, pa.float64()), pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array(data, pa.binary())], ["cid", "t", "height", "width", "data"])

        return files.mapInArrow(run, FRAMES)

    @staticmethod
    def _raw(path: str, before: list[str], graph: str, more: list[str], w: int, h: int) -> list[bytes]:
        raw = _output(["ffmpeg", "-v", "quiet", "-nostdin", *before, "-i", path, "-vf", graph, *more, "-f", "rawvideo", "-"]) or b""
        size = w * h * (1 if "gray" in graph else 3)
        return [raw[i : i + size] for i in range(0, len(raw) - size + 1, size)] if size else []

    def keyframes(self, files: DataFrame, side: int = 64, limit: int = 4000) -> DataFrame:
        """Gray key frames of files(cid, path), with their times where the prober tells them, else their numbers."""

        def grab(row: dict) -> Iterator[tuple[float, int, int, bytes]]:
            listed = _output(["ffprobe", "-v", "quiet", "-select_streams", "v:0", "-skip_frame", "nokey", "-show_entries", "frame=pts_time", "-of", "csv=p=0", row["path"]]) or b""
            times = [float(x) for x in listed.decode().replace(",", " ").split() if x.replace(".", "", 1).lstrip("-").isdigit()]
            found = self._raw(row["path"], ["-skip_frame", "nokey"], filter_graph(None, side, side), ["-frames:v", str(limit), "-fps_mode", "vfr"], side, side)
            for k, x in enumerate(found):
                yield (times[k] - times[0] if k < len(times) else float(k)), side, side, x

        return self._frames(files.select("cid", "path"), grab)

    def sparse(self, files: DataFrame) -> DataFrame:
        """Colour frames of files(cid, path, width, height, crop, times) at the given times."""

        def grab(row: dict) -> Iterator[tuple[float, int, int, bytes]]:
            w, h, crop = row["width"], row["height"], row["crop"]
            graph = filter_graph(None, w, h, (crop["w"], crop["h"], crop["x"], crop["y"]) if crop else None, gray=False)
            for t in row["times"] or []:
                for x in self._raw(row["path"], ["-ss", str(t)], graph, ["-frames:v", "1"], w, h):
                    yield t, h, w, x

        return self._frames(files.select("cid", "path", "width", "height", "crop", "times"), grab)

    def dense(self, files: DataFrame) -> DataFrame:
        """Colour frames of files(cid, path, width, height, crop) at the configured rate."""
        fps = self.cfg.vision.sample_fps

        def grab(row: dict) -> Iterator[tuple[float, int, int, bytes]]:
            w, h, crop = row["width"], row["height"], row["crop"]
            graph = filter_graph(fps, w, h, (crop["w"], crop["h"], crop["x"], crop["y"]) if crop else None, gray=False)
            for k, x in enumerate(self._raw(row["path"], [], graph, [], w, h)):
                yield k / fps, h, w, x

        return self._frames(files.select("cid", "path", "width", "height", "crop"), grab)

    def audio(self, files: DataFrame, measured: bool = False) -> DataFrame:
        """One mono track of files(cid, path, track), resampled; levelled to -23 LUFS if the configuration says so.

        To be ``measured``, it is neither levelled nor brought to the landmarks' low rate.
        """
        sr = self.cfg.audio.measured_sr if measured else self.cfg.audio.sr
        level = self.cfg.audio.loudnorm and not measured
        graph = ",".join(["asetpts=PTS-STARTPTS", *(["loudnorm=I=-23:LRA=7:tp=-2"] if level else []), f"aresample={sr}"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    raw = _output(["ffmpeg", "-v", "quiet", "-nostdin", "-i", row["path"], "-map", f"0:a:{row['track']}?", "-ac", "1", "-ar", str(sr), "-af", graph, "-f", "f32le", "-"])
                    if raw:
                        yield pa.RecordBatch.from_arrays([pa.array([row["cid"]]), pa.array([row["track"]], pa.int32()), pa.array([sr], pa.int32()), pa.array([raw], pa.binary())], ["cid", "track", "sr", "data"])

        return files.select("cid", "path", "track").mapInArrow(run, AUDIO)


class TableDecoder:
    """Frames and sound that were decoded elsewhere: probes(path, probe_json), frames(path, t, height, width, data)
    and audio(path, track, sr, data)."""

    def __init__(self, cfg: Config, probes: DataFrame, frames: DataFrame, audio: DataFrame) -> None:
        self.cfg, self.probes, self.frames, self.sound = cfg, probes, frames, audio

    def probe(self, files: DataFrame) -> DataFrame:
        return files.select("path").join(self.probes.select("path", "probe_json"), "path", "left")

    def _of(self, files: DataFrame) -> DataFrame:
        return files.join(self.frames, "path")

    def keyframes(self, files: DataFrame) -> DataFrame:
        return self._of(files.select("cid", "path")).select("cid", "t", "height", "width", "data")

    def sparse(self, files: DataFrame) -> DataFrame:
        """The frame nearest to each time."""
        near = self._of(files.select("cid", "path", F.explode("times").alias("at")))
        best = near.groupBy("cid", "at").agg(F.min_by(F.struct("height", "width", "data"), F.struct(F.abs(F.col("t") - F.col("at")), "t")).alias("x"))
        return best.select("cid", F.col("at").alias("t"), "x.height", "x.width", "x.data")

    def dense(self, files: DataFrame) -> DataFrame:
        """The first frame of each step of the configured rate."""
        fps = self.cfg.vision.sample_fps
        step = F.floor(F.col("t") * fps + 1e-9)
        best = self._of(files.select("cid", "path")).groupBy("cid", step.alias("k")).agg(F.min_by(F.struct("height", "width", "data"), "t").alias("x"))
        return best.select("cid", (F.col("k") / fps).alias("t"), "x.height", "x.width", "x.data")

    def audio(self, files: DataFrame, measured: bool = False) -> DataFrame:
        """The stored tracks as they are, at whatever rate they have."""
        return files.select("cid", "path", "track").join(self.sound, ["path", "track"]).select("cid", "track", "sr", "data")


def pictures(rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, [n, height, width, channels]) of frames of one size and kind; one or three channels."""
    h, w = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("height", "width"))
    n = pc.binary_length(rows.column("data")).to_numpy(zero_copy_only=False)
    kinds = np.stack([h, w, n // np.maximum(h * w, 1)], axis=1)
    for kind in np.unique(kinds, axis=0):
        at = np.flatnonzero((kinds == kind).all(axis=1))
        data = rows.column("data").take(pa.array(at)).to_pylist()
        yield at, np.stack([np.frombuffer(x, dtype=np.uint8).reshape(*kind) for x in data])


def gray(frames: np.ndarray) -> np.ndarray:
    return frames[..., 0] if frames.shape[-1] == 1 else frames.mean(axis=-1).astype(np.uint8)


def frame_features(frames: DataFrame, cfg: Config) -> DataFrame:
    """(cid, t, phash, entropy, edge, informative), a row a frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, colour in pictures(batch):
                x, rows = gray(colour), batch.take(pa.array(at))
                ent, edge = image.entropy(x), image.edge_density(x)
                yield pa.RecordBatch.from_arrays([rows.column("cid"), rows.column("t"), pa.array(image.perceptual_hash(x)), pa.array(ent), pa.array(edge), pa.array((ent >= cfg.vision.entropy_min) & (edge >= cfg.vision.edge_density_min))], ["cid", "t", "phash", "entropy", "edge", "informative"])

    return frames.mapInArrow(run, "cid string, t double, phash long, entropy double, edge double, informative boolean")


# The channels' means and deviations that published image models are trained with.
CHANNEL_MEAN, CHANNEL_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def prepared(frames: np.ndarray, size: int) -> np.ndarray:
    """[n, 3, size, size] floats: resized, scaled to 0..1 and normalised by channel; gray frames stand for all three."""
    rgb = frames if frames.shape[-1] == 3 else np.repeat(frames, 3, axis=-1)
    planes = [image.resize(rgb[..., c], size, size) / 255.0 for c in range(3)]
    return np.stack([(x - m) / s for x, m, s in zip(planes, CHANNEL_MEAN, CHANNEL_STD)], axis=1).astype(np.float32)


#: Frames that a model gets at once.
EMBED_BATCH = 32


def embeddings(frames: DataFrame, embed: Callable[[np.ndarray], np.ndarray], cfg: Config) -> DataFrame:
    """(cid, t, vec) of unit length by an injected model over prepared batches; mirrored frames too, if configured.

    ``embed`` is called in the workers and may load its model once there (for example by ``functools.cache``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, colour in pictures(batch):
                rows = batch.take(pa.array(at))
                for x in [colour, colour[:, :, ::-1]] if cfg.vision.flip_augment else [colour]:
                    parts = [np.asarray(embed(prepared(x[i : i + EMBED_BATCH], cfg.vision.embed_size)), dtype=np.float64) for i in range(0, len(x), EMBED_BATCH)]
                    v = np.concatenate(parts)
                    v = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1]), pa.int32()), pa.array(v.ravel()))
                    yield pa.RecordBatch.from_arrays([rows.column("cid"), rows.column("t"), lists], ["cid", "t", "vec"])

    return frames.mapInArrow(run, "cid string, t double, vec array<float>")


def descriptors(frames: DataFrame, cfg: Config, embed: Callable[[np.ndarray], np.ndarray] | None = None, every: bool = False) -> DataFrame:
    """(cid, t, vec, phash) of informative frames, or of ``every`` frame; vectors are empty without a model."""
    features = frame_features(frames, cfg)
    kept = (features if every else features.filter("informative")).select("cid", "t", "phash")
    if embed is None:
        return kept.select("cid", "t", F.array().cast("array<float>").alias("vec"), "phash")
    return embeddings(frames, embed, cfg).join(kept, ["cid", "t"]).select("cid", "t", "vec", "phash")


#: Frames of a file that its measures take, at most; evenly spaced.
SAMPLED = 64


def picture_measures(frames: DataFrame, cfg: Config) -> DataFrame:
    """(cid, detail, blockiness, banding, crop, frame_id) of each file's frames, those of its commonest size.

    All frames of a file are one group: sparse decoding and key frames bound them.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("t").combine_chunks().to_batches()[0]
        x = gray(max((p for _, p in pictures(rows)), key=len))
        crop = image.active_crop(x)
        some = x if len(x) <= SAMPLED else x[np.rint(np.linspace(0, len(x) - 1, SAMPLED)).astype(int)]
        return pa.table({"cid": [rows.column("cid")[0].as_py()], "detail": [float(image.detail(some, cfg.quality.reff_detail_band))], "blockiness": [float(image.blockiness(some))], "banding": [float(image.banding(some))], "crop": pa.array([json.dumps(crop) if crop else None], pa.string()), "frame_id": [image.content_id(x)]})

    return frames.groupBy("cid").applyInArrow(run, "cid string, detail double, blockiness double, banding double, crop string, frame_id string")


def audio_landmarks(audio: DataFrame, cfg: Config) -> DataFrame:
    """(cid, track, hash, t) of decoded tracks."""
    a = cfg.audio

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, t = signal.fingerprint(np.frombuffer(row["data"], dtype="<f4"), row["sr"], a.fan_value, a.max_dt, a.min_hash_time_delta, a.frame, a.hop, a.peak_neighborhood, a.energy_pct, a.flux_pct)
                yield pa.RecordBatch.from_arrays([pa.array([row["cid"]] * len(t), pa.string()), pa.array([row["track"]] * len(t), pa.int32()), pa.array(hashes), pa.array(t, pa.float64())], ["cid", "track", "hash", "t"])

    return audio.mapInArrow(run, "cid string, track int, hash long, t double")


def audio_measures(audio: DataFrame) -> DataFrame:
    """(cid, track, bw, clip_ratio, dropout) of decoded tracks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(np.frombuffer(r["data"], dtype="<f4"), r["sr"]) for r in batch.select(["data", "sr"]).to_pylist()]
            found = [[float(signal.bandwidth(x, s)) for x, s in rows], [float(signal.clip_ratio(x)) for x, _ in rows], [float(signal.dropout_ratio(x, s)) for x, s in rows]]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("track"), *[pa.array(x, pa.float64()) for x in found]], ["cid", "track", "bw", "clip_ratio", "dropout"])

    return audio.mapInArrow(run, "cid string, track int, bw double, clip_ratio double, dropout double")


def detected_languages(audio: DataFrame, model: Callable[[np.ndarray, int], str | None] | None) -> DataFrame:
    """(cid, track, lang) by an injected model; null without one."""
    if model is None:
        return audio.select("cid", "track", F.lit(None).cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model(np.frombuffer(r["data"], dtype="<f4"), r["sr"]) for r in batch.select(["data", "sr"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("track"), pa.array(found, pa.string())], ["cid", "track", "lang"])

    return audio.mapInArrow(run, "cid string, track int, lang string")


def vmaf_scores(pairs: DataFrame, score: Callable[[str, str, float, float, float], float | None]) -> DataFrame:
    """(cluster, vid, vmaf) of pairs (cluster, vid, path, ref_path, start, ref_start, length) by an external full-reference measure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score(r["path"], r["ref_path"], r["start"], r["ref_start"], r["length"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("vid"), pa.array(found, pa.float64())], ["cluster", "vid", "vmaf"])

    return pairs.mapInArrow(run, "cluster string, vid string, vmaf double")
