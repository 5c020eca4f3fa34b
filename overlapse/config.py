"""Engine configuration: frozen sections, loaded as defaults, then a file, then overrides."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field, fields, replace
from typing import Any

# Weights, floors and tables that results depend on.
CODEC_RANK = {"av1": 5, "hevc": 4, "h265": 4, "vp9": 3, "h264": 2, "mpeg4": 1}
UNKNOWN_LANGS = ("und", "unknown", "none", "mis", "zxx")
CHANNEL_PRIOR = {"audio": 1.0, "visual": 0.6}
VIDEO_EXTENSIONS = ("mp4", "mkv", "avi", "mov", "m4v", "wmv", "flv", "webm", "mpg", "mpeg", "ts")
#: Modalities of edges that count as video-grounded.
GROUNDED = ("both", "visual", "audio_variant")


@dataclass(frozen=True)
class VisionConfig:
    sample_fps: float = 1.0
    embed_size: int = 288
    entropy_min: float = 2.0
    edge_density_min: float = 0.01
    coarse_frames: int = 24
    flip_augment: bool = False


@dataclass(frozen=True)
class AudioConfig:
    sr: int = 16000
    #: Rate at which sound is measured: high enough to see where a codec cuts it off.
    measured_sr: int = 44100
    frame: int = 4096
    hop: int = 2048
    peak_neighborhood: int = 20
    fan_value: int = 15
    min_hash_time_delta: float = 0.0
    max_dt: float = 5.0
    flux_pct: float = 25.0
    energy_pct: float = 20.0
    loudnorm: bool = True


@dataclass(frozen=True)
class CandidateConfig:
    knn_k: int = 10
    visual_sim_min: float = 0.6
    hamming_max: int = 10
    min_vote_mass: float = 3.0
    min_shared_audio_hashes: int = 5
    coarse_visual_min: int = 3
    idf_smoothing: float = 1.0


@dataclass(frozen=True)
class AlignConfig:
    offset_bin: float = 0.25
    alpha_grid: tuple[float, float, float] = (0.96, 1.04, 0.005)
    inlier_tol: float = 0.5
    min_inliers: int = 6
    min_span: float = 3.0
    max_residual_std: float = 0.4
    audio_var: float = 0.05
    visual_var: float = 0.30
    piecewise_min_segment: float = 5.0
    scale_search: bool = False
    cycle_residual_tol: float = 1.5
    av_desync_max: float = 5.0

    def alphas(self) -> list[float]:
        """The grid lo, lo + step, ... up to half a step beyond hi; 1 alone without a scale search."""
        if not self.scale_search:
            return [1.0]
        lo, hi, step = self.alpha_grid
        return [lo + i * step for i in range(int((hi + step / 2 - lo) / step) + 1) if lo + i * step < hi + step / 2]


# Weights and floors of the quality score, and codec efficiency against H.264 or AAC.
CODEC_EFFICIENCY = {
    "h264": 1.0, "hevc": 2.0, "h265": 2.0, "av1": 2.4, "vp9": 1.8, "mpeg4": 0.7,
    "aac": 1.0, "opus": 1.3, "mp3": 0.7, "vorbis": 1.1, "flac": 1.0, "ac3": 0.8,
}


@dataclass(frozen=True)
class QualityConfig:
    w_dover: float = 0.45
    w_reff: float = 0.35
    w_bpp: float = 0.20
    w_artifact: float = 0.0
    w_bw: float = 0.5
    w_abr: float = 0.3
    w_channels: float = 0.2
    w_clip: float = 0.3
    lam: float = 0.25
    reff_detail_band: tuple[float, float] = (0.25, 0.9)
    reff_detail_ref: float = 0.0015
    terrible_reff_px: float = 92160.0
    terrible_dover: float = 0.10
    terrible_bpp_norm: float = 0.015
    terrible_audio_bw_hz: float = 8000.0
    terrible_clip_ratio: float = 0.02
    terrible_dropout_ratio: float = 0.05
    use_dover: bool = True
    use_vmaf: bool = True


@dataclass(frozen=True)
class DecideConfig:
    eps_full_length: float = 0.05
    contain_tol: float = 0.5
    rule6_quality_margin: float | None = None
    set_cover_pass: bool = False
    audio_variant_keep_both: bool = True


@dataclass(frozen=True)
class ActionConfig:
    quarantine_dir: str = "quarantine"
    quarantine_ttl_days: int = 30


@dataclass(frozen=True)
class Config:
    vision: VisionConfig = field(default_factory=VisionConfig)
    audio: AudioConfig = field(default_factory=AudioConfig)
    candidate: CandidateConfig = field(default_factory=CandidateConfig)
    align: AlignConfig = field(default_factory=AlignConfig)
    quality: QualityConfig = field(default_factory=QualityConfig)
    decide: DecideConfig = field(default_factory=DecideConfig)
    action: ActionConfig = field(default_factory=ActionConfig)

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> Config:
        """Unknown sections and keys are errors, so that a misspelt knob doesn't pass unnoticed."""
        out = cls()
        for name, values in (data or {}).items():
            if name not in {f.name for f in fields(cls)}:
                raise ValueError(f"unknown section {name!r}")
            section = getattr(out, name)
            if unknown := set(values) - {f.name for f in fields(section)}:
                raise ValueError(f"unknown keys in {name}: {sorted(unknown)}")
            out = replace(out, **{name: replace(section, **{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})})
        return out

    def to_dict(self) -> dict[str, Any]:
        return dataclasses.asdict(self)

    @classmethod
    def load(cls, path: str | None = None, overrides: dict[str, Any] | None = None) -> Config:
        """Defaults, then a JSON (or, where a YAML library is installed, YAML) file, then overrides."""
        data: dict[str, Any] = {}
        if path:
            with open(path, encoding="utf-8") as f:
                text = f.read()
            if path.endswith((".yaml", ".yml")):
                try:
                    import yaml
                except ImportError as e:
                    raise RuntimeError("YAML files need the yaml package; JSON files don't") from e
                data = yaml.safe_load(text) or {}
            else:
                data = json.loads(text)
        for name, values in (overrides or {}).items():
            data[name] = {**data.get(name, {}), **values}
        return cls.from_dict(data)

    def dump(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.to_dict(), f, indent=2)


#: Settings for text: times are token positions, so bins, tolerances and spans are in tokens.
TEXT = Config(align=AlignConfig(offset_bin=1.0, inlier_tol=1.75, min_inliers=6, min_span=10.0, max_residual_std=1.5))
