"""Schemas of the catalog's tables, the feature tables and the evidence relation."""

from pyspark.sql.types import StructType


def schema_of(table: str) -> StructType:
    """The schema of a catalog table; needs a session, as Spark itself parses it."""
    return StructType.fromDDL(CATALOG[table][0])


TRACK = "struct<track:int,acodec:string,sample_rate:int,channels:int,audio_bitrate:bigint,lang_tag:string,lang_detected:string>"
FILE = "content_id string, path string, size_bytes bigint, mtime double, probe_json string, ingested_at double"
DUP_PATH = "content_id string, path string"
STREAM_META = "content_id string, declared_w int, declared_h int, declared_fps double, declared_bitrate bigint, vcodec string, pix_fmt string, declared_duration double, active_crop struct<w:int,h:int,x:int,y:int>, vfr boolean"
AUDIO_META = f"content_id string, has_audio boolean, n_tracks int, tracks array<{TRACK}>, default_track int"
QUALITY = "content_id string, q_composite double, q_video double, q_audio double, terrible boolean, terrible_reason string"
MEASURE = "content_id string, r_eff double, technical double, bpp double, bw double"
REVIEW_VERDICT = "a string, b string, verdict string"
MATCH_EDGE = "a string, b string, alpha double, beta double, v_inliers bigint, a_inliers bigint, span_seconds double, residual_std double, modality string, audio_agrees boolean, confidence double, route_review boolean, piecewise boolean"
CLUSTER = "cluster_id string, members array<string>, canonical_span struct<lo:double,hi:double>, solve_residual double, needs_review boolean"
TIMELINE = "content_id string, cluster_id string, a_i double, b_i double, s_canonical double, e_canonical double"
DECISION = "content_id string, cluster_id string, run_id string, action string, dominated_by string"
LANDMARK = "cid string, track int, hash bigint, t double"
DESCRIPTOR = "cid string, t double, vec array<float>, phash bigint"
MATCHED = "a string, b string, ta double, tb double, w double, is_audio boolean"
SEGMENT = "cluster string, pos int, vid string, s double, e double, quality double, terrible boolean, audio_quality double, lang string, codec_rank int, size_bytes bigint"
EDGE = "edge_id bigint, i string, j string, beta double, weight double"

#: Table name: (schema, primary key).
CATALOG = {
    "file": (FILE, ["content_id"]),
    "dup_path": (DUP_PATH, ["content_id", "path"]),
    "stream_meta": (STREAM_META, ["content_id"]),
    "audio_meta": (AUDIO_META, ["content_id"]),
    "quality": (QUALITY, ["content_id"]),
    "measure": (MEASURE, ["content_id"]),
    "match_edge": (MATCH_EDGE, ["a", "b"]),
    "review_verdict": (REVIEW_VERDICT, ["a", "b"]),
    "cluster": (CLUSTER, ["cluster_id"]),
    "timeline": (TIMELINE, ["content_id", "cluster_id"]),
    "decision": (DECISION, ["content_id", "cluster_id", "run_id"]),
}
