"""Core operators: fixed cases, analytic truths, and brute force."""

import itertools
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from overlapse.config import TEXT, AlignConfig, CandidateConfig, Config, DecideConfig
from overlapse.functions import image, scalar, signal
from overlapse.operators import align, decide, graph, landmarks, quality, retrieval, skyline, timeline
from overlapse.schemas import CATALOG, SEGMENT
from overlapse.sources import actions, files, media
from overlapse.sources.catalog import Catalog, FeatureCache


def nearest(vectors, k, least):
    """The k nearest rows of each by brute force, those of other files and similar enough."""
    rows = vectors.select(F.col("cid").alias("b"), F.col("t").alias("tb"), F.col("vec").alias("vb"))
    scored = vectors.select(F.col("cid").alias("a"), F.col("t").alias("ta"), F.col("vec").alias("va")).crossJoin(rows)
    scored = scored.withColumn("sim", F.round(scalar.dot(F.col("va"), F.col("vb")), 9))
    rank = F.row_number().over(Window.partitionBy("a", "ta").orderBy(F.desc("sim"), "b", "tb"))
    return scored.withColumn("rank", rank).filter((F.col("rank") <= k) & (F.col("a") != F.col("b")) & (F.col("sim") >= least))


def seg(cluster, pos, vid, s, e, q=1.0, terrible=False, aq=0.0, lang="", rank=0, size=0):
    return (cluster, pos, vid, float(s), float(e), float(q), terrible, float(aq), lang, rank, size)


def kept(spark, rows, **knobs):
    out = skyline.prune(spark.createDataFrame(rows, SEGMENT), DecideConfig(**knobs)).collect()
    return {r.cluster: {x.vid for x in out if x.cluster == r.cluster and x.action == "keep"} for r in out}


def test_skyline_cases(spark):
    rows = [
        *(seg("clip", *x) for x in [(0, "full", 0, 100, 0.5), (1, "clip", 20, 50, 0.4)]),
        *(seg("chain", *x) for x in [(0, "a", 0, 60, 0.5), (1, "b", 40, 100, 0.5)]),
        *(seg("bad", *x) for x in [(0, "full", 0, 100, 0.9, True), (1, "clip", 20, 50, 0.4)]),
        *(seg("tie", *x) for x in [(0, "x", 0, 10, 0.5, False, 0, "", 2, 10), (1, "y", 0, 10, 0.5, False, 0, "", 4, 10)]),
        *(seg("size", *x) for x in [(0, "x", 0, 10, 0.5, False, 0, "", 2, 10), (1, "y", 0, 10, 0.5, False, 0, "", 2, 9)]),
        *(seg("lang", *x) for x in [(0, "x", 0, 10, 0.5, False, 0, "en"), (1, "y", 0, 10, 0.4, False, 0, "es")]),
    ]
    assert kept(spark, rows) == {"clip": {"full"}, "chain": {"a", "b"}, "bad": {"full", "clip"}, "tie": {"y"}, "size": {"y"}, "lang": {"x", "y"}}
    rule6 = [seg("r", 0, "full", 0, 100, 0.3), seg("r", 1, "clip", 20, 50, 0.9)]
    assert kept(spark, rule6) == {"r": {"full"}} and kept(spark, rule6, rule6_quality_margin=0.2) == {"r": {"full", "clip"}}
    assert kept(spark, [seg("l", 0, "x", 0, 10, 0.5, lang="en"), seg("l", 1, "y", 0, 10, 0.4, lang="es")], audio_variant_keep_both=False) == {"l": {"x"}}
    cover = [seg("c", 0, "a", 0, 60, 0.9), seg("c", 1, "b", 50, 120, 0.9), seg("c", 2, "mid", 30, 90, 0.2)]
    assert kept(spark, cover) == {"c": {"a", "b", "mid"}} and kept(spark, cover, set_cover_pass=True) == {"c": {"a", "b"}}


def test_skyline_never_loses_coverage(spark):
    rng, rows = random.Random(7), []
    for k in range(200):
        for i in range(rng.randint(1, 10)):
            s = rng.uniform(0, 90)
            rows.append(seg(str(k), i, f"v{i}", s, s + rng.uniform(1, 40), rng.random(), rng.random() < 0.4))
    got = kept(spark, rows, contain_tol=0.0)
    for k in range(200):
        own = [r for r in rows if r[0] == str(k)]
        for t in np.linspace(0, 130, 131):
            if any(r[3] <= t <= r[4] for r in own):
                assert any(r[3] <= t <= r[4] for r in own if r[2] in got[str(k)])
    again = kept(spark, [r for r in rows if r[2] in got[r[0]]], contain_tol=0.0)
    assert again == got


def test_skyline_against_brute_force(spark):
    rng, rows, cfg = random.Random(9), [], DecideConfig(rule6_quality_margin=0.2)
    for k in range(60):
        for i in range(rng.randint(1, 8)):
            s = rng.randint(0, 40) / 2
            rows.append(seg(str(k), i, f"v{i}", s, s + rng.randint(1, 40) / 2, rng.randint(0, 5) / 5, rng.random() < 0.3, 0, rng.choice(["", "en", "es"]), rng.randint(0, 2), rng.randint(0, 3)))
    found = {(r.cluster, r.vid): r.dominated_by for r in skyline.prune(spark.createDataFrame(rows, SEGMENT), cfg).collect()}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        lo, hi = min(r[3] for r in own), max(r[4] for r in own)
        full = {r[2]: hi > lo and (min(r[4], hi) - max(r[3], lo)) / (hi - lo) >= 0.95 for r in own}
        rank = {r[2]: (not r[6], full[r[2]], r[5], r[7], r[9], -r[10], r[2]) for r in own}
        for x in own:
            doms = [y[2] for y in own if y[2] != x[2] and y[3] <= x[3] + 0.5 and y[4] >= x[4] - 0.5 and rank[y[2]] >= rank[x[2]] and not (y[8] and x[8] and y[8] != x[8]) and not (y[6] == x[6] and full[y[2]] and not full[x[2]] and x[5] - y[5] > 0.2)]
            assert found[(k, x[2])] == (doms[0] if doms else None)


def test_timeline(spark):
    truth = {"A": 0.0, "B": 10.0, "C": 25.0, "D": -5.0, "E": 0.0}
    pairs = [("A", "B"), ("B", "C"), ("A", "C"), ("A", "D"), ("C", "D")]
    edges = [(k, i, j, truth[i] - truth[j], 1.0) for k, (i, j) in enumerate(pairs)]
    extents = [(n, 0.0, 100.0 if n == "A" else 20.0) for n in truth]
    e = spark.createDataFrame(edges, "edge_id long, i string, j string, beta double, weight double")
    x = spark.createDataFrame(extents, "node string, tmin double, tmax double")
    placed, residuals = timeline.checked_solve(e, x, 1.5)
    rows = {r.node: r for r in placed.collect()}
    assert all(rows[n].offset == pytest.approx(truth[n], abs=1e-6) for n in truth)
    assert {rows[n].cluster for n in "ABCD"} == {"A"} and rows["E"].cluster == "E" and rows["B"].e == pytest.approx(30)
    assert max(abs(r.residual) for r in residuals.collect()) < 1e-6
    false = spark.createDataFrame([*edges, (9, "B", "D", 90.0, 0.01)], e.schema)
    placed, residuals = timeline.checked_solve(false, x, 1.5)
    assert 9 not in {r.edge_id for r in residuals.collect()}
    assert {r.node: round(r.offset, 4) for r in placed.collect()} == {n: truth[n] for n in truth}


def test_timeline_of_large_components(spark):
    """Components beyond the dense solver against elimination: a ring with noise, and a random graph."""
    rng, edges, extents = np.random.default_rng(2), [], []
    truth = rng.uniform(0, 1000, 900)
    links = [(k, (k + 1) % 450) for k in range(450)] + [(450 + int(a), 450 + int(b)) for a, b in rng.integers(0, 450, (1500, 2)) if a != b] + [(450 + k, 451 + k) for k in range(449)]
    for k, (a, b) in enumerate(links):
        edges.append((k, f"n{a:04d}", f"n{b:04d}", float(truth[a] - truth[b] + rng.normal(0, 0.1)), float(rng.uniform(0.1, 5))))
    extents = [(f"n{k:04d}", 0.0, 100.0 if k in (7, 460) else 20.0) for k in range(900)]
    e = spark.createDataFrame(edges, "edge_id long, i string, j string, beta double, weight double")
    placed, residuals = timeline.checked_solve(e, spark.createDataFrame(extents, "node string, tmin double, tmax double"), 9.0)
    rows = {r.node: r for r in placed.collect()}
    assert {n for n, r in rows.items() if r.reference} == {"n0007", "n0460"} and residuals.count() == len(links)
    m, y = np.zeros((len(links) + 2, 900)), np.zeros(len(links) + 2)
    for k, (a, b) in enumerate(links):
        m[k, a], m[k, b], y[k] = 1, -1, edges[k][3]
        m[k] *= np.sqrt(edges[k][4])
        y[k] *= np.sqrt(edges[k][4])
    m[-1, 7] = m[-2, 460] = 1e4
    want = np.linalg.lstsq(m, y, rcond=None)[0]
    assert all(rows[f"n{k:04d}"].offset == pytest.approx(want[k], abs=1e-5) for k in range(900))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 5), (300, 100)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 300: 100, 200: 200}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def matches(rng, pair, offset, alpha, n, noise, lo, hi, audio):
    ta = rng.uniform(lo, hi, n)
    rows = [(pair, "z", float(t), float(alpha * t + offset + rng.normal(0, 0.02)), 1.0, audio) for t in ta]
    return rows + [(pair, "z", float(rng.uniform(lo, hi)), float(rng.uniform(lo, hi)), 1.0, audio) for _ in range(noise)]


def test_offsets_and_verdicts(spark):
    rng = np.random.default_rng(4)
    rows = [
        *matches(rng, "both", 12, 1, 60, 90, 0, 100, True), *matches(rng, "both", 12, 1, 40, 10, 0, 100, False),
        *matches(rng, "redub", 5, 1, 40, 5, 0, 100, False),
        *matches(rng, "audio", -7, 1, 60, 10, 0, 100, True),
        *matches(rng, "desync", 5, 1, 60, 5, 0, 100, False), *matches(rng, "desync", 8, 1, 60, 5, 0, 100, True),
        *matches(rng, "short", 5, 1, 30, 0, 10, 11, True), *matches(rng, "short", 5, 1, 30, 0, 10, 11, False),
        *matches(rng, "two", 0, 1, 40, 0, 0, 50, False), *matches(rng, "two", 30, 1, 30, 0, 60, 100, False),
    ]
    df = spark.createDataFrame(rows, "a string, b string, ta double, tb double, w double, is_audio boolean")
    fits = align.fit_offset(align.channels(df), AlignConfig())
    got = {r.a: r for r in align.verify(fits, AlignConfig()).collect()}
    assert {k: r.modality for k, r in got.items()} == {"both": "both", "redub": "audio_variant", "audio": "audio", "desync": "audio_variant", "short": "reject", "two": "audio_variant"}
    assert got["both"].beta == pytest.approx(12, abs=0.1) and got["both"].alpha == pytest.approx(1, abs=0.01) and got["both"].audio_agrees
    assert got["audio"].route_review and not got["audio"].accept and got["desync"].route_review and got["desync"].reason == "desync"
    assert got["two"].piecewise and not got["both"].piecewise and 0 < got["both"].confidence <= 1
    silent = spark.createDataFrame([("redub", False), ("z", True)], "cid string, has_audio boolean")
    assert {r.a: r.modality for r in align.verify(fits, AlignConfig(), silent).collect()}["redub"] == "visual"


def test_time_scale(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame(matches(rng, "pal", 3, 1.04, 150, 20, 0, 200, True), "a string, b string, ta double, tb double, w double, is_audio boolean")
    fit = align.fit_offset(align.channels(df), AlignConfig(scale_search=True)).filter("channel = 'fused'").collect()[0]
    assert fit.alpha == pytest.approx(1.04, abs=0.01) and fit.beta == pytest.approx(3, abs=0.3)
    assert len(AlignConfig(scale_search=True).alphas()) == 17


def test_retrieval(spark):
    marks = spark.createDataFrame([("a", 1, 0.0), ("a", 1, 5.0), ("b", 1, 1.0), ("b", 2, 2.0), ("c", 2, 3.0), ("c", 9, 4.0)], "cid string, hash long, t double")
    w = retrieval.document_frequency(marks, 3)
    assert {r.hash: round(r.w, 6) for r in w.collect()} == {h: round(np.log(4 / 2) + 1e-3, 6) for h in (1, 2)}
    got = {(r.a, r.b): (r.n, round(r.mass, 5)) for r in retrieval.grouped_collisions(marks, w).collect()}
    one = np.log(2) + 1e-3
    assert got == {("a", "b"): (2, round(2 * one, 5)), ("b", "c"): (1, round(one, 5))}
    assert retrieval.matched(marks, w, spark.createDataFrame([("a", "b")], "a string, b string")).count() == 2
    votes = retrieval.grouped_collisions(marks, w).withColumn("is_audio", F.lit(True))
    assert [(r.a, r.b) for r in retrieval.candidates(votes, CandidateConfig(min_vote_mass=1.0)).collect()] == [("a", "b")]


def test_nearest_and_hamming(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(int(i % 4), int(i), x.astype(float).tolist()) for i, x in enumerate(v)], "cid long, t long, vec array<double>")
    a, b = (sorted((r.a, r.ta, r.b, r.tb) for r in f.collect()) for f in (nearest(df, 5, 0.2), retrieval.blocked_nearest(df, 5, 0.2, block=7)))
    assert a == b and a
    bits = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 30)]
    bits += [b ^ (1 << 63) - (1 << 63) ^ 5 for b in bits[:10]] + [b ^ 1023 for b in bits[:5]]
    h = spark.createDataFrame([(i, 0, b) for i, b in enumerate(bits)], "cid long, t long, phash long")
    want = {(i, j) for i, j in itertools.permutations(range(len(bits)), 2) if ((bits[i] ^ bits[j]) & (1 << 64) - 1).bit_count() <= 10}
    got = [(r.a, r.b) for r in retrieval.near_hashes(h, 10).collect()]
    assert set(got) == want and len(got) == len(want)


def test_quality_gate(spark):
    cols = "width int, height int, bitrate double, fps double, vcodec string, detail double, technical double, artifact double, has_audio boolean, bw double, clip_ratio double, dropout double, channels int, audio_bitrate double, acodec string"
    rows = [(1920, 1080, 5e6, 24.0, "h264", 0.0015, None, 0.0, True, 8000.0, 0.0, 0.0, 2, 192000.0, "aac"), (320, 180, 1e4, 24.0, "h264", 0.0001, None, 0.0, True, 4000.0, 0.1, 0.5, 2, 1e4, "mp3"), (1920, 1080, None, None, None, 0.0015, 0.5, 0.0, False, 0.0, 0.0, 0.0, None, None, None)]
    good, bad, silent = quality.score(spark.createDataFrame(rows, cols), Config().quality).collect()
    assert not good.terrible and good.q_video == pytest.approx(0.45 + 0.35 + 0.2 * min(1, 5e6 / (1920 * 1080 * 24) / 0.15)) and good.q_audio == pytest.approx(1.0)
    assert bad.terrible_reason.split(";") == ["R_eff<92160px(3840)", "dover<0.1", "bpp<0.015", "audio_bw<8000Hz(4000)", "clipping", "dropouts"]
    assert silent.q_audio == 0 and not silent.terrible


def test_scalars(spark):
    row = spark.createDataFrame([("30000/1001", "0/0", "25", None, "UND", "En", "HEVC", r"a\ b\\c.mp4")], "a string, b string, c string, d string, e string, f string, g string, h string")
    r = row.select(scalar.rational(F.col("a")).alias("a"), scalar.rational(F.col("b")).alias("b"), scalar.rational(F.col("c")).alias("c"), scalar.rational(F.col("d")).alias("d"), scalar.language(F.col("e")).alias("e"), scalar.language(F.col("f")).alias("f"), scalar.codec_rank(F.col("g")).alias("g"), scalar.unescape(F.col("h")).alias("h"), scalar.even_indices(F.lit(31), 16).alias("i"), scalar.even_times(F.lit(10.0), 2).alias("t")).head()
    assert r.a == pytest.approx(29.97, abs=0.01) and r.b is None and r.c == 25 and r.d is None and (r.e, r.f, r.g, r.h) == ("", "en", 4, r"a b\c.mp4") and r.i == list(range(0, 31, 2)) and r.t == [2.5, 7.5]
    sizes = spark.range(1).select(*[F.struct(*scalar.fit_resolution(F.lit(w), F.lit(h), n)) for w, h, n in ((1921, 1081, None), (1920, 1080, 288), (100, 51, 288))]).head()
    assert [tuple(x) for x in sizes] == [(1920, 1080), (288, 162), (100, 50)]


def test_landmarks(spark):
    peaks = spark.createDataFrame([("a", float(t), f) for t, f in ((0, 1), (1, 2), (2, 3), (9, 4))], "cid string, t double, f int")
    pairs = {(r.f1, r.f2, r.dt) for r in landmarks.fan_out(peaks, 2, 5.0).collect()}
    assert pairs == {(1, 2, 1.0), (1, 3, 2.0), (2, 3, 1.0)}
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (2, None, "x"), (3, "", "x"), (4, "a b c d", "x")], "doc_id long, text string, hash string")
    assert [(r.cid, r.t) for r in landmarks.shingles(docs).orderBy("t").collect()] == [(1, 0.0), (1, 1.0)]


def test_signal_kernels():
    rng = np.random.default_rng(0)
    sr = 16000
    x = sum(np.sin(2 * np.pi * f * np.arange(sr * 20) / sr + p) * (rng.random(20).repeat(sr) > 0.5) for f, p in zip(rng.uniform(200, 4000, 12), rng.uniform(0, 6, 12))).astype(np.float32)
    x += rng.normal(0, 0.05, len(x)).astype(np.float32)
    h, t = signal.fingerprint(x, sr)
    clip_h, clip_t = signal.fingerprint(x[sr * 2 + 768 : sr * 16], sr)
    at = {}
    for a, b in zip(h, t):
        at.setdefault(a, []).append(b)
    shift = [round((b - a) / 0.128) for k, a in zip(clip_h, clip_t) for b in at.get(k, [])]
    assert len(h) > 50 and max(set(shift), key=shift.count) == round((2 + 768 / sr) / 0.128)
    low = np.convolve(rng.normal(size=sr * 4), np.ones(16) / 16)
    assert signal.bandwidth(low, sr) < signal.bandwidth(rng.normal(size=sr * 4), sr) and signal.bandwidth(x[:100], sr) == 0
    gap = rng.normal(size=sr)
    gap[4000:8000] = 0
    assert signal.dropout_ratio(gap, sr) == pytest.approx(0.25, abs=0.03) and signal.clip_ratio(np.array([1, 1, 0.5, 0.1])) == 0.5
    assert len(signal.fingerprint(x[:1000], sr)[0]) == 0


def test_image_kernels():
    rng = np.random.default_rng(0)
    smooth = image.resize(rng.integers(0, 255, (3, 8, 8)), 96, 128)
    frames = np.clip(smooth, 0, 255).astype(np.uint8)
    hashes = image.perceptual_hash(frames)
    noisy = np.clip(frames + rng.normal(0, 6, frames.shape), 0, 255).astype(np.uint8)
    apart = [(int(a) ^ int(b)) & (1 << 64) - 1 for a, b in zip(hashes, image.perceptual_hash(noisy))]
    assert all(x.bit_count() < 12 for x in apart) and ((int(hashes[0]) ^ int(hashes[1])) & (1 << 64) - 1).bit_count() > 12
    assert image.entropy(np.zeros((1, 4, 4), np.uint8))[0] == 0 and image.entropy(np.arange(256, dtype=np.uint8).reshape(1, 16, 16))[0] == pytest.approx(8)
    boxed = np.zeros((2, 100, 60), np.uint8)
    boxed[:, 20:80] = 200
    assert image.active_crop(boxed) == (60, 60, 0, 20) and image.active_crop(boxed * 0) is None and image.active_crop(boxed[:, 20:80]) is None
    assert image.detail(noisy) > image.detail(frames) and image.banding(boxed) > 0.9
    blocks = np.kron(rng.integers(0, 255, (1, 8, 8)), np.ones((8, 8))).astype(np.uint8)
    assert image.blockiness(blocks) > image.blockiness(frames)
    assert image.content_id(frames) == image.content_id(frames.copy()) != image.content_id(noisy) and len(image.content_id(frames)) == 32


def test_media_tables(spark):
    rng = np.random.default_rng(3)
    rows = [("f", float(t), 32, 32, rng.integers(0, 255, (32, 32)).astype(np.uint8).tobytes()) for t in range(3)]
    frames = spark.createDataFrame(rows, media.FRAMES)
    assert media.frame_features(frames, Config()).filter("informative").count() == 3 and media.picture_measures(frames, Config()).count() == 1
    audio = spark.createDataFrame([("f", 0, 16000, rng.normal(size=32000).astype("<f4").tobytes())], media.AUDIO)
    assert media.audio_measures(audio).head().bw > 6000 and media.audio_landmarks(audio, Config()).count() >= 0
    assert media.detected_languages(audio, lambda x, sr: "en").head().lang == "en" and media.detected_languages(audio, None).head().lang is None
    assert media.filter_graph(2, 10, 20, (1, 2, 3, 4)) == "setpts=PTS-STARTPTS,crop=1:2:3:4,fps=2,scale=10:20,format=gray"


def test_probe(spark):
    probe = {"streams": [{"codec_type": "video", "codec_name": "png", "disposition": {"attached_pic": 1}}, {"codec_type": "video", "codec_name": "h264", "width": 1920, "height": 1080, "avg_frame_rate": "24/1", "r_frame_rate": "30/1", "duration": "9"}, {"codec_type": "audio", "codec_name": "aac", "channels": 2, "sample_rate": "48000"}, {"codec_type": "audio", "codec_name": "ac3", "disposition": {"default": 1}, "tags": {"language": "eng"}}], "format": {"duration": "N/A", "bit_rate": "100"}}
    rows = spark.createDataFrame([(json.dumps(probe),), ("{}",), (None,)], "probe_json string")
    a, b, c = files.parse_probe(rows).collect()
    assert (a.declared_w, a.vcodec, a.vfr, a.declared_duration, a.n_tracks, a.default_track, a.declared_bitrate) == (1920, "h264", True, 9.0, 2, 1, 100)
    assert a.tracks[0].sample_rate == 48000 and a.tracks[1].lang_tag == "eng" and b.has_audio is False and c.n_tracks in (0, -1)


def test_ground_truth_and_evaluation(spark):
    text = spark.createDataFrame([("/x/a\\ one.mp4\n/x/b\\ two.mp4\n\nc.mp4\nd.mp4\n",)], "value string")
    assert {(r.left, r.right) for r in files.ground_truth(text).collect()} == {("a one.mp4", "b two.mp4"), ("c.mp4", "d.mp4")}
    fs = spark.createDataFrame([("1", "/p/a"), ("2", "/p/b"), ("3", "/p/c")], "content_id string, path string")
    dup = spark.createDataFrame([("1", "/p/a2")], "content_id string, path string")
    members = spark.createDataFrame([("k", "1"), ("k", "2"), ("m", "3")], "cluster string, node string")
    pairs = spark.createDataFrame([("a", "a2"), ("a", "b"), ("a", "c"), ("a", "nope")], "left string, right string")
    got = decide.evaluate(pairs, fs, dup, members)
    assert {r.right: r.outcome for r in got.collect()} == {"a2": "exact-content-dup", "b": "same-cluster", "c": "missed", "nope": "missing"}
    assert decide.recall(got).head().recall == pytest.approx(2 / 3)


def test_catalog_and_cache(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/cat")
    row = lambda cid, path: (cid, path, 1, 0.0, "{}", 0.0)
    schema = c.read("file").schema
    assert not c.exists("file") and c.read("file").count() == 0
    c.upsert("file", spark.createDataFrame([row("1", "a"), row("2", "b")], schema))
    c.upsert("file", spark.createDataFrame([row("2", "c")], schema))
    assert {(r.content_id, r.path) for r in c.read("file").collect()} == {("1", "a"), ("2", "c")}
    dup = c.read("dup_path").schema
    for _ in range(2):
        c.insert_absent("dup_path", spark.createDataFrame([("1", "z"), ("1", "z")], dup))
    assert c.read("dup_path").count() == 1
    cache = FeatureCache(spark, f"file://{tmp_path}/feat")
    marks = spark.createDataFrame([("ab", 0, 1, 0.0)], "cid string, track int, hash long, t double")
    cache.save("audio", marks)
    wanted = spark.createDataFrame([("ab",), ("cd",)], "cid string")
    assert [r.cid for r in cache.missing("audio", wanted, marks.schema).collect()] == ["cd"]


def test_scan_stream_and_actions(spark, tmp_path):
    from overlapse.streaming.ingest import ingest_stream

    src = tmp_path / "lib"
    (src / "sub").mkdir(parents=True)
    for name, data in (("b.MP4", b"one"), ("sub/a.mkv", b"one"), ("c.mp4", b"two"), ("no.txt", b"x")):
        (src / name).write_bytes(data)
    found = files.scan(spark, str(src))
    assert found.count() == 3

    def identify(batch):
        return batch.withColumns({"content_id": F.col("size_bytes").cast("string"), "probe_json": F.lit("{}"), "ingested_at": F.lit(0.0)})

    for _ in range(2):
        q = ingest_stream(spark, files.scan(spark, str(src), streaming=True), f"file://{tmp_path}/cat", f"{tmp_path}/ck", identify)
        q.awaitTermination(60)
    c = Catalog(spark, f"file://{tmp_path}/cat")
    assert c.read("file").count() == 1 and c.read("dup_path").count() == 2
    plan = decide.prune_plan(spark.createDataFrame([], "content_id string, action string, dominated_by string"), c.read("file"), c.read("dup_path"))
    plan = plan.withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    folder = str(tmp_path / "q")
    assert len(actions.apply_plan(plan, folder)) == 2 and (src / "c.mp4").exists()
    actions.apply_plan(plan, folder, dry_run=False, created_at=0.0)
    assert sum(1 for _ in src.rglob("*.m*")) + sum(1 for _ in src.rglob("*.M*")) == 1
    assert actions.restore(folder) == 2 and (src / "c.mp4").exists()
    actions.apply_plan(plan, folder, dry_run=False, created_at=0.0)
    assert actions.purge(folder, 30, now=86400.0) == 0 and actions.purge(folder, 30, now=86400.0 * 31) == 2


def test_engine(spark, tmp_path):
    """A clip, a full item and a stranger, from primitives to decisions."""
    from overlapse.plans import engine

    rng = np.random.default_rng(8)
    hashes = rng.integers(1, 1 << 30, 120)
    marks = [("full", 0, int(h), float(t)) for t, h in enumerate(hashes)] + [("clip", 0, int(h), float(t)) for t, h in enumerate(hashes[40:100])]
    marks += [("other", 0, int(h), float(t)) for t, h in enumerate(rng.integers(1 << 30, 1 << 31, 80))]
    v = rng.normal(size=(120, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    desc = [("full", float(t), x.tolist(), 0) for t, x in enumerate(v)] + [("clip", float(t), x.tolist(), 0) for t, x in enumerate(v[40:100])]
    sch = {k: s for k, (s, _) in CATALOG.items()}
    ids = ["full", "clip", "other"]
    p = engine.Primitives(
        files=spark.createDataFrame([(i, f"/{i}", 100, 0.0, "{}", 0.0) for i in ids], sch["file"]),
        stream_meta=spark.createDataFrame([(i, 10, 10, 1.0, 1, "h264", "", d, None, False) for i, d in zip(ids, (120.0, 60.0, 80.0))], sch["stream_meta"]),
        audio_meta=spark.createDataFrame([(i, True, 0, [], 0) for i in ids], sch["audio_meta"]),
        quality=spark.createDataFrame([(i, 0.5, 0.5, 0.1, False, "") for i in ids], sch["quality"]),
        landmarks=spark.createDataFrame(marks, "cid string, track int, hash long, t double"),
        descriptors=spark.createDataFrame(desc, "cid string, t double, vec array<double>, phash long"),
    )
    out = engine.run(p, Config())
    assert {r.vid: (r.action, r.dominated_by) for r in out.decisions.collect()} == {"full": ("keep", None), "clip": ("prune", "full"), "other": ("keep", None)}
    assert [r.modality for r in out.verdicts.collect()] == ["both"]
    assert {r.node: round(r.s) for r in out.placed.collect()} == {"full": 0, "clip": 40, "other": 0}
    engine.persist(spark, f"file://{tmp_path}/cat", out, "r1", 1.5)
    c = Catalog(spark, f"file://{tmp_path}/cat")
    assert c.read("decision").count() == 3 and c.read("cluster").count() == 2
    rows = actions.report_rows(out.decisions, p.files)
    assert list(actions.text_report(rows)) == ["clip: 2 items, 2 min, 1 to drop"]
    assert {r.cid for r in engine.active_files(p.landmarks, p.descriptors, p.files, Config()).collect()} == {"full", "clip"}


def library_of_clips(spark, folder):
    """Files below ``folder``/lib and their decoded tables: a title, a copy, a clip, a silent clip, a redub, a stranger, a black one."""
    from overlapse.functions.image import resize

    rng, sr = np.random.default_rng(12), 16000

    def film(seconds):
        coarse = rng.integers(0, 255, (seconds, 6, 8))
        return np.clip(resize(coarse, 48, 64), 0, 255).astype(np.uint8)

    def sound(seconds):
        notes = rng.uniform(200, 4000, (seconds * 4, 3))
        t = np.arange(sr // 4) / sr
        return np.concatenate([np.sin(2 * np.pi * f[:, None] * t).sum(axis=0) for f in notes]).astype("<f4") + rng.normal(0, 0.02, seconds * sr).astype("<f4")

    noisy = lambda x: np.clip(x + rng.normal(0, 3, x.shape), 0, 255).astype(np.uint8)
    a, a_sound, b, b_sound = film(40), sound(40), film(40), sound(40)
    items = {
        "a_full": (a, a_sound, 1280, "eng"), "a_copy": (a, a_sound, 1280, "eng"), "a_clip": (noisy(a[10:30]), a_sound[10 * sr : 30 * sr], 640, "eng"), "a_silent": (noisy(a[5:25]), None, 640, None),
        "a_redub": (noisy(a), sound(40), 960, "spa"), "b_full": (b, b_sound, 1280, None), "black": (np.zeros((20, 48, 64), np.uint8), None, 1280, None),
    }
    (folder / "lib").mkdir()
    probes, frames, audio = [], [], []
    for name, (pictures, x, width, lang) in items.items():
        (folder / "lib" / f"{name}.mp4").write_bytes(name.encode())
        path = f"file:{folder}/lib/{name}.mp4"
        streams = [{"codec_type": "video", "codec_name": "h264", "width": width, "height": width * 3 // 4, "avg_frame_rate": "24/1", "r_frame_rate": "24/1", "bit_rate": str(width * 3000)}]
        streams += [{"codec_type": "audio", "codec_name": "aac", "channels": 2, "bit_rate": "128000", "tags": {"language": lang} if lang else {}}] if x is not None else []
        probes.append((path, json.dumps({"streams": streams, "format": {"duration": str(float(len(pictures)))}})))
        frames += [(path, float(k), 48, 64, p.tobytes()) for k, p in enumerate(pictures)]
        audio += [(path, 0, sr, x.tobytes())] if x is not None else []
    (folder / "lib" / "broken.mp4").write_bytes(b"?")
    for name, rows, kind in (("probes", probes, "path string, probe_json string"), ("frames", frames, "path string, t double, height int, width int, data binary"), ("audio", audio, "path string, track int, sr int, data binary")):
        spark.createDataFrame(rows, kind).write.parquet(f"file://{folder}/decoded/{name}")


def test_scan_to_decisions(spark, tmp_path, capsys):
    """The command line, from files to decisions; a second run finds nothing to do and decides alike."""
    from overlapse.__main__ import main

    library_of_clips(spark, tmp_path)
    common = ["--catalog", f"file://{tmp_path}/cat", "--decoded", f"file://{tmp_path}/decoded", "--set", "quality.terrible_audio_bw_hz=1000", "--set", "audio.flux_pct=25"]
    assert main([*common, "scan", str(tmp_path / "lib"), "--html", str(tmp_path / "r.html")], spark) == 0
    out = capsys.readouterr().out
    assert "duplicate: 1" in out and "error: 1" in out and "new: 6" in out
    c = Catalog(spark, f"file://{tmp_path}/cat/catalog")
    name = {r.content_id: r.path.rsplit("/", 1)[1].split(".")[0] for r in c.read("file").collect()}
    got = {name[r.content_id]: (r.action, name.get(r.dominated_by)) for r in c.read("decision").collect()}
    full = "a_copy"  # the first path of its content
    assert set(name.values()) == {full, "a_clip", "a_silent", "a_redub", "b_full", "black"}
    assert got == {full: ("keep", None), "a_clip": ("prune", full), "a_silent": ("prune", full), "a_redub": ("keep", None), "b_full": ("keep", None), "black": ("keep", None)}
    modality = {tuple(sorted((name[r.a], name[r.b]))): r.modality for r in c.read("match_edge").collect()}
    assert modality[("a_clip", full)] == "both" and modality[tuple(sorted(("a_redub", full)))] == "audio_variant" and modality[tuple(sorted(("a_silent", full)))] == "visual"
    start = {name[r.content_id]: r.s_canonical for r in c.read("timeline").collect()}
    assert start["a_clip"] - start[full] == pytest.approx(10, abs=0.3) and start["a_silent"] - start[full] == pytest.approx(5, abs=0.6)
    first = sorted(map(str, c.read("match_edge").collect()))
    assert main([*common, "scan", str(tmp_path / "lib")], spark) == 0
    assert "known: 7" in capsys.readouterr().out and sorted(map(str, c.read("match_edge").collect())) == first
    (tmp_path / "pairs.txt").write_text("a_full.mp4\na_clip.mp4\n\na_full.mp4\nb_full.mp4\n")
    main([*common, "eval", f"file://{tmp_path}/pairs.txt"], spark)
    assert "1 of 2 pairs found" in capsys.readouterr().out
    main([*common, "calibrate", "--write", str(tmp_path / "floors.json")], spark)
    assert Config.load(str(tmp_path / "floors.json")).quality.terrible_reff_px > 0
    from overlapse.plans.ingest import decodable
    from overlapse.__main__ import library

    lib = library(spark, f"file://{tmp_path}/cat", f"file://{tmp_path}/decoded", Config())
    gone = decodable(lib).filter("path like '%b_full%'")
    lib.features.remove("dense", gone)
    lib.features.remove("audio", gone)
    left = lib.features.load("audio", spark.createDataFrame([], "cid string").schema)
    assert left.count() and not left.join(gone, "cid", "left_semi").count()


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    rows = [("f", float(t), 6, 4, rng.integers(0, 255, (6, 4, 3)).astype(np.uint8).tobytes()) for t in range(40)] + [("g", 0.0, 6, 4, bytes(24))]
    frames = spark.createDataFrame(rows, media.FRAMES)
    cfg = Config.load(overrides={"vision": {"embed_size": 8, "flip_augment": True}})

    def embed(x):
        assert len(x) <= 32 and x.shape[1:] == (3, 8, 8) and x.dtype == np.float32
        return x.reshape(len(x), -1)

    got = media.embeddings(frames, embed, cfg).collect()
    assert len(got) == 82 and all(np.linalg.norm(r.vec) == pytest.approx(1, abs=1e-5) for r in got)
    black = np.repeat([-m / s for m, s in zip(media.CHANNEL_MEAN, media.CHANNEL_STD)], 64)
    assert np.allclose(next(r.vec for r in got if r.cid == "g"), black / np.linalg.norm(black), atol=1e-5)
    assert media.descriptors(frames, cfg, embed, every=True).count() == 82


def test_catalog_rows_and_versions(spark, tmp_path):
    """Two new rows of a key leave one; readers of an older version still read it."""
    c = Catalog(spark, f"file://{tmp_path}/cat")
    schema = c.read("file").schema
    c.upsert("file", spark.createDataFrame([("1", "b", 1, 0.0, "{}", 0.0), ("1", "a", 1, 0.0, "{}", 0.0)], schema))
    before = c.read("file")
    c.upsert("file", spark.createDataFrame([("1", "c", 1, 0.0, "{}", 0.0)], schema))
    assert [r.path for r in before.collect()] == ["a"] and [r.path for r in c.read("file").collect()] == ["c"]


def test_config(tmp_path):
    c = Config.load(overrides={"align": {"inlier_tol": 2.0}})
    c.dump(str(tmp_path / "c.json"))
    assert Config.load(str(tmp_path / "c.json")) == c and c.align.inlier_tol == 2.0
    with pytest.raises(ValueError):
        Config.from_dict({"align": {"nope": 1}})


def test_entry_imports_without_llm(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def block(name, *a, **k):
        if name.startswith(("overlapse.llm", "corpus_pipeline")) or (name == "overlapse" and a[2:3] and "llm" in (a[2] or ())):
            raise ModuleNotFoundError(name, name=name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", block)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert "candidate_pairs" in entry.queries() and not any(k.startswith("op") for k in entry.queries())
    sys.modules.pop("__spark_entry__", None)


def test_entry_shows_other_import_errors(monkeypatch):
    """Only the absence of the subpackage or its pipeline is let pass."""
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def block(name, *a, **k):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("numpy", name="numpy")
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", block)
    sys.modules.pop("__spark_entry__", None)
    with pytest.raises(ModuleNotFoundError):
        importlib.import_module("__spark_entry__")
    sys.modules.pop("__spark_entry__", None)


def test_heavy_hashes_are_dealt_over_parts(spark, monkeypatch):
    """A hash that most files hold gives the same counts, in parts."""
    rows = [(f"f{i:03d}", h, float(h)) for i in range(60) for h in ([7, 7, 8] if i % 2 else [7, i])]
    marks = spark.createDataFrame(rows, "cid string, hash long, t double")
    weights = retrieval.document_frequency(marks, 60)
    want = {(r.a, r.b): (r.n, round(r.mass, 9)) for r in retrieval.grouped_collisions(marks, weights).collect()}
    monkeypatch.setattr(retrieval, "FILES_A_PART", 7)
    assert retrieval.salted(marks.join(weights, "hash")).filter("hash = 7").select("part").distinct().count() > 4
    assert {(r.a, r.b): (r.n, round(r.mass, 9)) for r in retrieval.grouped_collisions(marks, weights).collect()} == want and len(want) == 60 * 59 // 2


def test_fits_of_lists_equal_fits_of_rows(spark):
    """Fits on arrays give those of aggregates; matches are neither exploded nor sorted."""
    from overlapse import queries as Q
    from overlapse.operators.fits import fit_pairs

    rng = np.random.default_rng(9)
    rows = [x for i in range(12) for x in matches(rng, f"p{i}", i, 1, 20 + i, 15, 0, 100, i % 3 > 0) + matches(rng, f"p{i}", i // 2 * 7, 1, 18, 5, 0, 60, i % 2 > 0)]
    df = spark.createDataFrame([(*r[:4], float(rng.uniform(0.5, 2)), r[5]) for r in rows], "a string, b string, ta double, tb double, w double, is_audio boolean")
    for cfg in (AlignConfig(), AlignConfig(scale_search=True)):
        cols = ["alpha", "beta", "mass", "n", "v", "a_n", "span", "rstd", "piecewise"]
        want, got = ({(r.a, r.b, r.channel): [r[c] for c in cols] for r in f.collect()} for f in (align.fit_offset(align.channels(df), cfg), fit_pairs(df, cfg)))
        assert set(want) == set(got) and any(x[-1] for x in want.values())
        for k in want:
            assert got[k] == pytest.approx(want[k], abs=1e-9), k
    plan = Q.queries()["time_scales"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Generate", "Window", "Sort"))


def test_meeting_in_blocks_equals_joins(spark, monkeypatch):
    """Counts, candidates and fits of files that meet in many small blocks, against joins and aggregates of all matches."""
    from overlapse.operators import meeting

    rng = np.random.default_rng(12)
    rows = [(int(c), int(h), float(t), bool(h % 4 > 0)) for c in range(40) for t, h in enumerate(rng.integers(0, 30, 14))]
    rows += [(c, 100 + i, float(i + c), i % 2 > 0) for c in (50, 51, 52) for i in range(30)]
    marks = spark.createDataFrame(rows, "cid long, hash long, t double, is_audio boolean")
    files = lambda x: F.sort_array(F.collect_list(F.struct("cid", x.alias("x")))).alias("files")
    lists = marks.groupBy("hash", "is_audio").agg(files(F.col("t")), (F.col("hash") % 3 + 0.5).alias("w")).withColumn("hashes", F.lit(1).cast("long"))
    counts = marks.groupBy("hash", "is_audio", "cid").agg(F.count("*").cast("double").alias("k")).groupBy("hash", "is_audio").agg(files(F.col("k")), (F.col("hash") % 3 + 0.5).alias("w")).withColumn("hashes", F.lit(1).cast("long"))
    x, y = (marks.select(F.col("cid").alias(c), "hash", "is_audio", F.col("t").alias(t)) for c, t in (("a", "ta"), ("b", "tb")))
    met = x.join(y, ["hash", "is_audio"]).filter("a < b").withColumn("w", F.col("hash") % 3 + 0.5)
    votes = met.groupBy("a", "b", "is_audio").agg(F.count("*").alias("n"), F.sum("w").alias("mass"))
    monkeypatch.setattr(meeting, "COLLISIONS_A_TASK", 300)
    dealt = meeting.deal(lists)
    assert dealt.select("task").distinct().count() > 20
    got = {(r.a, r.b, r.is_audio): (r.n, r.mass) for r in meeting.counted(meeting.deal(counts)).collect()}
    assert got == {(r.a, r.b, r.is_audio): (r.n, r.mass) for r in votes.collect()}
    cfg = CandidateConfig(min_vote_mass=12.0, min_shared_audio_hashes=12)
    want = retrieval.candidates(votes, cfg)
    pairs = {(r.a, r.b): (r.n_audio, r.n_visual, round(r.mass, 6)) for r in want.collect()}
    assert 3 <= len(pairs) < votes.select("a", "b").distinct().count()
    assert {(r.a, r.b): (r.n_audio, r.n_visual, round(r.mass, 6)) for r in meeting.candidates(meeting.deal(counts), cfg).collect()} == pairs
    cols = ["alpha", "beta", "mass", "n", "v", "a_n", "span", "rstd", "piecewise"]
    fits = align.fit_offset(align.channels(met.join(want.select("a", "b"), ["a", "b"], "left_semi")), AlignConfig())
    fits, found = ({(r.a, r.b, r.channel): [r[c] for c in cols] for r in f.collect()} for f in (fits, meeting.fitted(dealt, cfg, AlignConfig())))
    assert set(fits) == set(found) and all(found[k] == pytest.approx(fits[k], abs=1e-6) for k in fits)
    # parts of few matches hold whole pairs
    table = meeting.deal(lists).limit(60).toArrow()
    whole = sorted(zip(*(x.tolist() for x in next(iter(meeting._collisions(table)))[1:])))
    monkeypatch.setattr(meeting, "MATCHES_AT_ONCE", 5)
    parts = [list(zip(*(x.tolist() for x in p[1:]))) for p in meeting._collisions(table)]
    assert len(parts) > 5 and sorted(sum(parts, [])) == whole
    of = [{r[:2] for r in p} for p in parts]
    assert sum(map(len, of)) == len(set().union(*of))


def test_gathered_pairs_equal_joins(spark, monkeypatch):
    """Verdicts of hashes that meet in lists, near ones included, against joins and aggregates of all evidence."""
    from overlapse.operators import meeting
    from overlapse.plans import engine

    rng = np.random.default_rng(14)
    ids = [f"f{i:02d}" for i in range(30)] + ["x", "y"]
    film = rng.integers(1, 1 << 62, (3, 60))
    marks, frames = [], []
    for i, cid in enumerate(ids):
        # clips of three films, some frames a bit off, some seconds twice, some without sound
        start, length = int(rng.integers(0, 40)), int(rng.integers(8, 20))
        for k, t in enumerate(range(start, start + length)):
            h = int(film[i % 3][t])
            frames.append((cid, float(k), [], h ^ (1 << int(rng.integers(0, 60))) if rng.random() < 0.4 else h))
            if i % 5:
                marks.append((cid, 0, h % (1 << 40), float(k)))
        frames += [(cid, 40.0, [], 5), (cid, 41.0, [], None)]
        marks += [(cid, 0, 77, 50.0)] * (1 + i % 2)
    # frames of x that many files are near to, those of y to x alone: the pair is a candidate from y, not from x
    for k, h in enumerate(rng.integers(1, 1 << 62, 10)):
        frames += [(cid, 60.0 + k, [], int(h) ^ flip) for cid, flip in [("x", 0), ("y", 3), *[(f"f0{j}", 3 << 2 * j) for j in range(1, 7)]]]
    sch = {k: s for k, (s, _) in CATALOG.items()}
    p = engine.Primitives(
        files=spark.createDataFrame([(i, f"/{i}", 100, 0.0, "{}", 0.0) for i in ids], sch["file"]), stream_meta=None, quality=None,
        audio_meta=spark.createDataFrame([(i, k % 5 > 0, 0, [], 0) for k, i in enumerate(ids)], sch["audio_meta"]),
        landmarks=spark.createDataFrame(marks, "cid string, track int, hash long, t double"),
        descriptors=spark.createDataFrame(frames, "cid string, t double, vec array<double>, phash long"),
    )
    cfg = Config.load(overrides={"candidate": {"hamming_max": 2, "min_vote_mass": 13.0, "min_shared_audio_hashes": 10}, "align": {"min_span": 2.0}})
    flags = p.audio_meta.select(F.col("content_id").alias("cid"), "has_audio")
    want = {(r.a, r.b): r for r in align.verify(engine.vector_fits(p, cfg, len(ids)), cfg.align, flags).collect()}
    assert {r.modality for r in want.values()} >= {"both", "visual"} and len(want) > 30 and ("y", "x") in want
    # several rounds and tasks, over which most files are spread
    monkeypatch.setattr(meeting, "MARKS_A_ROUND", 700)
    monkeypatch.setattr(meeting, "MARKS_A_TASK", 20)
    got = {(r.a, r.b): r for r in engine.match(p, cfg).collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        for c, x in r.asDict().items():
            assert got[k][c] == (pytest.approx(x, abs=1e-9) if isinstance(x, float) else x), (k, c)


def test_tables_of_decisions_go_and_rounds_change_nothing(spark, monkeypatch, tmp_path):
    """Decisions alone leave one written table; of many marks, nodes and edges a part is handled at a time."""
    from overlapse import queries as Q
    from overlapse.operators import meeting
    from overlapse.workspace import scratch_dir

    for name, rows, columns in (("customer", [(i,) for i in range(8)], "c_custkey long"), ("supplier", [(i,) for i in range(3)], "s_suppkey long"), ("orders", [(i, i * 7 % 9) for i in range(40)], "o_orderkey long, o_custkey long")):
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    want = {(f"c{i}", f"c{i}", 0.0, 60.0, "keep", "") for i in range(8)} | {(f"s{i}", f"s{i}", 0.0, 60.0, "keep", "") for i in range(3)}
    want |= {(f"c{i * 7 % 9}", f"o{i}", i % 30.0, i % 30.0 + i % 15 + 12, "prune", f"c{i * 7 % 9}") for i in range(40) if i * 7 % 9 < 8}
    for module, name, value in ((meeting, "LEAST_MARKS", 300), (meeting, "ROUNDS", 2), (meeting, "PARTS", 2), (timeline, "NODES_A_ROUND", 20), (timeline, "EDGES_APART", 10)):
        monkeypatch.setattr(module, name, value)
    asked, write = [], timeline.materialise
    monkeypatch.setattr(timeline, "materialise", lambda df, name, *more: asked.append(name) or write(df, name, *more))
    root = scratch_dir(spark).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    got = Q.queries()["run_decisions"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert asked.count("timeline") == asked.count("cluster-edges") == 2
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before] == ["decisions"]
    monkeypatch.setattr(meeting, "LEAST_MARKS", 5000)
    assert [meeting._pieces(n, 100_000, 4) for n in (0, 4999, 16_000, 90_000, 1_600_000)] == [1, 1, 3, 4, 16]


def test_a_table_built_on_itself_goes(spark):
    """A union of one table is that table: ``remove`` deletes it and ends, as in ``run_decisions`` on few marks."""
    from overlapse import queries as Q
    from overlapse.workspace import built_on, materialise, remove

    one = materialise(spark.range(3).toDF("x"), "one")
    path = one.scratch_path.removeprefix("file://")
    every = built_on(one, [one])
    assert os.path.isdir(path) and every.count() == 3
    remove(every)
    assert not os.path.exists(path)
    # one round, in which no file strays
    assert Q.queries()["run_decisions"](spark, "/root/testdata/sf0.001").count() > 0


def _shared_by_joins(spark, docs, n):
    """Votes of the shingles and lines of ``docs`` (doc_id, text) by plain joins."""
    out = []
    for marks, is_audio in ((landmarks.shingles(docs), True), (landmarks.line_landmarks(docs), False)):
        w = retrieval.document_frequency(marks, n)
        out.append(retrieval.grouped_collisions(marks, w).withColumn("is_audio", F.lit(is_audio)))
    return out[0].unionByName(out[1])


def test_crossed_blocks_equal_joins(spark, monkeypatch):
    from overlapse.operators import crossing

    r = random.Random(3)
    phrases = [" ".join(r.choices("abcdefgh", k=r.randint(1, 9))) for _ in range(25)]
    rows = [(r.randrange(45), "".join(p + r.choice([" ", "\n", "\t ", "\x0b", "\r\n", "  "]) for p in r.choices(phrases, k=r.randint(0, 8)))) for _ in range(70)]
    rows += [(None, rows[0][1]), (900, None), (901, ""), (902, rows[1][1] * 3), (903, "é ü ñ ß ø\n"), (904, "é ü ñ ß ø")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n = len(rows)
    joined = _shared_by_joins(spark, docs.filter("doc_id is not null"), n)
    want = {(x.a, x.b, x.is_audio): (x.n, round(x.mass, 6)) for x in joined.collect()}
    assert {k[2] for k in want} == {True, False} and len(want) > 100
    monkeypatch.setattr(crossing, "MARKS_A_PART", 150)
    monkeypatch.setattr(crossing, "FILES_A_BLOCK", 9)
    blocked = crossing.blocks(crossing.shared_lists(docs.select(F.col("doc_id").alias("cid"), "text")), n, 1.0)
    assert blocked.count() > 5
    got = crossing.votes(blocked)
    found = got.collect()
    assert len(found) == len(want) and {(x.a, x.b, x.is_audio): (x.n, round(x.mass, 6)) for x in found} == want
    # no row is shuffled for a pair
    assert "CartesianProduct" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Exchange" not in plan
    cfg = CandidateConfig(min_vote_mass=9.0)
    pairs = {(x.a, x.b): (x.n_audio, x.n_visual, round(x.mass, 6)) for x in retrieval.candidates(joined, cfg).collect()}
    assert 3 < len(pairs) and {(x.a, x.b): (x.n_audio, x.n_visual, round(x.mass, 6)) for x in crossing.candidates(blocked, cfg).collect()} == pairs
    ends = [x for p in retrieval.blocking_pairs(joined, cfg).collect() for x in p]
    nodes = [x.node for x in crossing.blocking_nodes(blocked, cfg).collect()]
    assert len(nodes) == len(set(nodes)) and set(nodes) == set(ends)

    def pairs_of(block):
        return sorted((a, b, *n, *(round(x, 6) for x in m)) for part in crossing._met(block, block, True) for a, b, n, m in zip(*(x.tolist() for x in part)))

    one = blocked.first()
    block = crossing._unpacked(one.marks, bytes(one.packed))
    whole = pairs_of(block)
    monkeypatch.setattr(crossing, "FILES_AT_ONCE", 2)
    monkeypatch.setattr(crossing, "COLLISIONS_AT_ONCE", 3)
    assert len(whole) > 5 and pairs_of(block) == whole


def test_fits_of_crossed_blocks_equal_joins(spark, monkeypatch):
    """Fits of documents where blocks of timed marks meet, against aggregates of all evidence; no row is shuffled for a pair."""
    from overlapse import queries as Q
    from overlapse.operators import crossing

    r = random.Random(4)
    phrases = [" ".join(r.choices("abcdefghijkl", k=r.randint(3, 9))) for _ in range(20)]
    rows = [(i, "".join(p + r.choice([" ", "\n", "\t ", "\x0b", "\r\n", "  "]) for p in r.choices(phrases, k=r.randint(0, 14)))) for i in range(45)]
    rows += [(None, rows[0][1]), (900, None), (901, ""), (902, rows[1][1] * 3), (903, rows[2][1]), (904, "é ü ñ ß ø\n" * 7), (905, "x y\n" + "é ü ñ ß ø\n" * 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n, known, cfg = len(rows), docs.filter("doc_id is not null"), CandidateConfig(min_vote_mass=9.0)
    pairs = retrieval.candidates(_shared_by_joins(spark, known, n), cfg).select("a", "b").localCheckpoint()
    both = ((landmarks.shingles(known), True), (landmarks.line_landmarks(known), False))
    met = [retrieval.matched(m, retrieval.document_frequency(m, n), pairs, is_audio) for m, is_audio in both]
    cols = ["alpha", "beta", "mass", "n", "v", "a_n", "span", "rstd", "piecewise"]
    monkeypatch.setattr(crossing, "MARKS_A_PART", 150)
    monkeypatch.setattr(crossing, "FITTED_FILES", 9)
    blocked = crossing.timed_blocks(docs.select(F.col("doc_id").alias("cid"), "text"), n)
    assert blocked.count() > 4
    fits = align.fit_offset(align.channels(met[0].unionByName(met[1])), TEXT.align), crossing.fitted(blocked, n, cfg, TEXT.align)
    want, got = ({(x.a, x.b, x.channel): [x[c] for c in cols] for x in f.collect()} for f in fits)
    assert {k[2] for k in want} == {"fused", "audio", "visual"} and len(want) > 100 and set(got) == set(want)
    for k, x in want.items():
        assert got[k] == pytest.approx(x, abs=1e-6), k
    # parts of few matches hold whole pairs
    one = max(blocked.collect(), key=lambda x: x.marks)
    block = crossing._unpacked(one.marks, bytes(one.packed), crossing.TIMED)
    every = sorted(zip(*(x.tolist() for x in next(crossing._matches(block, block, True))[1:])))
    monkeypatch.setattr(crossing, "FITTED_AT_ONCE", 5)
    parts = [list(zip(*(x.tolist() for x in p[1:]))) for p in crossing._matches(block, block, True)]
    assert len(parts) > 5 and sorted(sum(parts, [])) == every
    of = [{x[:2] for x in p} for p in parts]
    assert sum(map(len, of)) == len(set().union(*of))
    monkeypatch.undo()
    for name in ("offset_peak", "offset_refine", "modality_decisions", "verdict_rows"):
        plan = Q.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan, name


def test_texts_without_marks_make_no_pairs(spark):
    from overlapse.operators import crossing

    docs = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "cid long, text string")
    assert crossing.votes(crossing.blocks(crossing.shared_lists(docs), 3, 1.0)).count() == 0
    assert crossing.fitted(crossing.timed_blocks(docs, 3), 3, TEXT.candidate, TEXT.align).count() == 0


def test_pairs_of_documents_are_not_shuffled(spark):
    from overlapse import queries as Q

    for name in ("candidate_pairs", "shared_landmark_counts"):
        plan = Q.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, name
