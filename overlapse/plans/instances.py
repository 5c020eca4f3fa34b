"""The engine's relations, instantiated on the driver's tables.

Items are documents (content id: digest of the text), with 5-token shingles as the audio
channel's landmarks and whole lines as the visual channel's; frames are embedding vectors
(file: label); segments are a user's events of one type; edges lead from the first
document of a pair to the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from overlapse.config import TEXT
from overlapse.operators import align, crossing, landmarks, retrieval
from overlapse.workspace import remove


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def audio_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landmarks.shingles(table(spark, sf_dir, "documents"))


def visual_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landmarks.line_landmarks(table(spark, sf_dir, "documents"))


def weights(marks: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    # counted in the plan, not by an action of its own
    n = table(spark, sf_dir, "documents").agg(F.count("*").cast("double").alias("n"))
    return retrieval.document_frequency(marks, n, TEXT.candidate.idf_smoothing)


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share shingles or lines, by blocks."""
    docs = table(spark, sf_dir, "documents")
    lists = crossing.shared_lists(docs.select(F.col("doc_id").alias("cid"), "text"))
    blocked = crossing.blocks(lists, docs.count(), TEXT.candidate.idf_smoothing)
    remove(lists)
    return blocked


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, n, mass, is_audio) of both channels."""
    return crossing.votes(text_blocks(spark, sf_dir))


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossing.candidates(text_blocks(spark, sf_dir), TEXT.candidate)


def blocking_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossing.blocking_nodes(text_blocks(spark, sf_dir), TEXT.candidate)


def _fitted(spark: SparkSession, sf_dir: str, wide: bool) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    blocked = crossing.timed_blocks(docs.select(F.col("doc_id").alias("cid"), "text"), n)
    return crossing.fitted(blocked, n, TEXT.candidate, TEXT.align, wide)


def fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of all candidate pairs, in all channels."""
    return _fitted(spark, sf_dir, wide=False)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.judge(_fitted(spark, sf_dir, wide=True), TEXT.align)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_id, i, j, beta, weight) of accepted pairs: b_i - b_j = beta."""
    kept = verdicts(spark, sf_dir).filter("accept")
    return kept.select(F.xxhash64("a", "b").alias("edge_id"), F.col("a").alias("i"), F.col("b").alias("j"), "beta", align.edge_weight(TEXT.align).alias("weight"))


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): documents of one content, each linked to the first by id; documents without a text have none."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", landmarks.content_id(F.col("text")).alias("cid"))
    first = docs.groupBy("cid").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return docs.join(first, "cid").filter("doc_id <> a").select("a", F.col("doc_id").alias("b"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("cid"), F.col("vec_id").alias("t"), F.col("embedding").alias("vec"))


def sign_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cid, t, phash): a bit a dimension, set where the component is positive; the first is the lowest bit."""
    bits = F.aggregate(F.transform("vec", lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))
    return frames(spark, sf_dir).select("cid", "t", bits.alias("phash"))


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments: a user's events of one type, from first to last in epoch seconds; quality is the mean value."""
    ev = table(spark, sf_dir, "events").filter("user_id is not null and event_type is not null and ts is not null")
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 1e6
    rows = ev.groupBy("user_id", "event_type").agg(F.min(t).alias("s"), F.max(t).alias("e"), F.round(F.avg("value"), 6).alias("quality"), F.count("*").alias("size_bytes"))
    pos = F.row_number().over(W.partitionBy("user_id").orderBy("event_type")) - 1
    return rows.select(
        F.col("user_id").cast("string").alias("cluster"), pos.alias("pos"), F.col("event_type").alias("vid"), "s", "e", "quality",
        (F.col("quality") < 45).alias("terrible"), F.lit(0.0).alias("audio_quality"), F.lit("").alias("lang"), F.lit(0).alias("codec_rank"), "size_bytes",
    )
