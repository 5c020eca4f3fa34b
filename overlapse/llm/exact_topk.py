"""Exact top-k search by pivot-table elimination.

Distances of every vector to a set of pivots are computed once and stored with
the vectors. For a query q and a vector x, the largest |d(q, p) - d(x, p)| over the
pivots p bounds d(q, x) from below, and so bounds the inner product
(|q|^2 + |x|^2 - d(q, x)^2) / 2 from above. Candidates are evaluated in the order of
that bound until it falls below the k-th best score found: the rest can't enter.

Queries are handled in blocks of bounded size against all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from overlapse.workspace import materialise, new_path, remove

PIVOTS = 24
#: Vectors, about, among which the pivots are chosen; every vector gets its distances to all of them.
PIVOT_SAMPLE = 512
#: Queries that are held by a task at once.
BLOCK = 4096
#: Candidates of a batch that a query looks at in its first round; how rounds grow; queries whose bounds are held at once.
CHUNK, GROWTH, GROUP = 128, 4, 64
#: Scores are whole numbers; bounds are raised by this much against rounding.
SLACK = 0.25


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows padded with zeros to ``width``."""
    flat, offsets = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - (offsets[:-1] - offsets[0])[row]] = flat
    return out


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Far-apart rows: each next pivot is the row farthest from those chosen."""
    if not len(sample):
        return sample
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids."""
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def upper_bounds(q_pivot: np.ndarray, q_square: np.ndarray, x_pivot: np.ndarray, x_square: np.ndarray) -> np.ndarray:
    """Bounds on the products of some queries with a batch of vectors, pivot by pivot."""
    lower = np.zeros((len(q_pivot), len(x_pivot)), dtype=np.float32)
    apart = np.empty_like(lower)
    for j in range(q_pivot.shape[1]):
        np.subtract(x_pivot[None, :, j], q_pivot[:, j, None], out=apart)
        np.abs(apart, out=apart)
        np.maximum(lower, apart, out=lower)
    squares = (q_square[:, None] + x_square[None, :]).astype(np.float32)
    return (squares - lower**2) / 2 + (SLACK + 1e-5 * squares)


def evaluate(tops: list, at: int, bound: np.ndarray, q: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> np.ndarray:
    """Candidates in the order of their bounds, in rounds that grow, until no bound left reaches the k-th best score.

    A round's products are taken for all queries of the group at once, over the columns that any
    of them asks for; what a query didn't ask for is not looked at. Returns how many candidates each query looked at.
    """
    seen = np.zeros(len(bound), dtype=np.int64)
    going, size = np.arange(len(bound)), CHUNK
    while len(going):
        asked = np.zeros((len(going), len(x)), dtype=bool)
        for i, row in enumerate(going):
            left = bound[row]
            score = tops[at + row][0]
            reach = score[-1] if len(score) == k else -np.inf
            first = np.argpartition(-left, size)[:size] if len(left) > size else np.arange(len(left))
            first = first[(left[first] >= reach) & (left[first] > -np.inf)]
            asked[i, first] = True
            left[first] = -np.inf
            seen[row] += len(first)
        some = asked.any(axis=1)
        cols = np.flatnonzero(asked.any(axis=0))
        if not len(cols):
            break
        found = q[going] @ x[cols].T
        for i in np.flatnonzero(some):
            score, top = tops[at + going[i]]
            mine = np.flatnonzero(asked[i, cols])
            if len(score) == k:
                mine = mine[found[i, mine] >= score[-1]]
            if len(mine):
                tops[at + going[i]] = best(np.concatenate((score, found[i, mine])), np.concatenate((top, x_id[cols[mine]])), k)
        going = going[some]
        size *= GROWTH
    return seen


def exact_topk(vectors: DataFrame, k: int = 20, scale: float = 64.0, every: int = 20, block: int = BLOCK, pivots: int = PIVOTS, counted: bool = False) -> DataFrame:
    """Per query (vec_id divisible by ``every``): query_id, rank, vec_id, score of its k best candidates.

    With ``counted``, also n_evaluated, the candidates whose products the query looked at.

    Components become floor(scale * x). Null ids, null vectors and vectors with null or
    non-finite components take no part. Vectors of different lengths are compared as
    if padded with zeros. Rows that share a vec_id are one candidate each, but none of
    them is a candidate for the query of that id, which is asked once. Ties go to the
    smaller vec_id. Empty tables give an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    good = "vec_id is not null and embedding is not null and forall(embedding, v -> v is not null and not isnan(v) and abs(double(v)) < double('infinity'))"
    ints = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(good)
    ints = ints.select("vec_id", F.transform("embedding", lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("double")).alias("v"))
    ints = materialise(ints, "topk-vectors")
    width, rows = (x or 0 for x in ints.agg(F.max(F.size("v")), F.count("*")).head())
    # drawn evenly by hash where the rows are: pivots only tighten bounds, any choice gives the same result
    drawn = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1_000_000)) < F.lit(1_000_000 * min(1.0, PIVOT_SAMPLE / max(1, rows)))
    sample = ints.filter(drawn).select("v").toArrow()
    anchor = choose_pivots(matrix(sample.column("v").combine_chunks(), width) if len(sample) else np.zeros((0, width)), pivots)

    def precompute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = pivot_distances(matrix(batch.column(1), width), anchor)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, max(1, d.shape[1])), pa.int32()), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["vec_id", "v", "d"])

    table = materialise(ints.mapInArrow(precompute, "vec_id long, v array<double>, d array<double>"), "topk-pivots")
    asked = table.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    blocks = max(1, -(-asked.count() // block))
    queries = materialise(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), "topk-queries", ["block"])
    out = new_path(spark, "topk-found")
    for b in range(blocks):
        got = queries.filter(F.col("block") == b).select("vec_id", "v").toArrow()
        ask_id = got.column("vec_id").to_numpy()
        ask = matrix(got.column("v").combine_chunks(), width) if len(got) else np.zeros((0, width))
        held = spark.sparkContext.broadcast((ask_id, ask))

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            q_pivot, q_square = pivot_distances(q, anchor).astype(np.float32), (q**2).sum(axis=1)
            tops = [(np.zeros(0), np.zeros(0, dtype=np.int64)) for _ in ids]
            looked = np.zeros(len(ids), dtype=np.int64)
            for batch in batches:
                x_id, x = batch.column(0).to_numpy(), matrix(batch.column(1), width)
                x_pivot, x_square = matrix(batch.column(2), len(anchor)).astype(np.float32), (x**2).sum(axis=1)
                # products of small whole numbers are exact in single precision
                small = max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) ** 2 * max(1, width) < 1 << 24
                x_fast, q_fast = (x.astype(np.float32), q.astype(np.float32)) if small else (x, q)
                for at in range(0, len(ids), GROUP):
                    group = slice(at, at + GROUP)
                    bound = upper_bounds(q_pivot[group], q_square[group], x_pivot, x_square)
                    bound[ids[group][:, None] == x_id[None, :]] = -np.inf
                    looked[group] += evaluate(tops, at, bound, q_fast[group], x_fast, x_id, k)
            sizes = [len(t[1]) for t in tops]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([t[1] for t in tops])), pa.array(np.concatenate([t[0] for t in tops]).astype(np.int64)), pa.array(np.concatenate([[n] + [0] * (s - 1) for n, s in zip(looked, sizes) if s]).astype(np.int64))],
                    ["query_id", "vec_id", "score", "n_evaluated"],
                )

        table.mapInArrow(search, "query_id long, vec_id long, score long, n_evaluated long").write.mode("append").parquet(out)
        held.destroy()
    for done in (ints, table, queries):
        remove(done)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema("query_id long, vec_id long, score long, n_evaluated long").parquet(out)
    if counted:  # a task's count stands in the first of its rows
        found = found.withColumn("n_evaluated", F.sum("n_evaluated").over(W.partitionBy("query_id")))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", *["n_evaluated"] * counted)
