"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of all texts are computed once and stored. The trees are fitted on
the driver from a bounded sample of labelled rows, then flattened into arrays
that numpy traverses for whole batches of rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlapse.llm.arrowtext import byte_steps, text_stats, trimmed
from overlapse.workspace import materialise

#: Labelled rows that the trees are fitted on, about: drawn evenly by hash where there are more.
MAX_TRAIN_ROWS = 50_000
DRAWS = 1_000_000
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "digits", "marks", "stops", "distinct", "line_words")


def features(text: pa.Array) -> np.ndarray:
    """One row of document statistics per text; ratios of an empty text are 0."""
    s = {k: v.astype(np.float64) for k, v in text_stats(text).items()}
    n, chars, rows = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1), np.maximum(s["n_lines"], 1)
    cols = [np.log1p(s["n_words"]), s["word_chars"] / n, s["n_symbols"] / n, s["n_dup_lines"] / rows, s["n_repeat_words"] / n, s["n_upper"] / chars, s["n_digits"] / chars, s["n_marks"] / n, s["n_stops"] / n, s["n_distinct"] / n, np.log1p(s["n_words"] / rows)]
    return np.stack(cols, axis=1)


@dataclass(frozen=True)
class Forest:
    """Trees flattened into arrays; a leaf points to itself. ``roots`` has the first node of each tree."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, min_rows: int = 10) -> Forest:
    """Logistic loss, second-order splits found on histograms of quantile bins."""
    if len(y) == 0 or y.min() == y.max():
        p = 0.5 if len(y) == 0 else (0.99 if y[0] else 0.01)
        zero = np.zeros(1, dtype=np.int64)
        return Forest(zero, zero, np.zeros(1), zero, zero, np.zeros(1), float(np.log(p / (1 - p))), 1)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], axis=1)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    score = np.full(n, bias)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf() -> int:
        i = len(feature)
        feature.append(0)
        threshold.append(0.0)
        left.append(i)
        right.append(i)
        value.append(0.0)
        return i

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        roots.append(leaf())
        todo = [(roots[-1], np.arange(n), 0)]
        while todo:
            node, rows, level = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            best = (1e-6, -1, -1)
            if level < depth and len(rows) >= 2 * min_rows:
                for j in range(width):
                    if not len(edges[j]):
                        continue
                    size = len(edges[j]) + 1
                    b = binned[rows, j]
                    gl = np.cumsum(np.bincount(b, grad[rows], size))[:-1]
                    hl = np.cumsum(np.bincount(b, hess[rows], size))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
                    gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                    gain[(nl < min_rows) | (len(rows) - nl < min_rows)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            if best[1] < 0:
                value[node] = -rate * g / (h + ridge)
                score[rows] += value[node]
                continue
            _, j, k = best
            feature[node], threshold[node] = j, float(edges[j][k])
            left[node], right[node] = leaf(), leaf()
            low = binned[rows, j] <= k
            todo += [(left[node], rows[low], level + 1), (right[node], rows[~low], level + 1)]
    arrays = [np.array(v) for v in (roots, feature, threshold, left, right, value)]
    return Forest(*arrays, bias, depth)


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 3, held_fold: int = 1, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1), predicted.

    Labels count only for rows outside the held-out fold (crc32 of the id as text,
    modulo ``folds``); several labels of one id are averaged, null ones left out. A
    null text counts as empty and gets the score of an empty text; a null id is not
    held out and has no label. Without labels, or with one class only, the score is
    a constant. Repeated rows get a row each; an empty table gives an empty result;
    other columns are not read.
    """
    id_kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1).fill_null("")
            for start, stop in byte_steps(text):
                x = features(text.slice(start, stop - start))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), lists], ["doc_id", "x"])

    table = materialise(docs.select("doc_id", "text").mapInArrow(trimmed(measure), f"doc_id {id_kind}, x array<double>"), "quality-features")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_fold, F.lit(False))
    known = labels.select("doc_id", F.col(label_col).cast("double").alias("y")).filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.avg("y").alias("y"))
    labelled = table.filter(~fold).join(known, "doc_id").select("x", F.xxhash64("doc_id", "x").alias("draw"), (F.col("y") >= 0.5).cast("double").alias("y"))
    # rows are drawn where they are, by hashes of id and features, so that copies are drawn one by one; some more than
    # the bound, of which the first in the hashes' order come to the driver
    share = max_train_rows / max(1, labelled.count())
    if share < 1:
        part = F.pmod("draw", F.lit(DRAWS))
        labelled = labelled.filter(part < F.lit(1.1 * share * DRAWS)).orderBy(part, "draw").limit(max_train_rows)
    sample = labelled.select("x", "y").toArrow()
    x = np.array(sample.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES)) if len(sample) else np.zeros((0, len(FEATURES)))
    y = sample.column("y").to_numpy()
    order = np.lexsort((y, *x.T)) if len(y) else np.zeros(0, dtype=int)
    forest = fit(x[order], y[order])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = forest.predict(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return table.select("doc_id", fold.alias("held_out"), "x").mapInArrow(trimmed(score), f"doc_id {id_kind}, held_out boolean, score double, predicted int")
