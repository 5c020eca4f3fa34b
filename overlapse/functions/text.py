"""Text kernels for Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def entropy_of(text: str) -> float:
    """Bits of a text's distribution of code points; 0 for an empty text."""
    counts = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), return_counts=True)[1]
    p = np.sort(counts) / max(1, counts.sum())
    return float(-(p * np.log2(p)).sum())


def char_entropy(docs: DataFrame) -> DataFrame:
    """(id, entropy) of rows (id, text), with the id's name and type; a null text has none."""

    name = docs.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if x is None else entropy_of(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], [name, "entropy"])

    return docs.mapInArrow(run, docs.select(name).schema.add("entropy", "double"))
