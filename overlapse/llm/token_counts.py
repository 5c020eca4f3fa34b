"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes, and a long text is split at places where the
tokenizer's own pre-tokenizer always splits, so that the parts' counts add up
to the whole text's count.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlapse.llm.arrowtext import byte_steps, trimmed

#: Bytes that one call of the tokenizer gets; also the size beyond which a text is split.
BATCH_BYTES = 512 << 10

#: One space between two letters: byte-level BPE pre-tokenizers end a word before it and
#: start the next with it, whatever stands around. White-space runs, digits and signs are no such place.
SAFE_SPACE = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ɏ]) (?=[A-Za-zÀ-ÖØ-öø-ɏ])")


def split_safely(text: str, limit: int = BATCH_BYTES) -> list[str]:
    """Parts of ``limit`` bytes or little more whose concatenation is the text, cut at safe spaces only."""
    parts, start = [], 0
    while len(text) - start > limit // 4:
        # a character is one to four bytes: as many as fill the limit at most
        size = len(text[start : start + limit].encode("utf-8", "surrogatepass"))
        step = min(limit, max(1, limit * min(limit, len(text) - start) // max(1, size)))
        if start + step >= len(text):
            break
        cut = SAFE_SPACE.search(text, start + step)
        if cut is None:
            break
        parts.append(text[start : cut.start()])
        start = cut.start()
    parts.append(text[start:])
    return parts


def cuts_at_spaces(path: str) -> bool:
    """Whether a tokenizer's file says that a word always ends before a space: a byte-level pre-tokenizer with its
    own pattern of words, no normaliser, and no added token that holds a space."""
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    steps = data.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps]) if steps.get("type") == "Sequence" else [steps]
    level = [s for s in steps if s.get("type") == "ByteLevel"]
    return data.get("normalizer") is None and len(steps) == len(level) == 1 and level[0].get("use_regex", True) and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") for t in data.get("added_tokens", []))


def load_counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts for a tokenizers (.json) or sentencepiece (.model) file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def count_texts(texts: list[str], count: Callable[[list[str]], list[int]], limit: int = BATCH_BYTES, splits: bool = True) -> list[int]:
    """Counts of whole texts, in calls of about ``limit`` bytes."""
    totals = [0] * len(texts)
    batch: list[str] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        for i, n in zip(owners, count(batch), strict=True):
            totals[i] += n
        batch.clear()
        owners.clear()
        size = 0

    for i, text in enumerate(texts):
        for part in split_safely(text, limit) if splits else [text]:
            n = len(part.encode("utf-8", "surrogatepass"))
            if batch and size + n > limit:
                flush()
            batch.append(part)
            owners.append(i)
            size += n
    if batch:
        flush()
    return totals


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty (0 bytes, 0 tokens). Null ids, repeated rows and
    ties are kept as they are, one result a row; an empty table gives an empty
    result; other columns are not read. Texts are encoded whole where the tokenizer's file
    doesn't say that a word always ends before a space (``cuts_at_spaces``).
    """
    splits = cuts_at_spaces(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load_counter(tokenizer_path)
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            n_bytes = pc.cast(pc.binary_length(text), pa.int64())
            tokens = []
            for start, stop in byte_steps(text, 8 * BATCH_BYTES):
                tokens += count_texts(text.slice(start, stop - start).to_pylist(), count, splits=splits)
            n = pa.array(tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(trimmed(run), f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
