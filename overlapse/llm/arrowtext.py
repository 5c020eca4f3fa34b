"""Vectorised text helpers for Arrow functions: all loops run in C++ or numpy, over whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from overlapse.functions.arrow import STEP_BYTES, byte_steps, lines, owner, trimmed  # noqa: F401


def words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text: the flat words, and n + 1 offsets. No nulls."""
    lists = pc.ascii_split_whitespace(text)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    keep = pc.not_equal(flat, "")
    if pc.all(keep, min_count=0).as_py():
        return flat, offsets
    before = np.concatenate(([0], np.cumsum(keep.to_numpy(zero_copy_only=False), dtype=np.int64)))
    return flat.filter(keep), before[offsets]


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` within each row's span."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_window_words(codes: np.ndarray, offsets: np.ndarray, n_codes: int) -> np.ndarray:
    """Per text, the words that lie in a 3-word window found twice or more in that text."""
    n, rows = len(codes), len(offsets) - 1
    if n < 3:
        return np.zeros(rows, dtype=np.int64)
    doc = owner(offsets)
    at = np.flatnonzero(doc[:-2] == doc[2:])
    codes = codes.astype(np.int64)
    if n_codes < 1 << 21:
        key = (codes[at] << 42) | (codes[at + 1] << 21) | codes[at + 2]
    else:  # rank the pairs first, so that a key of three words still fits 64 bits
        pair = np.unique(codes[at] * n_codes + codes[at + 1], return_inverse=True)[1].astype(np.int64)
        key = pair * n_codes + codes[at + 2]
    order = np.lexsort((key, doc[at]))
    k, d = key[order], doc[at][order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit, marked = at[order[twice]], np.zeros(n, dtype=bool)
    for i in range(3):
        marked[hit + i] = True
    return per_row(marked, offsets)


def text_stats(text: pa.Array) -> dict[str, np.ndarray]:
    """Counts over whole texts (null counts as empty), one int64 array a statistic."""
    text = pc.fill_null(text, "")
    flat, offsets = words(text)
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    rows = len(text)
    line, line_at = lines(text)
    has_word = pc.match_substring_regex(line, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    line_code = line.dictionary_encode().indices.to_numpy().astype(np.int64)
    line_doc = owner(line_at)
    n_lines = per_row(has_word, line_at)
    distinct = np.unique((line_doc[has_word] << 32) | line_code[has_word])
    own = owner(offsets)
    seen = np.unique((own << 32) | codes)

    def count(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(text, pattern).to_numpy(zero_copy_only=False).astype(np.int64)

    return {
        "n_words": np.diff(offsets),
        "word_chars": per_row(pc.utf8_length(flat).to_numpy(zero_copy_only=False), offsets),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_dup_lines": n_lines - np.bincount(distinct >> 32, minlength=rows),
        "n_repeat_words": repeated_window_words(codes, offsets, len(coded.dictionary)),
        "n_lines": n_lines,
        "n_upper": count(r"\p{Lu}"),
        "n_digits": count(r"[0-9]"),
        "n_marks": count(r"[!?]"),
        "n_stops": count(r"[.,;:]"),
        "n_distinct": np.bincount(seen >> 32, minlength=rows),
    }
