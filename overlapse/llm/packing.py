"""Packing: hierarchical multi-length packing of documents into sequences.

Documents are tokenised once. Whole windows of long documents are sequences at once, where
they are. The remainders, each shorter than a window, are dealt over blocks of a bounded
number of tokens, and each block is packed on its own: every remainder is routed to the
smallest context-size tier that holds it. Tiers are packed from the longest down; the gap
that the longer pieces leave in a window is filled with the largest pieces of shorter tiers
that fit, and the last gap with a part cut off one of them. What is left when a tier can't
fill a window is less than that window, and becomes sequences of power-of-two lengths.
Sequences of a tier are dealt into step groups with even numbers of pieces.
"""

from __future__ import annotations

import math
import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlapse.llm.arrowtext import byte_steps, trimmed, words
from overlapse.workspace import materialise

LIMIT = 2048
TIERS = (2048, 1024, 512, 256)
#: Tokens that are packed together, on average.
BLOCK_TOKENS = 1 << 20
#: Added to the numbers of whole windows' sequences and step groups, which no block's reach.
WHOLE = 1 << 61
#: Sequences of one tier that make up a step.
STEP = 8
END_ID = 1
#: Bytes of text whose distinct words are encoded together.
SHARED_BYTES = 24 << 20


#: Words of these letters, with marks after them at most, are one or two pieces for the pre-tokenizer.
PLAIN = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+[.,;:!?*%#$&]*$"
MARKED = r"[.,;:!?*%#$&]$"
#: Plain words that are encoded as one text.
TOGETHER = 512


class WordEncoder:
    """Ids of distinct words. For a pre-tokenizer that drops white space, a text's ids are its words' ids in turn."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        if suffix:
            for token, i in self.tokenizer.get_vocab().items():
                self.ends[i] = token.endswith(suffix)

    def _each(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one word after the other, and how many each has.

        Plain words are encoded many at a time; where one ends is told by the tokens that
        end a word. All other words are encoded one by one.
        """
        plain = pc.match_substring_regex(names, PLAIN).to_numpy(zero_copy_only=False) if self.ends.any() else np.zeros(len(names), dtype=bool)
        sizes = np.zeros(len(names), dtype=np.int64)
        parts: list[np.ndarray] = []
        places: list[np.ndarray] = []
        at = np.flatnonzero(plain)
        if len(at):
            some = names.take(pa.array(at))
            pieces = 1 + pc.match_substring_regex(some, MARKED).to_numpy(zero_copy_only=False).astype(np.int64)
            words_ = some.to_pylist()
            texts = [" ".join(words_[i : i + TOGETHER]) for i in range(0, len(words_), TOGETHER)]
            ids = np.concatenate([np.array(x, dtype=np.uint32) for i in range(0, len(texts), 64) for x in self._each(texts[i : i + 64])])
            last = np.flatnonzero(self.ends[ids])  # the end of each piece
            stop = last[np.cumsum(pieces) - 1] + 1
            sizes[at] = np.diff(stop, prepend=0)
            parts.append(ids)
            places.append(at)
        rest = np.flatnonzero(~plain)
        if len(rest):
            found = self._each(names.take(pa.array(rest)).to_pylist())
            sizes[rest] = [len(x) for x in found]
            parts.append(np.concatenate([np.array(x, dtype=np.uint32) for x in found]))
            places.append(rest)
        # bring both kinds into the order of the words
        flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
        place = np.concatenate(places) if places else np.zeros(0, dtype=np.int64)
        before = np.cumsum(sizes[place]) - sizes[place]
        start = np.empty(len(names), dtype=np.int64)
        start[place] = before
        return flat[ragged(start, sizes)], sizes


def ragged(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after the other."""
    upto = np.cumsum(sizes)
    return np.repeat(start - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)


def encode_texts(text: pa.Array, encoder: WordEncoder) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, ids, offsets) for a few megabytes at a time: ids of each text, followed by END_ID.

    Each distinct word of all texts is encoded once.
    """
    steps = list(byte_steps(text))
    split = [words(text.slice(a, b - a)) for a, b in steps]
    coded = pa.chunked_array([x for x, _ in split], pa.string()).dictionary_encode()
    names = coded.chunk(coded.num_chunks - 1).dictionary if coded.num_chunks else pa.array([], pa.string())
    pool, sizes = encoder(names)
    pool, sizes = np.append(pool, np.uint32(END_ID)), np.append(sizes, 1)
    start = np.cumsum(sizes) - sizes
    codes = np.concatenate([c.indices.to_numpy() for c in coded.chunks]) if coded.num_chunks else np.zeros(0, dtype=np.int32)
    done = 0
    for (a, b), (flat, offsets) in zip(steps, split, strict=True):
        own = np.insert(codes[done : done + len(flat)].astype(np.int64), offsets[1:], len(names))
        done += len(flat)
        n = sizes[own]
        upto = np.concatenate(([0], np.cumsum(n)))
        yield a, b, pool[ragged(start[own], n)], upto[offsets + np.arange(len(offsets))]


def pack_block(lengths: list[int], limit: int = LIMIT, tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length); all but those of a power of two are as long as ``limit``."""
    sequences: list[list[tuple[int, int, int]]] = []
    pool: list[tuple[int, int, int]] = []  # (length, document, start), ascending
    for d, n in enumerate(lengths):
        whole = n // limit
        sequences += [[(d, i * limit, limit)] for i in range(whole)]
        if n % limit:
            pool.append((n % limit, d, whole * limit))
    pool.sort()
    for k, size in enumerate(tiers):
        floor = tiers[k + 1] if k + 1 < len(tiers) else 0
        while pool and pool[-1][0] > floor:
            if sum_below(pool, size) < size:
                return sequences + powers(pool, limit)
            n, d, s = pool.pop()
            window, gap = [(d, s, n)], size - n
            while gap:
                at = bisect_right(pool, (gap, len(lengths), 0)) - 1
                if at >= 0:
                    n, d, s = pool.pop(at)
                    window.append((d, s, n))
                    gap -= n
                    continue
                # nothing fits whole: the shortest piece gives up its beginning
                n, d, s = pool.pop(bisect_left(pool, (gap, -1, -1)))
                window.append((d, s, gap))
                insort(pool, (n - gap, d, s + gap))
                gap = 0
            sequences.append(window)
    return sequences + powers(pool, limit)


def sum_below(pool: list[tuple[int, int, int]], size: int) -> int:
    total = 0
    for n, _, _ in reversed(pool):
        total += n
        if total >= size:
            break
    return total


def powers(rest: list[tuple[int, int, int]], limit: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of power-of-two lengths, the longest first, from what is left."""
    out: list[list[tuple[int, int, int]]] = []
    total = sum(n for n, _, _ in rest)
    queue = [(d, s, n) for n, d, s in reversed(rest)]
    while total:
        size = min(limit, 1 << (total.bit_length() - 1))
        window, gap = [], size
        while gap:
            d, s, n = queue.pop(0)
            take = min(n, gap)
            window.append((d, s, take))
            if take < n:
                queue.insert(0, (d, s + take, n - take))
            gap -= take
        out.append(window)
        total -= size
    return out


def step_groups(sequences: list[list[tuple[int, int, int]]], step: int = STEP) -> list[tuple[int, int]]:
    """(tier, group) of each sequence: within a tier, sequences are dealt out by piece count, to and fro."""
    tier = [1 << (sum(n for _, _, n in x) - 1).bit_length() for x in sequences]
    out: list[tuple[int, int]] = [(0, 0)] * len(sequences)
    first = 0
    for size in sorted(set(tier), reverse=True):
        own = sorted((i for i in range(len(sequences)) if tier[i] == size), key=lambda i: (-len(sequences[i]), i))
        groups = -(-len(own) // step)
        for rank, i in enumerate(own):
            turn, at = divmod(rank, groups)
            out[i] = (size, first + (at if turn % 2 == 0 else groups - 1 - at))
        first += groups
    return out


def encoded(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """A row a whole window (doc_id, doc_tokens, start, serial, ids_crc32), and a row a remainder (doc_id, doc_tokens,
    start, serial, size, ids): ids as little-endian unsigned 32-bit or, where all fit, 16-bit integers."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path)
        serial = TaskContext.get().partitionId() << 36
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            for first, last in byte_steps(text, SHARED_BYTES):
                for a, b, ids, at in encode_texts(text.slice(first, last - first), encoder):
                    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
                    data, size = ids.astype("<u4" if wide else "<u2").tobytes(), 4 if wide else 2
                    row, start, crc, rest = [], [], [], []
                    for i, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                        whole = (y - x) // limit
                        for k in range(whole):
                            row.append(i)
                            start.append(k * limit)
                            crc.append(zlib.crc32(ids[x + k * limit : x + (k + 1) * limit].astype("<u4").tobytes()))
                            rest.append(None)
                        if (y - x) % limit:
                            row.append(i)
                            start.append(whole * limit)
                            crc.append(None)
                            rest.append(data[(x + whole * limit) * size : y * size])
                    n = len(row)
                    tokens = np.diff(at)[np.array(row, dtype=np.int64)] if n else np.zeros(0, dtype=np.int64)
                    names = batch.column(0).slice(first + a, b - a).take(pa.array(row, pa.int64()))
                    yield pa.RecordBatch.from_arrays([names, pa.array(tokens, pa.int64()), pa.array(start, pa.int64()), pa.array(np.arange(serial, serial + n)), pa.array([size] * n, pa.int32()), pa.array(crc, pa.int64()), pa.array(rest, pa.binary())], ["doc_id", "doc_tokens", "start", "serial", "size", "ids_crc32", "ids"])
                    serial += n

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, doc_tokens long, start long, serial long, size int, ids_crc32 long, ids binary")


def pack_documents(docs: DataFrame, tokenizer_path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    A null or empty text is its END_ID alone. Repeated rows and null ids are packed like any
    other, each whole; rows with one doc_id can't be told apart in the result. An empty
    table gives an empty result; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = materialise(encoded(docs, tokenizer_path), "packing-ids")
    rest = table.filter("ids is not null")
    tokens = rest.agg(F.sum(F.octet_length("ids") / F.col("size"))).head()[0] or 0
    blocks = max(1, math.ceil(tokens / block_tokens))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("serial")
        names, sizes, data = rows.column("doc_id"), rows.column("size").to_pylist(), rows.column("ids").to_pylist()
        before, total = rows.column("start").to_pylist(), rows.column("doc_tokens").to_pylist()
        ids = [np.frombuffer(x, dtype=f"<u{n}") for x, n in zip(data, sizes, strict=True)]
        sequences = pack_block([len(x) for x in ids])
        groups = step_groups(sequences)
        first = rows.column("block")[0].as_py() << 32
        out: list[tuple] = []
        for i, window in enumerate(sequences):
            offset = 0
            for d, start, n in window:
                out.append((d, before[d] + start, n, zlib.crc32(ids[d][start : start + n].astype("<u4").tobytes()), total[d], first + i, offset, groups[i][0], first + groups[i][1]))
                offset += n
        cols = list(zip(*out, strict=True))
        longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
        return pa.table({"doc_id": names.take(pa.array(cols[0], pa.int64())), **{c: pa.array(v, pa.int64()) for c, v in zip(longs, cols[1:], strict=True)}})

    dealt = rest.select("doc_id", "doc_tokens", "start", "serial", "size", "ids").withColumn("block", F.pmod(F.xxhash64("serial"), F.lit(blocks)).cast("long"))
    packed = dealt.groupBy("block").applyInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long")
    limit = F.lit(LIMIT).cast("long")
    whole = table.filter("ids is null").select("doc_id", "start", limit.alias("length"), "ids_crc32", "doc_tokens", (F.col("serial") + WHOLE).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), limit.alias("tier"), (F.floor(F.col("serial") / STEP) + WHOLE).alias("step_group"))
    return packed.unionByName(whole)
