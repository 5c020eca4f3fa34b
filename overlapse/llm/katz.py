"""LM scoring: a Katz backoff model of any order with Good-Turing discounted counts.

Texts are coded once into batches of a few megabytes (word hashes and codes).
Batches then meet the model in three exchanges, each keyed by hash range so that
no key, however frequent, is more than one entry a batch:

1. every batch sends its distinct n-grams of each order with their training counts to
   the shards of the count tables; shards add them up, store the tables (partitioned
   by order, keys and counts in sorted arrays) and answer with the total counts. One
   batch is named the owner of each n-gram;
2. for the n-grams it owns, a batch adds up, per history, the discounted mass and
   the next lower order's probability of the seen words, and sends both to the shards of
   the history tables, which normalise the backoff weight exactly:
   alpha(h) = left-over mass / (1 - lower-order probability of the seen words);
3. the weights that unseen n-grams need go back to their batches, which finish the
   documents' scores.

P(w | h) is d(c) c(h, w) / c(h) for a seen n-gram and alpha(h) P(w | shorter h) for an
unseen one, down to P(w) = d(c) c(w) / N for a known word, and the left-over mass for the
class of all unknown words. All orders sum to one over the V known words and that class.
A text's first words have as many words of history as there are, and a mark of its beginning.

An exchange's rows are at most its keys, as no row is sent without one, so they grow with
the corpus however many shards there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlapse.llm.arrowtext import byte_steps, trimmed, words
from overlapse.workspace import materialise, release, remove

#: Words of a history, plus one.
ORDER = 2
BATCH_BYTES = 8 << 20
#: Batches' worth of text whose keys one shard holds.
BATCHES_A_SHARD = 2
#: Counts of counts that are kept: for Turing's estimate up to TURING, for the log-linear fit up to COUNTED.
TURING, COUNTED = 5, 20
#: No word holds a space, so these are no words' hashes.
END_WORD, BEGIN_WORD = b" end", b" begin"
STATS = 2 + COUNTED + 1


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit key of each (history, word) pair of keys."""
    k = h * np.uint64(0x9E3779B97F4A7C15)
    k ^= (w << np.uint64(31)) | (w >> np.uint64(33))
    k ^= k >> np.uint64(29)
    k *= np.uint64(0xBF58476D1CE4E5B9)
    k ^= k >> np.uint64(32)
    k *= np.uint64(0x94D049BB133111EB)
    return k ^ (k >> np.uint64(29))


def pack(values: np.ndarray, sorted_keys: bool = False) -> bytes:
    """Unsigned values as byte planes, only as many as the largest needs; sorted keys as differences."""
    v = np.ascontiguousarray(values, dtype=np.uint64)
    if sorted_keys and len(v):
        v = np.diff(v, prepend=np.uint64(0))
    planes = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 0
    return v.view(np.uint8).reshape(-1, 8).T[:planes].tobytes() if planes else b""


def unpack(data: bytes, count: int, sorted_keys: bool = False) -> np.ndarray:
    out = np.zeros((count, 8), dtype=np.uint8)
    if count:
        planes = len(data) // count
        out[:, :planes] = np.frombuffer(data, dtype=np.uint8).reshape(planes, count).T
    v = out.view(np.uint64).ravel()
    return np.cumsum(v, dtype=np.uint64) if sorted_keys else v


def shard_cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each of 2**bits hash ranges begins in sorted keys, and the end."""
    inner = (np.arange(1, 1 << bits, dtype=np.uint64)) << np.uint64(64 - bits) if bits else np.zeros(0, dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, inner), [len(keys)])).astype(np.int64)


@dataclass
class Level:
    """A batch's n-grams of one order; ``at`` has, a token, the index of the n-gram that ends there, or -1.

    ``history`` has the index of its first words among the n-grams of the order below; in order 2, the number of
    these stands for the beginning of a text.
    """

    keys: np.ndarray  # sorted and distinct
    at: np.ndarray
    history: np.ndarray


@dataclass
class Batch:
    """A batch's tokens: the texts' words, an end token after each text's; level k - 1 has the n-grams of k words."""

    levels: list[Level]
    doc: np.ndarray
    train: np.ndarray  # a flag a token

    @staticmethod
    def of(vocab: bytes, codes: bytes, n_tokens: np.ndarray, held: np.ndarray, order: int) -> Batch:
        names, token = np.frombuffer(vocab, dtype=np.uint64), np.frombuffer(codes, dtype=np.int32).astype(np.int64)
        doc = np.repeat(np.arange(len(n_tokens)), n_tokens)
        place = np.arange(len(token)) - (np.cumsum(n_tokens) - n_tokens)[doc] if len(token) else token
        none = np.full(len(token), -1, dtype=np.int64)
        levels = [Level(names, token, none)]
        for k in range(2, order + 1):
            below = levels[-1]
            history = none.copy()
            history[1:] = below.at[:-1]
            if k == 2:
                history[place == 0] = len(names)
                before = np.append(names, np.uint64(word_hash(BEGIN_WORD)))
            else:
                history[place == 0] = -1
                before = below.keys
            full = np.flatnonzero(history >= 0)
            at = none.copy()
            keys, at[full] = np.unique(mix(before[history[full]], names[token[full]]), return_inverse=True)
            levels.append(Level(keys, at, history))
        return Batch(levels, doc, ~held[doc] if len(doc) else np.zeros(0, dtype=bool))


def coded(docs: DataFrame, modulus: int, remainder: int) -> DataFrame:
    """Batches: (batch, doc_id[], held[], n_tokens[], vocab, codes)."""
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, serial, origin = word_hash(END_WORD), 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            text = pc.ascii_lower(pc.fill_null(batch.column(2), ""))
            for start, stop in byte_steps(text, BATCH_BYTES):
                flat, offsets = words(text.slice(start, stop - start))
                found = flat.dictionary_encode()
                hashes = np.array([word_hash(w.encode()) for w in found.dictionary.to_pylist()] + [end], dtype=np.uint64)
                vocab, place = np.unique(hashes, return_inverse=True)
                codes = place[found.indices.to_numpy()].astype(np.int32)
                codes = np.insert(codes, offsets[1:], place[-1]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array([0, stop - start], pa.int32()), x) for x in (batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start), pa.array(np.diff(offsets) + 1))]
                yield pa.RecordBatch.from_arrays([pa.array([origin | serial]), *lists, pa.array([vocab.tobytes()]), pa.array([codes.tobytes()])], ["batch", "doc_id", "held", "n_tokens", "vocab", "codes"])
                serial += 1

    return docs.select("doc_id", held.alias("held"), "text").mapInArrow(trimmed(run), f"batch long, doc_id array<{id_kind}>, held array<boolean>, n_tokens array<long>, vocab binary, codes binary")


def read_batches(table: pa.Table | pa.RecordBatch, order: int) -> Iterator[tuple[dict, Batch]]:
    for row in table.to_pylist():
        yield row, Batch.of(row["vocab"], row["codes"], np.array(row["n_tokens"], dtype=np.int64), np.array(row["held"], dtype=bool), order)


def requests(batches: DataFrame, bits: int, order: int) -> DataFrame:
    """A row a batch, order and shard: the batch's sorted keys there and their training counts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                for row, b in read_batches(part.slice(i, 1), order):
                    for k, level in enumerate(b.levels, 1):
                        counts = np.bincount(level.at[b.train & (level.at >= 0)], minlength=len(level.keys))
                        cuts = shard_cuts(level.keys, bits)
                        full = [s for s in range(1 << bits) if cuts[s] < cuts[s + 1]]
                        spans = [slice(cuts[s], cuts[s + 1]) for s in full]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([k] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array([row["batch"]] * len(full), pa.int64()), pa.array([x.stop - x.start for x in spans], pa.int64()), pa.array([pack(level.keys[x], True) for x in spans], pa.binary()), pa.array([pack(counts[x]) for x in spans], pa.binary())],
                            ["order", "shard", "batch", "n", "keys", "counts"],
                        )

    return batches.select("batch", "held", "n_tokens", "vocab", "codes").mapInArrow(trimmed(run), "order int, shard int, batch long, n long, keys binary, counts binary")


def add_up(asked: DataFrame) -> DataFrame:
    """Per order and shard the count table (kind "table": sorted keys, counts, counts of counts), and the answers to batches."""
    schema = pa.schema([("kind", pa.string()), ("order", pa.int32()), ("shard", pa.int32()), ("batch", pa.int64()), ("n", pa.int64()), ("key", pa.list_(pa.int64())), ("count", pa.list_(pa.int64())), ("counts", pa.binary()), ("owned", pa.binary()), ("stats", pa.list_(pa.int64()))])

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["batch"])
        keys = np.concatenate([unpack(r["keys"], r["n"], True) for r in rows])
        counts = np.concatenate([unpack(r["counts"], r["n"]) for r in rows]).astype(np.int64)
        place = np.argsort(keys, kind="stable")
        ordered = keys[place]
        first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        group = np.empty(len(keys), dtype=np.int64)
        group[place] = np.cumsum(first) - 1
        total = np.add.reduceat(counts[place], np.flatnonzero(first))
        # the owner of a key is the first batch that has seen it in training
        owned = np.zeros(len(keys), dtype=bool)
        seen = np.flatnonzero(counts > 0)
        owned[seen[np.unique(group[seen], return_index=True)[1]]] = True
        known = total > 0
        tallies = np.bincount(np.minimum(total[known], COUNTED + 1), minlength=COUNTED + 2)[1 : COUNTED + 2]
        named = {"order": rows[0]["order"], "shard": rows[0]["shard"]}
        out = [pa.table({"kind": ["table"], **{k: pa.array([v], pa.int32()) for k, v in named.items()}, "batch": pa.array([-1], pa.int64()), "n": pa.array([int(known.sum())], pa.int64()), "key": one_list(ordered[first][known].view(np.int64)), "count": one_list(total[known]), "counts": pa.array([b""], pa.binary()), "owned": pa.array([b""], pa.binary()), "stats": pa.array([[int(known.sum()), int(total.sum()), *map(int, tallies)]], pa.list_(pa.int64()))}, schema=schema)]
        at, answers = 0, []
        for r in rows:
            span = slice(at, at + r["n"])
            answers.append(named | {"kind": "answer", "batch": r["batch"], "n": r["n"], "key": None, "count": None, "counts": pack(total[group[span]]), "owned": np.packbits(owned[span]).tobytes() if r["order"] > 1 else b"", "stats": None})
            at += r["n"]
        return pa.concat_tables([*out, pa.Table.from_pylist(answers, schema=schema)])

    return asked.groupBy("order", "shard").applyInArrow(run, "kind string, order int, shard int, batch long, n long, key array<long>, count array<long>, counts binary, owned binary, stats array<long>")


def one_list(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.int64()))


@dataclass(frozen=True)
class Discounts:
    """Good-Turing ratios r*/r: Turing's estimate up to TURING where it is one, a log-linear fit elsewhere.

    The fit n_r ~ r**b makes r*/r = (1 + 1/r)**(b + 1), below 1 for every r, so that
    each history keeps some mass for unseen words.
    """

    ratio: np.ndarray  # by count, up to TURING; index 0 is unused
    slope: float

    @staticmethod
    def of(tallies: list[int]) -> Discounts:
        n = np.array([0, *tallies[:COUNTED]], dtype=np.float64)
        r = np.flatnonzero(n > 0)
        slope = -2.0
        if len(r) >= 3:
            slope = float(np.polyfit(np.log(r), np.log(n[r]), 1)[0])
        slope = min(slope, -1.1)
        ratio = np.ones(TURING + 1)
        for c in range(1, TURING + 1):
            fit = (1 + 1 / c) ** (slope + 1)
            turing = (c + 1) * n[c + 1] / (c * n[c]) if n[c] > 0 else 0.0
            ratio[c] = turing if 0.05 < turing < 1 else fit
        return Discounts(ratio, slope)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        c = np.maximum(counts, 1).astype(np.float64)
        return np.where(counts <= TURING, self.ratio[np.minimum(counts, TURING)], (1 + 1 / c) ** (self.slope + 1))


@dataclass(frozen=True)
class Model:
    total: int  # training tokens
    types: int
    discounts: list[Discounts]  # by order, from 1
    unknown: float  # probability of the class of unknown words

    @property
    def order(self) -> int:
        return len(self.discounts)

    def p_word(self, counts: np.ndarray) -> np.ndarray:
        known = self.discounts[0](counts) * counts / max(1, self.total)
        return np.where(counts > 0, known, self.unknown)

    def log_base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.total + self.types + 1))


def fit_model(tables: DataFrame, order: int) -> Model:
    """Global figures from the shards' counts of counts (a row an order), and the exact left-over unigram mass."""
    tables = tables.filter("kind = 'table'")
    sums = {r["order"]: r for r in tables.groupBy("order").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(STATS)]).collect()}
    stats = [[int(sums[k][f"s{i}"] or 0) if k in sums else 0 for i in range(STATS)] for k in range(1, order + 1)]
    discounts = [Discounts.of(x[2:]) for x in stats]

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masses = [float((discounts[0](c) * c).sum()) for x in batch.column(0) for c in [x.values.to_numpy()]]
            yield pa.RecordBatch.from_arrays([pa.array(masses, pa.float64())], ["mass"])

    mass = tables.filter("order = 1").select("count").mapInArrow(trimmed(kept), "mass double").agg(F.sum("mass")).head()[0] or 0.0
    total = stats[0][1]
    return Model(total, stats[0][0], discounts, 1 - mass / total if total else 1.0)


class Scorer:
    """A batch and the total counts of its n-grams."""

    def __init__(self, b: Batch, counts: list[np.ndarray], model: Model) -> None:
        self.b, self.model, self.counts = b, model, counts
        self.p_word = model.p_word(counts[0])
        end = np.searchsorted(b.levels[0].keys, np.uint64(word_hash(END_WORD)))
        # the count of the beginning is that of the end token: both stand once in each training text
        self.of_history = [None, np.append(counts[0], counts[0][end]), *counts[1:-1]]

    def p_seen(self, k: int, at: np.ndarray) -> np.ndarray:
        """P(w | h) of the n-grams of order ``k`` that end at tokens ``at``, all seen in training."""
        if k == 1:
            return self.p_word[self.b.levels[0].at[at]]
        level = self.b.levels[k - 1]
        c = self.counts[k - 1][level.at[at]]
        return self.model.discounts[k - 1](c) * c / np.maximum(self.of_history[k - 1][level.history[at]], 1)

    def descend(self, k: int, at: np.ndarray, out: np.ndarray, asks: list) -> None:
        """Log probabilities of tokens ``at`` from order ``k`` down, into ``out``; (k, tokens) whose backoff weight is to be added."""
        if k == 1 or not len(at):
            out[at] = np.log10(self.p_word[self.b.levels[0].at[at]])
            return
        level = self.b.levels[k - 1]
        some = level.at[at] >= 0
        seen = some.copy()
        seen[some] = self.counts[k - 1][level.at[at[some]]] > 0
        out[at[seen]] = np.log10(np.maximum(self.p_seen(k, at[seen]), 1e-300))
        rest = at[some & ~seen]
        asks.append((k, rest[self.of_history[k - 1][level.history[rest]] > 0]))
        self.descend(k - 1, at[~seen], out, asks)

    def masses(self, k: int, owned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per history of order ``k``, over its owned n-grams: left-over mass, and lower-order probability of the words."""
        level = self.b.levels[k - 1]
        one = np.zeros(len(level.keys), dtype=np.int64)  # a token of each n-gram stands for it
        full = np.flatnonzero(level.at >= 0)
        one[level.at[full]] = full
        at = one[owned]
        h, c = level.history[at], self.counts[k - 1][owned]
        size = len(self.of_history[k - 1])
        left = (1 - self.model.discounts[k - 1](c)) * c / np.maximum(self.of_history[k - 1][h], 1)
        return np.bincount(h, left, size), np.bincount(h, self.p_seen(k - 1, at), size)


def first_scores(batches: DataFrame, answers: DataFrame, model: Model, bits: int) -> DataFrame:
    """Documents' scores but for backoff weights (shard -1), and the requests to the history shards."""
    id_type = batches.schema["doc_id"].dataType.simpleString()
    begin = np.uint64(word_hash(BEGIN_WORD))
    empty = {"order": 0, "doc_id": [], "held": [], "n_tokens": [], "n_known": [], "base": [], "score": [], "n": 0, "keys": b"", "left_over": b"", "seen": b"", "asks": b"", "pairs": b"", "times": b""}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        got = sorted(right.to_pylist(), key=lambda r: r["shard"])
        for row, b in read_batches(left.select(["batch", "held", "n_tokens", "vocab", "codes"]), model.order):
            parts = [[r for r in got if r["order"] == k] for k in range(1, model.order + 1)]
            counts = [np.concatenate([np.zeros(0, np.int64), *(unpack(r["counts"], r["n"]).astype(np.int64) for r in x)]) for x in parts]
            owned = [np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(r["owned"], dtype=np.uint8), count=r["n"]).astype(bool) for r in x)]) for x in parts[1:]]
            scorer, n_docs = Scorer(b, counts, model), len(row["n_tokens"])
            log_p, asked = np.zeros(len(b.doc)), []
            scorer.descend(model.order, np.arange(len(b.doc)), log_p, asked)
            token = b.levels[0].at
            score = np.bincount(b.doc, log_p, n_docs)
            base = np.bincount(b.doc, model.log_base(counts[0])[token], n_docs)
            n_known = np.bincount(b.doc, counts[0][token] > 0, n_docs).astype(np.int64)
            out.append(empty | {"batch": row["batch"], "shard": -1, "doc_id": left.column("doc_id")[0].as_py(), "held": row["held"], "n_tokens": row["n_tokens"], "n_known": n_known.tolist(), "base": base.tolist(), "score": score.tolist()})
            for k, at in asked:
                level, below = b.levels[k - 1], b.levels[k - 2].keys
                names = np.append(below, begin) if k == 2 else below
                left_over, seen = scorer.masses(k, owned[k - 2])
                asks = np.zeros(len(names), dtype=bool)
                asks[level.history[at]] = True
                use = np.flatnonzero(asks | (seen > 0))
                use = use[np.argsort(names[use])]
                rank = np.zeros(len(names), dtype=np.int64)  # of a history among those asked for
                rank[use] = np.cumsum(asks[use]) - 1
                pairs, times = np.unique(b.doc[at] * (1 << 32) + rank[level.history[at]], return_counts=True)
                out.append(empty | {"batch": row["batch"], "shard": -1, "order": k, "n": len(pairs), "pairs": pairs.astype(np.int64).tobytes(), "times": pack(times)})
                cuts = shard_cuts(names[use], bits)
                for s in range(1 << bits):
                    x = use[cuts[s] : cuts[s + 1]]
                    if len(x):
                        out.append(empty | {"batch": row["batch"], "shard": s, "order": k, "n": len(x), "keys": pack(names[x], True), "left_over": left_over[x].tobytes(), "seen": seen[x].tobytes(), "asks": np.packbits(asks[x]).tobytes()})
        id_kind = left.schema.field("doc_id").type
        schema = pa.schema([("batch", pa.int64()), ("shard", pa.int32()), ("order", pa.int32()), ("doc_id", id_kind), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())), ("n_known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("score", pa.list_(pa.float64())), ("n", pa.int64()), ("keys", pa.binary()), ("left_over", pa.binary()), ("seen", pa.binary()), ("asks", pa.binary()), ("pairs", pa.binary()), ("times", pa.binary())])
        return pa.Table.from_pylist(out, schema=schema)

    kind = f"batch long, shard int, order int, doc_id {id_type}, held array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, score array<double>, n long, keys binary, left_over binary, seen binary, asks binary, pairs binary, times binary"
    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, kind)


def backoff_weights(asked: DataFrame) -> DataFrame:
    """Per order and shard the history table (kind "table": sorted keys, weights), and the weights that batches asked for."""
    schema = pa.schema([("kind", pa.string()), ("order", pa.int32()), ("shard", pa.int32()), ("batch", pa.int64()), ("key", pa.list_(pa.int64())), ("alpha", pa.list_(pa.float64()))])

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["batch"])
        keys = np.concatenate([unpack(r["keys"], r["n"], True) for r in rows])
        names, group = np.unique(keys, return_inverse=True)
        left_over = np.bincount(group, np.concatenate([np.frombuffer(r["left_over"]) for r in rows]), len(names))
        seen = np.bincount(group, np.concatenate([np.frombuffer(r["seen"]) for r in rows]), len(names))
        alpha = np.where(seen > 0, left_over / np.maximum(1 - seen, 1e-15), 1.0)
        named = [pa.array([rows[0]["order"]], pa.int32()), pa.array([rows[0]["shard"]], pa.int32())]
        out = [pa.Table.from_arrays([pa.array(["table"]), *named, pa.array([-1], pa.int64()), one_list(names.view(np.int64)), pa.ListArray.from_arrays(pa.array([0, len(alpha)], pa.int32()), pa.array(alpha))], schema=schema)]
        at = 0
        for r in rows:
            asks = np.unpackbits(np.frombuffer(r["asks"], dtype=np.uint8), count=r["n"]).astype(bool)
            got = alpha[group[at : at + r["n"]]][asks]
            if len(got):
                out.append(pa.Table.from_arrays([pa.array(["answer"]), *named, pa.array([r["batch"]], pa.int64()), one_list(np.zeros(0, np.int64)), pa.ListArray.from_arrays(pa.array([0, len(got)], pa.int32()), pa.array(got))], schema=schema))
            at += r["n"]
        return pa.concat_tables(out)

    return asked.groupBy("order", "shard").applyInArrow(run, "kind string, order int, shard int, batch long, key array<long>, alpha array<double>")


def last_scores(partial: DataFrame, weights: DataFrame, id_kind: str, total: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = right.sort_by([("order", "ascending"), ("shard", "ascending")])
        rows = left.select(["order", "held", "n_tokens", "n_known", "base", "score", "n", "pairs", "times"]).to_pylist()
        ids = left.column("doc_id").combine_chunks()
        where = next(i for i, r in enumerate(rows) if r["order"] == 0)
        row, score = rows[where], np.array(rows[where]["score"], dtype=np.float64)
        for r in rows:
            if r["n"]:
                alpha = pc.list_flatten(got.filter(pc.equal(got.column("order"), r["order"])).column("alpha")).to_numpy()
                pairs, times = np.frombuffer(r["pairs"], dtype=np.int64), unpack(r["times"], r["n"])
                score += np.bincount(pairs >> 32, np.log10(np.maximum(alpha[pairs & 0xFFFFFFFF], 1e-300)) * times, len(score))
        return pa.table({"doc_id": ids[where].values, "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(row["n_tokens"], pa.int64()), "n_known": pa.array(row["n_known"], pa.int64()), "train_tokens": pa.array([total] * len(score), pa.int64()), "base_score": pa.array(row["base"], pa.float64()), "score": pa.array(score)})

    kind = f"doc_id {id_kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return partial.groupBy("batch").cogroup(weights.groupBy("batch")).applyInArrow(run, kind)


def lm_scores(docs: DataFrame, modulus: int = 7, remainder: int = 2, order: int = ORDER) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns n-grams of up to ``order`` words from rows whose crc32(doc_id as text) modulo
    ``modulus`` is not ``remainder``. A null or empty text is its end token alone. A null id is
    not held out. Repeated rows count and are scored one by one; an empty table gives an empty
    result; other columns are not read. Texts are coded and counted whole.
    """
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    batches = materialise(coded(docs.select("doc_id", "text"), modulus, remainder), "lm-batches")
    bits = max(2, int(np.ceil(np.log2(max(1, batches.count()) / BATCHES_A_SHARD))) if batches.head(1) else 2)
    tables = materialise(add_up(requests(batches, bits, order)), "lm-counts", ["kind", "order"])
    release(tables)
    model = fit_model(tables, order)
    answers = tables.filter("kind = 'answer'").select("batch", "order", "shard", "n", "counts", "owned")
    partial = materialise(first_scores(batches, answers, model, bits).withColumn("part", F.when(F.col("shard") < 0, "score").otherwise("history")), "lm-partial", ["part"])
    remove(batches)
    remove(tables, "kind=answer")
    release(partial)
    asked = partial.filter("part = 'history'").select("order", "shard", "batch", "n", "keys", "left_over", "seen", "asks")
    weights = materialise(backoff_weights(asked), "lm-weights", ["kind", "order"])
    remove(partial, "part=history")
    release(weights)
    first = partial.filter("part = 'score'").select("batch", "order", "doc_id", "held", "n_tokens", "n_known", "base", "score", "n", "pairs", "times")
    return last_scores(first, weights.filter("kind = 'answer'").select("batch", "order", "shard", "alpha"), id_kind, model.total)
