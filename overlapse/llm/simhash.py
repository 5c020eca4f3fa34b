"""SimHash near-dedup with multi-index hashing.

Fingerprints are computed in Arrow functions. Distinct fingerprints are cut into
three segments; by the generalised pigeonhole rule two fingerprints within 4 bits
of each other differ by at most (1, 1, 0) bits in at least one of them. The small
Hamming balls of these radii are enumerated around each segment, looked up by an
equi-join with the segments of all fingerprints, and full distances verified.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from overlapse.llm.arrowtext import byte_steps, trimmed, words
from overlapse.operators.graph import connected_components
from overlapse.workspace import materialise, release, remove

SEED = 42
#: Shingles whose bits are held at once.
BLOCK = 20_000


def shingle_hashes(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Hashes of all ``width``-word shingles, repeats included; n + 1 offsets; each text's words, joined by spaces.

    A text of fewer words has one shingle, its whole sequence; one without words has none.
    """
    import xxhash

    text = pc.ascii_lower(pc.fill_null(text, ""))
    flat, offsets = words(text)
    rows = len(offsets) - 1
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat), " ")
    if not len(flat):
        return np.zeros(0, dtype=np.uint64), np.zeros(rows + 1, dtype=np.int64), [b""] * rows
    sizes = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.concatenate(([0], np.cumsum(sizes + 1)))
    n_words = np.diff(offsets)
    doc = np.repeat(np.arange(rows), n_words)
    base = np.frombuffer(joined.buffers()[1], dtype=np.int32)[: rows + 1].astype(np.int64)
    start = upto[:-1] - upto[offsets[:-1]][doc] + base[:-1][doc]
    end = start + sizes
    n_shingles = np.where(n_words == 0, 0, np.maximum(1, n_words - width + 1))
    first = np.concatenate(([0], np.cumsum(n_shingles)))
    of = np.repeat(np.arange(rows), n_shingles)
    head = offsets[:-1][of] + (np.arange(first[-1]) - first[:-1][of])
    tail = np.minimum(head + width - 1, offsets[1:][of] - 1)
    data, digest = joined.buffers()[2].to_pybytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[s:e], SEED) for s, e in zip(start[head].tolist(), end[tail].tolist(), strict=True)), dtype=np.uint64, count=len(head))
    return hashes, first, [data[a:b] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def bit_sums(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text and bit (the highest first), the shingles that have it; in blocks, to bound memory."""
    ones = np.zeros((len(first) - 1, 64), dtype=np.int64)
    full = np.flatnonzero(np.diff(first))
    cuts = first[full]
    i = 0
    while i < len(full):
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + BLOCK)))
        lo, hi = cuts[i], first[full[j - 1] + 1]
        if j == i + 1:
            for k in range(lo, hi, BLOCK):
                ones[full[i]] += np.unpackbits(hashes[k : min(hi, k + BLOCK)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        else:
            bits = np.unpackbits(hashes[lo:hi].astype(">u8").view(np.uint8)).reshape(-1, 64)
            ones[full[i:j]] = np.add.reduceat(bits, cuts[i:j] - lo, axis=0, dtype=np.int64)
        i = j
    return ones


def pack_bits(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def fingerprints(text: pa.Array, width: int) -> np.ndarray:
    """Signed 64-bit SimHash of each text's ``width``-word shingles, repeats included."""
    hashes, first, _ = shingle_hashes(text, width)
    return pack_bits(2 * bit_sums(hashes, first) > np.diff(first)[:, None])


def with_fingerprint(docs: DataFrame, width: int, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with a column ``_fp``; without the text unless ``keep_text``."""
    kept = [c for c in docs.columns if keep_text or c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(text_col)
            for start, stop in byte_steps(text, 2 << 20):
                part = batch.slice(start, stop - start)
                fp = pa.array(fingerprints(part.column(text_col), width))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), fp], [*kept, "_fp"])

    return docs.mapInArrow(trimmed(run), docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add("_fp", T.LongType()))


#: Distinct fingerprints beyond which segments are wider and balls larger: by chance a probe else meets too many.
WIDE = 100_000_000


def segments(distance: int, rows: int = 0) -> list[tuple[int, int, int]]:
    """(first bit, width, radius) of segments whose radii plus one add up to distance + 1."""
    count = max(2, (distance + (3 if rows > WIDE else 2)) // (3 if rows > WIDE else 2))
    cuts = [64 * i // count for i in range(count + 1)]
    radii = [(distance + 1) // count + (i < (distance + 1) % count) - 1 for i in range(count)]
    return [(cuts[i], cuts[i + 1] - cuts[i], radii[i]) for i in range(count) if radii[i] >= 0]


def segment_keys(fp: Column, distance: int, rows: int = 0) -> tuple[Column, Column]:
    """(index, probe): arrays of a fingerprint's segments, and of all in their Hamming balls."""
    index, probe = [], []
    for k, (at, width, radius) in enumerate(segments(distance, rows)):
        tagged = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(k << 40))
        index.append(tagged)
        flips = [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
        if len(flips) <= 64:
            probe.append(F.array(*[tagged.bitwiseXOR(F.lit(x)) for x in flips]))
        else:
            every = F.from_json(F.lit(json.dumps(flips)), "array<bigint>")
            probe.append(F.transform(every, lambda x: tagged.bitwiseXOR(x)))  # noqa: B023
    return F.array(*index), F.concat(*probe)


def links(distinct: DataFrame, distance: int, rows: int = 0) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints (column fp), ``rows`` of them about, within ``distance`` bits."""
    index, probe = segment_keys(F.col("fp"), distance, rows)
    left = distinct.select(F.col("fp").alias("a"), F.explode(probe).alias("key"))
    right = distinct.select(F.col("fp").alias("b"), F.explode(index).alias("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return left.join(right, "key").filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def components(table: DataFrame, distance: int) -> DataFrame:
    """(fp, component_id): each distinct fingerprint of (doc_id, fp) with the least id it reaches.

    Equal fingerprints are one node, so a group of copies costs one row. Null ids
    never become a component's id unless a component has no other.
    """
    distinct = materialise(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    edges = materialise(links(distinct, distance, distinct.count()), "simhash-links")
    found = connected_components(edges)
    grouped = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    out = materialise(grouped.join(least, "component").select("fp", "component_id"), "simhash-components")
    for done in (distinct, edges, found):
        remove(done)
    return out


def simhash_groups(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    A null or empty text, or one of white space only, has fingerprint zero, which is
    linked like any other. Repeated rows and null ids get a row each; an empty table
    gives an empty result; other columns are not read.
    """
    table = materialise(with_fingerprint(docs.select("doc_id", "text"), width).withColumnRenamed("_fp", "fp"), "simhash")
    found = components(table, distance)
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return table.join(found, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


#: Least Jaccard similarity of two texts' shingle sets that makes them near copies.
SIMILARITY = 0.8
#: Bits of the fingerprint within which segments' Hamming balls are complete, and bits in which texts that have met may
#: differ before their shingles are compared: at a similarity of 0.8, 9 on average and 14 at most of the pairs measured.
NEAR, FAR = 4, 18
#: One text in so many is drawn to find common shingles; those met COMMON times there stand last in every prefix, the
#: most common at the very end, COMMON_MOST of them at most. This settles an order only, and any order is exact.
DRAWN, COMMON, COMMON_MOST = 16, 3, 100_000
#: Nodes' names and keys that are broadcast; beyond it they are joined by shuffle.
BROADCAST_NODES, BROADCAST_KEYS = 200_000, 400_000
#: Bits of a text's map of its shingles, and the long integers that hold them.
MAP_BITS, MAP_LONGS = 2048, 32
#: While pairs to compare would be more than so many a row, texts are compared with one of each key's texts only.
PAIRS_A_ROW = 4


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of shingles that many of the drawn texts have, and their counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in byte_steps(batch.column(0), 2 << 20):
                hashes, first, _ = shingle_hashes(batch.column(0).slice(start, stop - start), width)
                sets = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], ["h"])

    drawn = docs.filter(F.pmod(F.xxhash64("text"), F.lit(DRAWN)) == 0).select("text").mapInArrow(trimmed(run), "h long")
    found = drawn.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(COMMON_MOST).toArrow()
    hashes, n = (found.column(c).to_numpy() for c in ("h", "n"))
    order = np.argsort(hashes.view(np.uint64))
    return hashes.view(np.uint64)[order], n[order]


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first of a text's distinct shingles, in an order that all texts share: rare ones, then by hash.

    Two sets of SIMILARITY share ``least`` shingles of either at least, so they share one of
    those that remain when ``least - 1`` are taken off the end of each. Any order is exact.
    """
    least = math.ceil(SIMILARITY * len(shingles) - 1e-9)
    if len(common[0]) and len(shingles):
        at = np.minimum(np.searchsorted(common[0], shingles), len(common[0]) - 1)
        n = np.where(common[0][at] == shingles, common[1][at], 0)
        if n.any():
            shingles = shingles[np.argsort(n, kind="stable")]
    return shingles[: len(shingles) - least + 1] if least else shingles


def text_key(text: str = "text") -> Column:
    """A row's text as a number; with its doc_id it tells a row from others."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def with_signature(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, t, k1, k2, fp, n, prefix, bits): its text's key, a row's name by its words, its fingerprint, its distinct
    shingles' number, the first of its shingles, and a map of them all: a bit is set where a shingle's hash begins so."""
    common = common_shingles(docs, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in byte_steps(batch.column(2), 2 << 20):
                hashes, first, norm = shingle_hashes(batch.column(2).slice(start, stop - start), width)
                names = names_of(norm)
                sets = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                least = [prefix(x, common).view(np.int64) for x in sets]
                heads = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, least)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *least])))
                fp = pack_bits(2 * bit_sums(hashes, first) > np.diff(first)[:, None])
                maps = np.zeros((len(sets), MAP_BITS), dtype=np.uint8)
                maps[np.repeat(np.arange(len(sets)), np.diff(first)), (hashes >> np.uint64(53)).astype(np.int64)] = 1
                maps = np.packbits(maps, axis=1).view(np.int64)
                bits = pa.ListArray.from_arrays(pa.array(np.arange(0, maps.size + 1, MAP_LONGS), pa.int32()), pa.array(maps.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(fp), pa.array([len(x) for x in sets], pa.int64()), heads, bits], ["doc_id", "t", "k1", "k2", "fp", "n", "prefix", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("t"), "text").mapInArrow(trimmed(run), f"doc_id {kind}, t long, k1 long, k2 long, fp long, n long, prefix array<long>, bits array<long>")


def names_of(norm: list[bytes]) -> np.ndarray:
    """Two 64-bit names of each text's words."""
    import xxhash

    return np.array([divmod(xxhash.xxh3_128_intdigest(x), 1 << 64) for x in norm], dtype=np.uint64).reshape(-1, 2).view(np.int64)


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(k1, set): the name and the distinct shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in byte_steps(batch.column(0), 2 << 20):
                hashes, first, norm = shingle_hashes(batch.column(0).slice(start, stop - start), width)
                sets = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
                at = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([pa.array(names_of(norm)[:, 0]), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(sets)))], ["k1", "set"])

    return texts.select("text").mapInArrow(trimmed(run), "k1 long, set array<long>")


def alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) of names whose shingle sets have SIMILARITY or more, written; ``pairs`` is removed.

    A bit that one text's map alone has set stands for a shingle that the other lacks: pairs for which
    too many lack are left out before any shingles are fetched.
    """
    a, b = (nodes.select(F.col("k1").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"m{x}")) for x in "ab")
    only_a, only_b = (F.expr(" + ".join(f"bit_count(m{x}[{i}] & ~m{y}[{i}])" for i in range(MAP_LONGS))) for x, y in ("ab", "ba"))
    shared = F.least(F.col("na") - only_a, F.col("nb") - only_b)
    may = pairs.join(a, "a").join(b, "b").filter(shared + 1e-6 >= SIMILARITY / (1 + SIMILARITY) * (F.col("na") + F.col("nb")))
    some = materialise(may.select("a", "b"), "simhash-pairs")
    remove(pairs)
    release(some)
    pairs = some
    ids = materialise(pairs.select(F.col("a").alias("k1")).union(pairs.select("b")).distinct(), "simhash-ids")
    few = ids.count() <= BROADCAST_NODES
    # texts of nodes that are in a pair, found by their first row's id and text
    wanted = nodes.join(F.broadcast(ids) if few else ids, "k1", "left_semi").select(F.col("least.doc_id").alias("_id"), F.col("least.t").alias("_t")).distinct()
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key() == F.col("_t")), "left_semi")
    sets = materialise(shingle_sets(texts, width).dropDuplicates(["k1"]), "simhash-sets")
    both = pairs.join(sets.select(F.col("k1").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("k1").alias("b"), F.col("set").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    edges = materialise(both.filter(shared >= SIMILARITY * (F.size("sa") + F.size("sb") - shared)).select("a", "b"), "simhash-links")
    for done in (ids, sets, pairs):
        remove(done)
    release(edges)
    return edges


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of (x, y), written."""
    return materialise(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "simhash-pairs")


def table_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs that meet in the tables of segments: each text with the first of the texts that a segment, or one in its
    small Hamming ball, leads to. So a group of n copies makes n pairs a segment, not their square."""
    index, probe = segment_keys(F.col("fp"), NEAR, nodes.count())
    firsts = nodes.select("k1", "fp", "n", F.explode(index).alias("key")).groupBy("key").agg(F.min(F.struct("k1", "fp", "n")).alias("to"))
    probes = nodes.select("k1", "fp", "n", F.explode(probe).alias("key"))
    size = F.least("n", "to.n") >= SIMILARITY * F.greatest("n", "to.n")
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("to.fp")))
    met = probes.join(firsts, "key").filter((F.col("k1") != F.col("to.k1")) & size & (far <= FAR))
    return ordered_pairs(met.select(F.col("k1").alias("x"), F.col("to.k1").alias("y")))


def shared_heads(nodes: DataFrame) -> DataFrame:
    """(k1, n, pos, key): the shingles of the prefixes that two texts' prefixes share, written."""
    keys = nodes.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    keys = materialise(keys, "simhash-keys")
    release(keys)
    few = keys.count() <= BROADCAST_KEYS
    rows = nodes.select("k1", "n", F.posexplode("prefix").alias("pos", "key"))
    out = materialise(rows.join(F.broadcast(keys) if few else keys, "key", "left_semi").select("k1", "n", "pos", "key"), "simhash-heads")
    remove(keys)
    release(out)
    return out


def prefix_pairs(heads: DataFrame, whole: DataFrame, few: bool, all_pairs: bool = False) -> tuple[DataFrame, bool]:
    """(a, b): pairs of different components that may have SIMILARITY, and whether these are all of them.

    The first shingle that two such texts share stands in both prefixes, within the first
    ninth of the smaller text's shingles, and what comes after it must suffice. Keys of one
    component only are dropped. While many texts share keys, each is compared with the
    first of a key's texts alone, so that large groups grow together before all pairs are made.
    """
    named = heads.join(F.broadcast(whole) if few else whole, "k1", "left").withColumn("component", F.coalesce("component", "k1"))
    spread = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("c"), F.min(F.struct("k1", "n", "pos", "component")).alias("to")).filter("low < high")
    spread = materialise(spread.select("key", "c", "to"), "simhash-spread")
    release(spread)
    rows, pairs = spread.agg(F.sum("c"), F.sum(F.col("c").cast("double") * F.col("c") / 2)).head()
    share = SIMILARITY / (1 + SIMILARITY)
    if rows and pairs > PAIRS_A_ROW * rows and not all_pairs:
        met = named.join(spread, "key")
        enough = F.least(F.col("n") - F.col("pos"), F.col("to.n") - F.col("to.pos")) + 1e-6 >= share * (F.col("n") + F.col("to.n"))
        met = met.filter((F.col("component") != F.col("to.component")) & enough)
        found, complete = ordered_pairs(met.select(F.col("k1").alias("x"), F.col("to.k1").alias("y"))), False
    else:
        met = named.join(spread.select("key"), "key", "left_semi")
        left, right = (met.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("k1", "component", "n", "pos")]) for x in "ab")
        most = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
        smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("k1_a") < F.col("k1_b")))
        enough = smaller & (F.col("component_a") != F.col("component_b")) & (most + 1e-6 >= share * (F.col("n_a") + F.col("n_b")))
        # of two texts the smaller one's shared shingle stands within the first ninth
        left = left.filter(F.col("pos_a") <= (1 - SIMILARITY) / (1 + SIMILARITY) * F.col("n_a") + 1e-6)
        found = ordered_pairs(left.join(right, "key").filter(enough).select(F.col("k1_a").alias("x"), F.col("k1_b").alias("y")))
        complete = True
    remove(spread)
    release(found)
    return found, complete


def merged(whole: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(k1, component) of all nodes with a link, after ``edges`` have joined components; written, in place of ``whole``."""
    ends = edges.select("a", "b")
    if whole is not None:  # each node's link to its component stands for the links so far
        ends = ends.unionByName(whole.select(F.col("k1").alias("a"), F.col("component").alias("b")))
    found = connected_components(ends)
    out = found.select(F.col("node").alias("k1"), "component")
    out.scratch_path = found.scratch_path
    if whole is not None:
        remove(whole)
    return out


def near_copies(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, t, k1, component_id, component_t): rows with the first row that they reach through near copies.

    The first is the one with the least doc_id, then the least key of its text; rows without
    a doc_id come last.

    Rows with the same words are one node. Nodes meet in the tables of their fingerprints'
    segments (``table_pairs``), which brings most near copies together cheaply. Whatever these
    tables miss is found by an exact rule between the components so far (``prefix_pairs``).
    All pairs are compared by their shingles, so that every link is one of SIMILARITY or more.
    """
    table = materialise(with_signature(docs, width), "simhash-signatures")
    nodes = table.groupBy("k1", "k2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("least"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    nodes = materialise(nodes, "simhash-nodes")
    rows = materialise(table.select("doc_id", "t", "k1"), "simhash-rows")
    remove(table)
    release(rows)
    heads = shared_heads(nodes)
    edges = alike(table_pairs(nodes), nodes, docs, width)
    whole = merged(None, edges)
    remove(edges)
    done = False
    while not done:
        pairs, done = prefix_pairs(heads, whole, whole.count() <= BROADCAST_NODES)
        edges = alike(pairs, nodes, docs, width)
        grown = bool(edges.head(1))
        if grown:
            whole = merged(whole, edges)
        remove(edges)
        if not done and not grown:
            pairs, done = prefix_pairs(heads, whole, whole.count() <= BROADCAST_NODES, all_pairs=True)
            edges = alike(pairs, nodes, docs, width)
            if edges.head(1):
                whole = merged(whole, edges)
            remove(edges)
    remove(heads)
    grouped = nodes.groupBy("k1").agg(F.min("least").alias("least")).join(whole, "k1", "left").withColumn("component", F.coalesce("component", "k1"))
    least = grouped.groupBy("component").agg(F.min("least").alias("of"))
    firsts = grouped.drop("least").join(least, "component").select("k1", F.col("of.doc_id").alias("component_id"), F.col("of.t").alias("component_t"))
    out = materialise(rows.join(firsts, "k1"), "simhash-groups")
    for done in (rows, nodes, whole):
        remove(done)
    release(out)
    return out


def simhash_filter(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row of each group of near copies, the one with the smallest doc_id; the columns of ``docs``.

    Rows are told by their words, not by their ids: rows without an id, and rows of one id with
    different texts, stay unless they are near copies. Of rows with one id and text (repeated
    rows) one stays. A null text counts as empty; empty texts are one group.
    """
    names = docs.columns
    at = {c: f"_c{i}" for i, c in enumerate(names)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(at[c]) for c in names]).withColumn("_key", text_key(at["text"]))
    found = near_copies(docs, width)
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("t") == F.col("component_t"))
    # texts aren't shuffled for the few rows that go, or that are repeated
    marked = found.groupBy("doc_id", "t").agg(F.count("*").alias("copies"), F.min(first).alias("first")).filter("not first or copies > 1")
    marked = materialise(marked.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), F.col("first").alias("_first")), "simhash-marked")
    few = marked.count() <= BROADCAST_NODES
    remove(found)
    whole = renamed.join(F.broadcast(marked) if few else marked, F.col(at["doc_id"]).eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_t")), "left")
    out = whole.filter("_first is null").select(*at.values())
    if marked.filter("_first").head(1):
        out = out.unionByName(whole.filter("_first").dropDuplicates([at["doc_id"], "_key"]).select(*at.values()))
    return out.select(*[F.col(at[c]).alias(c) for c in names])
