"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines that are equal form a class; the join runs between classes. For an edit distance of
at most t, t + 1 segments are laid into every line, the first half of them counted from
its beginning, the others from its end. In two lines that near, some segment i stands
unchanged with i edits at most before it and t - i after it, so it is shifted by i, or by
t - i, at most. A segment's size depends on the line's length in steps, so that lines of
nearly the same length have the same segments: a line enters the index with its own
segments, and probes it with the few substrings that can match those of a line up to t
characters shorter. Lengths and counts of some characters, which t edits can change by
2 t in all, are compared in the join itself. Candidates are verified with a bit-parallel
edit distance over the band of 2 t + 1 diagonals.

Every line that has a word is judged. A pair may differ by one edit for every
``EDIT_CHARS`` characters of its shorter line, ``MAX_EDITS`` at most: shorter lines meet as
equal lines only, so that "Yes." and "No." stay apart. Each number of edits has segments of
its own.

A line is dropped if an equal line stands earlier, or if its class is within reach
of a class that begins earlier. Earlier means by doc_id, then by line number; of rows with
one id and one text (repeated rows) the first stands before the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overlapse.workspace import materialise, release, remove

MAX_EDITS = 2
#: Characters (code points) of the shorter line for each edit that a pair may differ by.
EDIT_CHARS = 16
WORD = r"[^\x20\x09-\x0D]"


#: Segments' sizes are multiples of this; a line must hold one for each segment.
SIZE_STEP = 8
#: Characters that are counted, twelve at most, in five bits each: frequent ones of European texts.
COUNTED = "eantirhosdlu"


def segment_size(length: Column, edits: int) -> Column:
    return F.floor(length / (SIZE_STEP * (edits + 1))).cast("int") * SIZE_STEP


def segment_key(line: Column, length: Column, i: int, edits: int, size: Column, shift: int) -> Column:
    """The key of segment ``i`` of a UTF-32 line, or of the substring that is shifted against it."""
    start = i * size if 2 * i <= edits else length - (edits + 1 - i) * size
    return F.xxhash64(F.lit(edits << 8 | i), size, F.substring(line, 4 * (start + shift) + 1, 4 * size))


def line_keys(line: Column, length: Column, edits: int) -> Column:
    """An array of (key, own, first): a line's own segments, and the substrings with which it probes besides them.

    ``first`` is the key of the first segment of the same size.
    """
    size, shorter = segment_size(length, edits), segment_size(length - edits, edits)
    own, shifted, other = [], [], []
    for i in range(edits + 1):
        reach = min(i, edits - i)
        for shift in range(-reach, reach + 1):
            for n, into, mine in ((size, shifted if shift else own, shift == 0), (shorter, other, False)):
                into.append(F.struct(segment_key(line, length, i, edits, n, shift).alias("key"), F.lit(mine).alias("own"), segment_key(line, length, 0, edits, n, 0).alias("first")))
    both = F.array(*own, *shifted)
    return F.when(size == shorter, both).otherwise(F.concat(both, F.array(*other)))


def allowed(shorter: Column, edits: int) -> Column:
    """Edits by which a pair may differ, from its shorter line's length."""
    return F.least(F.floor(shorter / EDIT_CHARS).cast("int"), F.lit(edits))


def all_keys(wide: DataFrame, edits: int) -> DataFrame:
    """A row a key of ``line_keys`` for each number of edits that pairs with a line may have."""
    out = []
    for e in range(1, edits + 1):
        # the longer line of a pair is up to e characters longer than the shorter one
        size = F.col("size")
        own = wide.filter((size >= e * EDIT_CHARS) & (F.lit(True) if e == edits else size < (e + 1) * EDIT_CHARS + e))
        out.append(own.select("h1", "counts", "size", F.explode(line_keys(F.col("u"), size, e)).alias("k"), F.lit(e).alias("edits")))
    return reduce(DataFrame.unionAll, out)


def char_counts(line: Column) -> Column:
    """The counts, modulo 32, in one number."""
    total = F.lit(0).cast("bigint")
    for k, c in enumerate(COUNTED):
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
        total = total.bitwiseOR(F.shiftleft(n.cast("bigint").bitwiseAND(F.lit(31).cast("bigint")), 5 * k))
    return total


def counts_apart(a: Column, b: Column) -> Column:
    """The sum of the counts' differences, never more than the true one."""
    out = F.lit(0).cast("bigint")
    for k in range(len(COUNTED)):
        x, y = (F.shiftright(v, 5 * k).bitwiseAND(F.lit(31).cast("bigint")) for v in (a, b))
        d = F.abs(x - y)
        out = out + F.least(d, 32 - d)
    return out


def within_edits(a: Column, b: Column, edits: int, beginnings: bool = False) -> Column:
    """Whether the edit distance of two UTF-32 binaries is at most ``edits``: one bit a diagonal of the band.

    With ``beginnings``, whether all of ``b`` is within ``edits`` of some beginning of ``a``.

    Characters of ``b`` are taken one by one. After j of them, bit k of word e says whether
    the first j + k - edits characters of ``a`` can be turned into them with e edits at
    most. A match keeps the bits of its word; a substitution, an extra character of ``b``
    and one of ``a`` bring those of the word before, in place, one down and one up.
    """
    width = 2 * edits + 1
    mask = F.lit((1 << width) - 1).cast("bigint")
    n, m = (F.octet_length(x) / 4 for x in (a, b))
    first = F.struct(*[F.lit(((1 << (e + 1)) - 1) << edits).cast("bigint").alias(f"r{e}") for e in range(edits + 1)])

    def char(text: Column, at: Column) -> Column:
        return F.substring(text, 4 * at + 1, F.lit(4))

    def step(state: Column, j: Column) -> Column:
        now = char(b, j)
        same = F.lit(0).cast("bigint")
        for k in range(width):
            row = j + F.lit(k - edits)
            same = same + F.when((row >= 0) & (char(a, row) == now), F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        out = [state["r0"].bitwiseAND(same)]
        for e in range(1, edits + 1):
            before = state[f"r{e - 1}"]
            out.append(state[f"r{e}"].bitwiseAND(same).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(out[e - 1], 1)).bitwiseAND(mask))
        return F.struct(*[x.alias(f"r{e}") for e, x in enumerate(out)])

    def accepts(state: Column) -> Column:
        if beginnings:
            return state[f"r{edits}"] != 0
        at = (n - m).cast("int") + edits
        return (at >= 0) & (at < width) & (F.call_function("shiftright", state[f"r{edits}"], F.greatest(at, F.lit(0))).bitwiseAND(F.lit(1).cast("bigint")) == 1)

    return F.when(m == 0, F.lit(True) if beginnings else n <= edits).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(m.cast("int") - 1, F.lit(0))), first, step, accepts))


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, d1, d2, text): rows with a text; d1, d2 name it."""
    return docs.select("doc_id", "text").filter("text is not null").select("doc_id", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(1), "text").alias("d2"), "text")


NAME = ("doc_id", "d1", "d2")


def repeated_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, d1, d2, copies): ids and texts that stand in several rows, written."""
    return materialise(named(docs).groupBy(*NAME).agg(F.count("*").alias("copies")).filter("copies > 1"), "line-repeated")


def same_row(left: list[Column], right: list[Column]) -> Column:
    return left[0].eqNullSafe(right[0]) & (left[1] == right[1]) & (left[2] == right[2])


def lines_of(docs: DataFrame, repeated: DataFrame, any_repeated: bool) -> DataFrame:
    """(doc_id, d1, d2, copies, line_no, line, h1, h2): a row a line with a word; repeated rows stand once."""
    rows = named(docs)
    if any_repeated:
        of = repeated.select(*[F.col(c).alias(f"_{c}") for c in NAME], "copies")
        rows = rows.join(of, same_row([rows[c] for c in NAME], [F.col(f"_{c}") for c in NAME]), "left")
        twice = rows.filter("copies is not null").groupBy(*NAME).agg(F.first("text").alias("text"), F.first("copies").alias("copies"))
        rows = rows.filter("copies is null").select(*NAME, "text", F.lit(1).cast("bigint").alias("copies")).unionByName(twice)
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("bigint"))
    one = rows.select(*NAME, "copies", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return one.filter(F.col("line").rlike(WORD)).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def place() -> Column:
    return F.struct("doc_id", "d1", "d2", "line_no")


def line_classes(lines: DataFrame) -> DataFrame:
    """(h1, h2, line, first): each distinct line with its first place; equal lines are combined before the shuffle."""
    return lines.groupBy("h1", "h2").agg(F.first("line").alias("line"), F.min(place()).alias("first"))


def same_beginning(a: Column, b: Column, room: Column, ends: bool = False, limit: int = 20) -> Column:
    """Characters (``room`` at most, and 2**limit - 1) that two UTF-32 binaries share at their beginnings, or ends, by doubling."""

    def longer(same: Column, size: Column) -> Column:
        # counted from the end, a stretch of this size ends where the known one begins
        at = [F.octet_length(x) - 4 * (same + size) + 1 if ends else 4 * same + 1 for x in (a, b)]
        equal = (same + size <= room) & (F.substring(a, at[0], size * 4) == F.substring(b, at[1], size * 4))
        return same + F.when(equal, size).otherwise(F.lit(0))

    return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(limit))]), F.lit(0), longer)


#: Characters that the first look at a pair takes in.
GLANCE = 8
#: Lines' ids that are broadcast to pick the texts of candidates; beyond it they are joined by shuffle.
BROADCAST_IDS = 500_000


def line_links(classes: DataFrame, edits: int) -> DataFrame:
    """(a, b): pairs of classes (h1, h2) within ``edits`` edits, in both directions.

    A common beginning and end need no edits, so only what lies between them is compared:
    a few characters first, which most false candidates don't survive, then all of it.
    """
    wide = classes.select("h1", "h2", F.encode("line", "UTF-32").alias("u"), char_counts(F.col("line")).alias("counts"), F.length("line").alias("size"))
    keyed = all_keys(wide, edits)
    # dealt out once: both sides of the join read the same shuffle, as they need the same columns and no
    # condition belongs to one side alone; ``mark`` holds a line's length, the key's edits, and whether it is its own
    keyed = keyed.select("h1", "counts", (F.col("size") * 16 + F.col("edits") * 2 + F.col("k.own").cast("int")).alias("mark"), "k.key", "k.first").repartition("key")
    left = keyed.select(F.col("key").alias("key_a"), *[F.col(c).alias(f"{c}_a") for c in ("h1", "counts", "mark", "first")])
    right = keyed.select(F.col("key").alias("key_b"), *[F.col(c).alias(f"{c}_b") for c in ("h1", "counts", "mark", "first")])
    longer = F.shiftright("mark_b", 4) - F.shiftright("mark_a", 4)
    reach = F.shiftright("mark_a", 1).bitwiseAND(F.lit(7))
    # lines with the same first segment meet there alone
    once = (F.col("key_a") == F.col("first_a")) | (F.col("first_a") != F.col("first_b"))
    within = longer.between(0, reach) & (counts_apart(F.col("counts_a"), F.col("counts_b")) <= 2 * reach)
    mine = (F.col("mark_a") % 2 == 1) & (allowed(F.shiftright("mark_a", 4), edits) == reach)
    near = (F.col("h1_a") != F.col("h1_b")) & once & F.when(mine, within).otherwise(F.lit(False))
    found = left.join(right, (F.col("key_a") == F.col("key_b")) & near).select(F.least("h1_a", "h1_b").alias("a"), F.greatest("h1_a", "h1_b").alias("b")).distinct()
    candidates = materialise(found, "line-candidates")
    release(candidates)
    ids = materialise(candidates.select(F.col("a").alias("h1")).union(candidates.select("b")).distinct(), "line-ids")
    few = ids.count() <= BROADCAST_IDS
    some = classes.join(F.broadcast(ids) if few else ids, "h1", "left_semi").select("h1", "h2", F.encode("line", "UTF-32").alias("u"))
    some = materialise(some.hint("rebalance"), "line-texts")
    left = some.select(F.col("h1").alias("a"), F.struct("h1", "h2").alias("ka"), F.col("u").alias("ua"))
    right = some.select(F.col("h1").alias("b"), F.struct("h1", "h2").alias("kb"), F.col("u").alias("ub"))
    met = candidates.join(left, "a").join(right, "b").withColumn("room", (F.least(F.octet_length("ua"), F.octet_length("ub")) / 4).cast("int"))
    met = met.withColumn("head", same_beginning(F.col("ua"), F.col("ub"), F.col("room")))
    # each step is written, as a filter pushed below these columns would compute them anew at every step of its own
    ends = materialise(met.withColumn("tail", same_beginning(F.col("ua"), F.col("ub"), F.col("room") - F.col("head"), ends=True)), "line-ends")
    for done in (candidates, ids, some):
        remove(done)
    middles = materialise(ends.select("ka", "kb", allowed(F.col("room"), edits).alias("reach"), *[F.expr(f"substring({u}, 4 * head + 1, octet_length({u}) - 4 * (head + tail))").alias(u) for u in ("ua", "ub")]), "line-middles")
    remove(ends)
    glance = F.substring(F.col("ub"), F.lit(1), F.lit(4 * GLANCE))
    close = F.lit(False)
    for e in range(1, edits + 1):
        close = close | ((F.col("reach") == e) & within_edits(F.col("ua"), F.col("ub"), e))
    pairs = middles.filter(within_edits(F.col("ua"), glance, edits, beginnings=True)).filter(close).select("ka", "kb")
    out = materialise(pairs, "line-pairs")
    remove(middles)
    release(out)
    return out


def judged_lines(docs: DataFrame, edits: int) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Lines without their texts, classes without theirs but with links counted and whether an earlier class is near,
    the repeated rows, and whether there are any."""
    repeated = repeated_rows(docs)
    any_repeated = bool(repeated.head(1))
    lines = lines_of(docs, repeated, any_repeated)
    classes = materialise(line_classes(lines), "line-classes")
    release(classes)
    pairs = line_links(classes, edits)
    links = pairs.unionAll(pairs.select(F.col("kb").alias("ka"), F.col("ka").alias("kb"))).distinct()
    firsts = classes.select(F.struct("h1", "h2").alias("k"), "first")
    near = links.join(firsts.select(F.col("k").alias("kb"), F.col("first").alias("other")), "kb").groupBy("ka").agg(F.count("*").alias("n_links"), F.min("other").alias("nearest"))
    judged = firsts.join(near, firsts["k"] == near["ka"], "left").select("k.h1", "k.h2", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(F.col("nearest") < F.col("first"), F.lit(False)).alias("late"))
    judged = materialise(judged, "line-judged")
    remove(classes)
    remove(pairs)
    release(judged)
    return lines.drop("line"), judged, repeated, any_repeated


def line_verdicts(docs: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """A row a line that has a word: doc_id, line_no (from 0), class_doc_id, class_line_no (where its class
    begins), n_links (other classes within reach), kept.

    Null and empty texts have no such line. A null doc_id sorts before others. Of rows with
    one id and one text (repeated rows) one is judged as any row, and the lines of the others
    are dropped. An empty table gives an empty result; other columns are not read. Lines are
    compared whole.
    """
    lines, judged, _, any_repeated = judged_lines(docs, edits)
    kept = place().eqNullSafe(F.col("first")) & ~F.col("late")
    rows = lines.join(judged, ["h1", "h2"]).withColumn("kept", kept)
    if any_repeated:
        rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("kept", F.col("kept") & (F.col("_copy") == 1))
    return rows.select("doc_id", "line_no", F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"), "n_links", "kept")


def line_filter(docs: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """``docs`` with the dropped lines taken out of their texts, n_chars set anew where there is one.

    A document that loses every line with a word is left out, so that of repeated rows one
    stays; one that had no word stays as it is.
    """
    names = docs.columns
    at = {c: f"_c{i}" for i, c in enumerate(names)}
    lines, judged, repeated, any_repeated = judged_lines(docs, edits)
    rows = lines.join(judged, ["h1", "h2"]).filter(~(place().eqNullSafe(F.col("first")) & ~F.col("late")))
    dropped = rows.groupBy(*NAME).agg(F.collect_set("line_no").alias("_gone")).select(F.col("doc_id").alias("_d"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "_gone")
    text = F.col(at["text"])
    whole = docs.select(*[F.col(f"`{c}`").alias(at[c]) for c in names]).withColumns({"_e1": F.xxhash64(text), "_e2": F.xxhash64(F.lit(1), text)})
    row = [F.col(at["doc_id"]), F.col("_e1"), F.col("_e2")]
    if any_repeated:
        of = repeated.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(NAME)])
        marked = whole.join(of.withColumn("_twice", F.lit(True)), same_row(row, [F.col(f"_r{i}") for i in range(3)]) & text.rlike(WORD), "left").drop("_r0", "_r1", "_r2")
        alone = marked.filter("_twice is null")
        whole = alone.unionByName(marked.filter("_twice").dropDuplicates([at["doc_id"], "_e1", "_e2"])).drop("_twice")
    joined = whole.join(dropped, same_row(row, [F.col("_d"), F.col("_d1"), F.col("_d2")]), "left")
    left = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col("_gone"), i))
    new = F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(left, "\n"))
    out = joined.withColumn("_new", new).filter(F.col("_gone").isNull() | F.col("_new").rlike(WORD))
    cols = {"text": F.col("_new")} | ({"n_chars": F.when(F.col("_gone").isNull(), F.col(at["n_chars"])).otherwise(F.length("_new")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return out.select(*[cols.get(c, F.col(at[c])).alias(c) for c in names])
