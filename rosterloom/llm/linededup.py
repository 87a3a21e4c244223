"""Line dedup over a distributed suffix array of line ids.

A *run* is a sequence of consecutive lines of one document.  A run of at least
``min_words`` words that occurs more than once is kept where it occurs first
(in order of doc_id, then of the text's hash, then of place) and deleted at all
later occurrences.

1. Each line gets an id (a 128-bit hash, as two numbers).  Lines that occur once can't be part of
   a repeated run; their suffixes leave the suffix array at once.
2. The rank of a suffix by its first line is the number of suffixes with a
   lower id.  Prefix doubling makes ranks by the first 2, 4, 8, ... lines: the
   pair (own rank, rank ``2^k`` lines on) is counted, the pairs of each rank are
   put in order, and running counts give the new ranks.  A pair that occurs
   once leaves the array.  Running counts go over blocks of ranks, so no rank,
   however frequent its line, needs one task.
3. Suffixes that share their first ``m`` lines form an interval of the suffix
   array with a common prefix of ``m`` lines or more: those with the same ranks
   at their start and at ``m - 2^k`` lines on.  The intervals wanted are at the
   least ``m`` that holds ``min_words`` words, counted from the start of a run
   forwards and from its end backwards.  Every maximal repeated run is the union
   of such windows, so marking the windows of all but the first occurrence in
   each interval deletes exactly the later copies.  Doubling stops at the
   longest window.

Nulls: a null text has no lines and stays null; a null doc_id is less than any
other, and rows of null doc_id and one text are one document.  A doc_id may have
any type that has an order.  Lines without a word are not part of runs; one goes
if the next lines with words on both sides go.  Rows equal in doc_id and text
are one document: each gets the same result.  A very long text is a row per line
like any other; only its own lines, and its own deletions, meet in one task.
Repeated rows of one document give its suffixes once, whatever their number.  An
empty table gives an empty result.  Extra columns are kept; one with the name of
a computed column gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, protected, scratch, stored

MIN_WORDS = 20
BLOCKS = 1024
MASK = (1 << 64) - 1
#: The two halves of a line's id.
LINE = ["line", "line_low"]
COMPUTED = ("lines_removed", "words_removed")


def windows_of(counts: np.ndarray, min_words: int) -> list[list[int]]:
    """For each line the lengths of the least windows of ``min_words`` words that start there.

    A window is the least from its first line on, or the least up to its last line.
    """
    n = len(counts)
    sums = np.concatenate([[0], np.cumsum(counts)])
    found: list[list[int]] = [[] for _ in range(n)]
    end = np.searchsorted(sums, sums[:-1] + min_words)  # the first place after the window
    start = np.searchsorted(sums, sums[1:] - min_words, side="right") - 1
    for i in range(n):
        if end[i] <= n:
            found[i].append(int(end[i]) - i)
    for e in range(n):
        s = int(start[e])
        if s >= 0 and (e + 1 - s) not in found[s]:
            found[s].append(e + 1 - s)
    return found


def full_lines(text: str) -> list[str]:
    """The lines with a word."""
    return [x for x in text.split("\n") if x.strip(SPACE)]


def n_words(line: str) -> int:
    """The number of words of a line: runs between space and the ASCII controls from tab to carriage return."""
    return len(line.encode().split())  # bytes know the ASCII spaces only


def without(text: str, runs: list[dict]) -> tuple[str, int, int]:
    """The text without the runs of its full lines; the lines and words that go."""
    lines = text.split("\n")
    full = np.array([bool(x.strip(SPACE)) for x in lines])
    gone = np.zeros(int(full.sum()), bool)
    for r in runs:
        gone[r["start"] : r["start"] + r["length"]] = True
    before = np.cumsum(full)  # full lines up to each line
    beside = np.concatenate([[False], gone, [False]])
    drop = np.where(full, beside[before], beside[before] & beside[np.minimum(before + 1, len(beside) - 1)])
    words = sum(n_words(x) for x, d in zip(lines, drop, strict=True) if d)
    return "\n".join(x for x, d in zip(lines, drop, strict=True) if not d), int(drop.sum()), words


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """A row per line: its id and the windows that start there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            own, pos, high, low, wins = [], [], [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                lines = full_lines(text)
                own += [k] * len(lines)
                pos += range(len(lines))
                for x in lines:
                    h = xxhash.xxh128_intdigest(x.encode())
                    high.append((h >> 64) - (1 << 63))
                    low.append((h & MASK) - (1 << 63))
                wins += windows_of(np.array([n_words(x) for x in lines]), min_words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at := pa.array(own, pa.int64())), batch.column(1).take(at), pa.array(pos, pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(wins, pa.list_(pa.int32()))],
                names=["doc_id", "tie", "pos", *LINE, "windows"],
            )

    keyed = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("tie"), "text")
    return keyed.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tie long, pos int, line long, line_low long, windows array<int>")


def _ranked(classes: DataFrame, group: list[str], block, order: list[str], base) -> DataFrame:
    """``classes`` (with count ``c``) with ``rank``: ``base`` plus the counts of the classes before it in its group.

    Blocks follow the order, so the running count goes first over the blocks of
    a group (bounded), then inside a block.
    """
    rows = classes.withColumn("_block", block)
    sums = rows.groupBy(*group, "_block").agg(F.sum("c").alias("s"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "_block", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_before"))
    rows = rows.join(sums, [*group, "_block"]) if group else rows.join(sums, "_block")
    inside = Window.partitionBy(*group, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("rank", base + F.col("_before") + F.coalesce(F.sum("c").over(inside), F.lit(0))).drop("_block", "_before")


def first_ranks(lines: DataFrame) -> DataFrame:
    """(doc_id, tie, pos, windows, rank) of the suffixes whose first line occurs again, once for all repeated rows of a document."""
    classes = lines.groupBy(*LINE).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    # ids are hashes: their leading bits cut them in even blocks
    ranked = _ranked(classes, [], F.shiftright("line", 54), LINE, F.lit(0))
    found = lines.join(ranked.select(*LINE, "rank"), LINE)
    # copies of a row are merged before the shuffle, so that they never meet in the task of their document
    return found.groupBy("doc_id", "tie", "pos", "rank").agg(F.first("windows").alias("windows")).select("doc_id", "tie", "pos", "windows", "rank")


def doubled(suffixes: DataFrame, step: int, total: int) -> DataFrame:
    """Ranks by twice as many lines: from those by ``step`` lines."""
    ahead = Window.partitionBy("doc_id", "tie").orderBy("pos").rangeBetween(step, step)
    pairs = suffixes.withColumn("next", F.first("rank").over(ahead)).filter("next is not null")
    classes = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    block = F.floor(F.col("next") * BLOCKS / F.lit(max(1, total))).cast("int")
    ranked = _ranked(classes.withColumnRenamed("rank", "own"), ["own"], block, ["next"], F.col("own"))
    joined = pairs.withColumnRenamed("rank", "own").join(ranked.select("own", "next", "rank"), ["own", "next"])
    return joined.select("doc_id", "tie", "pos", "windows", "rank")


def later_copies(suffixes: DataFrame, k: int) -> DataFrame:
    """(doc_id, tie, start, length) of windows of 2^k to 2^(k+1) - 1 lines that are not the first of their interval."""
    low = 1 << k
    wins = suffixes.select("doc_id", "tie", "pos", "rank", F.explode("windows").alias("m")).filter(F.col("m").between(low, 2 * low - 1))
    if k:
        # a null doc_id must meet itself; rows of one document have equal ranks, so one of them is enough
        key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("doc_id").isNull().alias("_no_id"), "tie"]
        ends = suffixes.groupBy(*key, F.col("pos").alias("at")).agg(F.first("rank").alias("last"))
        wins = wins.select("*", *key[:2], (F.col("pos") + F.col("m") - low).alias("at")).join(ends, ["_id", "_no_id", "tie", "at"])
    else:
        wins = wins.withColumn("last", F.col("rank"))
    place = F.struct("doc_id", "tie", "pos")
    first = wins.groupBy("rank", "last", "m").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    return wins.join(first, ["rank", "last", "m"]).filter(place != F.col("first")).select("doc_id", "tie", F.col("pos").alias("start"), F.col("m").alias("length"))


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, tie, runs): for each document with later copies the array of (start, length)."""
    lines = stored(lines_of(docs, min_words), "lines")
    suffixes = stored(first_ranks(lines), "suffixes-1")
    longest, total = suffixes.agg(F.max(F.array_max("windows")), F.max("rank")).first()
    k, found = 0, later_copies(suffixes, 0)
    while longest is not None and (2 << k) <= longest:
        suffixes = stored(doubled(suffixes, 1 << k, total), f"suffixes-{2 << k}")
        k += 1
        longest = suffixes.agg(F.max(F.array_max("windows"))).first()[0]
        found = found.unionByName(later_copies(suffixes, k))
    return found.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "length")).alias("runs"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later copies of runs, with lines_removed and words_removed.

    ``n_chars`` follows the new text where the table has it.
    """
    return protected(docs, ("doc_id", "text", "n_chars"), lambda d: _dedup(d, min_words))


def _dedup(docs: DataFrame, min_words: int) -> DataFrame:
    with scratch(docs.sparkSession):
        runs = stored(deletions(docs, min_words), "runs", keep=True)
    runs = runs.select(F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie"), F.col("runs").alias("_runs"))
    # one kind of join for every size: a broadcast of few runs would not hold for many
    joined = docs.join(runs.hint("merge"), (F.col("doc_id").eqNullSafe(F.col("_doc"))) & (F.xxhash64("text") == F.col("_tie")), "left")
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["lines_removed int", "words_removed int"])
    names = docs.columns
    at_text, at_chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:-1])
            texts, chars = columns[at_text].to_pylist(), columns[at_chars].to_pylist() if at_chars is not None else None
            n_lines, n_words = [0] * len(texts), [0] * len(texts)
            for i, rs in enumerate(batch.columns[-1].to_pylist()):
                if rs:
                    texts[i], n_lines[i], n_words[i] = without(texts[i], rs)
                    if chars is not None:
                        chars[i] = len(texts[i])
            columns[at_text] = pa.array(texts, pa.string())
            if chars is not None:
                columns[at_chars] = pa.array(chars, batch.columns[at_chars].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int32()), pa.array(n_words, pa.int32())], names=[*names, *COMPUTED])

    return joined.select(*names, "_runs").mapInArrow(run, kinds)
