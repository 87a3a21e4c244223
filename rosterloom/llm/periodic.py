"""Runs of periodic words by enumeration of maximal pairs.

A *run* is a stretch of consecutive words with smallest period q (words q apart
are identical) that no neighbouring word extends, of at least ``min_words``
words and at least two periods.

1. The words of a batch of texts become numbers.  Prefix doubling ranks their
   suffixes by 1, 2, 4, ... words, never across texts; a suffix whose rank is
   its own leaves the work, so texts without repeats cost two rounds.
2. The common prefixes of neighbours in the suffix array come from the ranks of
   all rounds, longest round first.
3. The tree of intervals of the suffix array is walked bottom-up.  An interval
   with a common prefix of m words holds its places by their left words.  Two
   places i < j from different children that have different left words are a
   maximal pair: the m words at both can be extended neither to the left nor to
   the right.  If their distance d is at most m and m + d is at least
   ``min_words``, then words i to j + m - 1 are exactly a run with period d.
   The class lists of an interval are kept as one list in order of place, with
   the left word of each place at hand: the first d words of a run are
   primitive, so they occur nowhere between i and i + d, and i + d is the next
   place of i in that list.  A place therefore meets two others instead of one
   of each class, and no pair is enumerated that isn't checked in constant time.

Nulls: a null text has no words, hence no runs and a collapsed text of "".
Words are runs of characters between space and the ASCII controls from tab to
carriage return.  Other columns may be null; repeated rows get equal results.
An empty table gives no rows.  A very long text is one row of one task, with
some 100 bytes for each word while it is worked on; batches hold few long texts.
Extra columns are kept, the text is not; one with the name of a computed column
gives way to it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import protected

MIN_WORDS = 12
#: Bytes of text that are ranked together, unless one text has more.
BATCH = 4 << 20
COMPUTED = ("n_words", "runs", "collapsed")
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def ranked(codes: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in order of their suffixes, common prefix with the place before) of the suffixes that share ``least`` words or more.

    ``codes`` are the words; ``ends`` gives the end of the text for each place.
    """
    n = len(codes)
    places, size, levels = np.arange(n), 1, []
    order = np.lexsort((codes, ends))
    new = np.ones(n, bool)
    new[1:] = (codes[order[1:]] != codes[order[:-1]]) | (ends[order[1:]] != ends[order[:-1]])
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    levels.append(rank)
    shared = np.zeros(n, bool)
    shared[order] = ~new | ~np.append(new[1:], True)
    active = places[shared]
    held = active
    while len(active):
        ahead = active + size
        second = np.where(ahead < ends[active], rank[np.minimum(ahead, n - 1)], -1)
        own = rank[active]
        order = np.lexsort((second, own))
        active, own, second = active[order], own[order], second[order]
        group = np.ones(len(active), bool)
        group[1:] = own[1:] != own[:-1]
        new = group.copy()
        new[1:] |= second[1:] != second[:-1]
        head = np.flatnonzero(group)
        before = np.arange(len(active)) - np.repeat(head, np.diff(np.append(head, len(active))))
        first = np.flatnonzero(new)
        rank = rank.copy()
        rank[active] = np.repeat(own[first] + before[first], np.diff(np.append(first, len(active))))
        levels.append(rank)
        size *= 2
        active = active[~new | ~np.append(new[1:], True)]
        if size <= least:
            held = active
    held = held[np.argsort(rank[held], kind="stable")]
    common = np.zeros(len(held), np.int64)
    if len(held):
        a, b = held[:-1].copy(), held[1:].copy()
        for k in range(len(levels) - 1, -1, -1):
            inside = (a < n) & (b < n)
            same = np.zeros(len(a), bool)
            same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            common[1:] += same << k
            a, b = a + (same << k), b + (same << k)
    return held, common


def maximal_pairs(places: np.ndarray, common: np.ndarray, left: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal pairs at most as far apart as their common words, of ``least`` words together."""
    found: list[tuple[int, int, int]] = []
    shortest = (least + 1) // 2  # distance + common words >= least, and distance <= common words
    stack: list[tuple[int, list[list[int]]]] = [(0, [])]

    def pair(i: int, j: int, m: int) -> None:
        if j - i <= m and j - i + m >= least and left[i] != left[j]:
            found.append((i, j - i + m, j - i))

    def closed(m: int, children: list[list[int]]) -> list[int]:
        children.sort(key=len)
        whole = children.pop()
        if m < shortest:
            return []
        if len(children) == 1 and len(children[0]) == 1:
            i = children[0][0]
            at = bisect_left(whole, i)
            if at:
                pair(whole[at - 1], i, m)
            if at < len(whole):
                pair(i, whole[at], m)
            whole.insert(at, i)
            return whole
        own = {i: k for k, child in enumerate(children) for i in child}
        if len(own) > 8:
            whole = sorted([*whole, *own])
        else:
            for i in own:
                insort(whole, i)
        for i, k in own.items():
            at = bisect_left(whole, i)
            if at and own.get(whole[at - 1]) is None:
                pair(whole[at - 1], i, m)
            if at + 1 < len(whole) and own.get(whole[at + 1], -1) != k:
                pair(i, whole[at + 1], m)
        return whole

    at = places.tolist()
    heights = common.tolist()
    for k, i in enumerate(at):
        m = heights[k] if k else 0
        child = [at[k - 1]] if k else []
        while stack[-1][0] > m:
            top, children = stack.pop()
            child = closed(top, [*children, child])
        if child and stack[-1][0] == m:
            if m >= shortest:
                stack[-1][1].append(child)
        elif child:
            stack.append((m, [child]))
    if at:
        child = [at[-1]]
        while stack[-1][0] > 0:
            top, children = stack.pop()
            child = closed(top, [*children, child])
    return found


def runs_of(words: pa.Array, sizes: np.ndarray, least: int) -> dict[int, list[tuple[int, int, int]]]:
    """Text number to its runs (start, length, period), in order; ``words`` of all texts, ``sizes`` of each."""
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    places, common = ranked(codes, np.repeat(bounds[1:], sizes), max(1, (least + 1) // 2))
    left = np.concatenate([[-1], codes[:-1]])
    starts = bounds[:-1][sizes > 0]
    left[starts] = -1 - np.arange(len(starts))  # no left word: unlike all others
    found: dict[int, list] = {}
    for start, length, period in sorted(maximal_pairs(places, common, left, least)):
        text = int(np.searchsorted(bounds, start, side="right")) - 1
        own = found.setdefault(text, [])
        if not own or own[-1][:2] != (start - bounds[text], length):  # the least period comes first
            own.append((int(start - bounds[text]), length, period))
    return found


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of ``n`` words lies in a run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) > 0


def _slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for k, x in enumerate(lengths.tolist()):
        if k > begin and held + x > most:
            yield begin, k
            begin, held = k, 0
        held += x
    if begin < len(lengths):
        yield begin, len(lengths)


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without their text, with n_words, runs (start, length, period by start), and collapsed: the words outside later periods of runs, joined by a space."""

    def step(d: DataFrame) -> DataFrame:
        others = [c for c in d.columns if c != "text"]
        rows = d.select(F.struct(*others).alias("_doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        kind = rows.schema["_doc"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(1).cast(pa.large_string())
                for begin, end in _slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), BATCH):
                    lists = pc.ascii_split_whitespace(texts.slice(begin, end - begin))
                    words, parents = lists.flatten(), pc.list_parent_indices(lists)
                    real = pc.not_equal(words, "")
                    words, parents = words.filter(real), parents.filter(real).to_numpy(zero_copy_only=False)
                    sizes = np.bincount(parents, minlength=end - begin)
                    bounds = np.concatenate([[0], np.cumsum(sizes)])
                    found = runs_of(words, sizes, min_words)
                    keep = np.ones(len(words), bool)
                    for k, own in found.items():
                        keep[bounds[k] : bounds[k + 1]] = ~dropped(int(sizes[k]), own)
                    kept = np.concatenate([[0], np.cumsum(np.bincount(parents[keep], minlength=end - begin))])
                    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(kept, pa.int64()), words.filter(pa.array(keep))), pa.scalar(" ", pa.large_string())).cast(pa.string())
                    runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in found.get(k, ())] for k in range(end - begin)], pa.list_(RUN))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(sizes, pa.int64()), runs, collapsed], names=["_doc", *COMPUTED])

        made = rows.mapInArrow(run, f"_doc {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
        return made.select("_doc.*", *COMPUTED)

    return protected(docs, ("doc_id", "text"), step)


def with_loops(docs: DataFrame) -> DataFrame:
    """The documents (doc_id, text) with a loop planted in one of ten, by the CRC-32 of the id.

    With h of the id, g = floor(h / 10), n words: if h % 10 = 0 and n > 0, word
    i >= a becomes word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    """
    words = F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+", -1)
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.withColumn("_g", F.floor(h / 10)).withColumn("_w", F.when((h % 10 == 0) & F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), words))
    n = F.size("_w")
    a = (F.col("_g") % n).cast("int")
    cut = chosen.withColumn("_a", a).withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    loop = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_w", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    return cut.withColumn("text", F.when(F.col("_w").isNotNull(), F.array_join(loop, " ")).otherwise(F.col("text"))).drop("_g", "_w", "_a", "_p")
