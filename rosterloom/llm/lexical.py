"""Ranked lexical search: branch and bound over frequent-pattern trees of the documents.

A term is a maximal run of ASCII letters and digits and of any other non-ASCII
characters, only A-Z lower-cased.  With N documents that have a term, L terms in
all, n terms of the document, df documents with a term and tf its occurrences, a
document's score for an item sums, over the item's terms with repeats,
``w * ((10^9 * tf) div (1000 * tf + 12 * m))`` where
``w = floor(1000 * ln((2N + 2) / (2df + 1)))`` and ``m = 75 + (25 * n * N) div L``.

1. One pass restricts each document to the terms of the items: (doc_id, n,
   terms, tfs), written to the shared folder.  N, L and df are sums over it.
2. Each task takes its documents in blocks and builds a tree of each block: the
   terms of a document in order of falling df are its path, so documents share
   the nodes of their frequent terms.  Chains of one child are one node, and
   neighbouring small subtrees are one leaf.  A node knows the largest tf of
   each term and the least m below it, which bound every score below it.
3. Each item searches the tree depth first, best bound first, and leaves out
   subtrees whose bound is under its ``k``-th score, or equal to it if all ids
   below come later.  Leaves are scored exactly.
4. The best of all blocks are ranked by item.

Items are taken in passes of about ``MOST_TERMS`` terms, so what is broadcast (the
vocabulary and weights of a pass) is bounded; documents go through whole.

Nulls: a null text, of a document or an item, has no terms: it is found by none,
or finds none.  A null doc_id ranks after all others.  Repeated documents are
ranked each (in any order among rows of one id and score); repeated items, equal
in id and text, are one.  Empty tables give no rows.  Very long texts are counted
whole.  Only ``doc_id``, ``item_id`` and ``text`` are read, so extra columns
can't clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

TOP = 20
TERM_RX = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Terms of the items of one pass, about.
MOST_TERMS = 20_000
#: Documents and entries of a block at most; documents of a leaf at least; cells of a block's table of maxima, about.
BLOCK_DOCS, BLOCK_ENTRIES, LEAF, CELLS = 16_384, 1_500_000, 64, 1 << 22


def terms_of(text: str) -> list[bytes]:
    return TERM.findall(text.encode().lower())  # bytes know A-Z only


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What each occurrence of a term in an item adds, for weight 1."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Tree:
    """The tree of a block.  ``ids`` is ascending in the order that breaks ties."""

    def __init__(self, m: np.ndarray, ids: np.ndarray, offsets: np.ndarray, terms: np.ndarray, tfs: np.ndarray, size: int, leaf: int = LEAF):
        counts = np.diff(offsets)
        order = np.lexsort((terms, np.repeat(np.arange(len(m)), counts)))  # the most frequent terms first
        terms, tfs = terms[order], tfs[order]
        path = terms.astype(">u4").tobytes()
        docs = np.array(sorted(range(len(m)), key=lambda i: path[4 * offsets[i] : 4 * offsets[i + 1]]), np.int64)
        self.docs, self.m, self.ids, counts = docs, m[docs], ids[docs], counts[docs]
        self.offsets = np.concatenate([[0], np.cumsum(counts)])
        moved = np.repeat(offsets[:-1][docs] - self.offsets[:-1], counts) + np.arange(self.offsets[-1])
        self.terms, self.tfs = terms[moved], tfs[moved]
        self.parts = part(self.tfs, np.repeat(self.m, counts))
        self.size = size
        self.lo: list[int] = []
        self.hi: list[int] = []
        self.children: list[tuple[int, int]] = []
        self._grow(max(leaf, 2 * len(m) * size // CELLS))
        self._bound()

    def _split(self, lo: int, hi: int, depth: int) -> tuple[int, np.ndarray]:
        """The depth at which the paths of documents lo to hi part, and where each branch begins; no branch if they are equal."""
        while True:
            at = self.offsets[lo:hi] + depth
            inside = at < self.offsets[lo + 1 : hi + 1]
            if not inside.any():
                return depth, np.zeros(0, np.int64)
            here = np.where(inside, self.terms[np.minimum(at, len(self.terms) - 1)], -1)
            cuts = np.flatnonzero(here[1:] != here[:-1]) + 1
            if len(cuts):
                return depth, np.concatenate([[lo], lo + cuts, [hi]])
            depth += 1

    def _node(self, lo: int, hi: int) -> int:
        self.lo.append(lo), self.hi.append(hi), self.children.append((0, 0))
        return len(self.lo) - 1

    def _grow(self, leaf: int) -> None:
        todo = [(self._node(0, len(self.m)), 0)]
        while todo:
            node, depth = todo.pop()
            lo, hi = self.lo[node], self.hi[node]
            if hi - lo <= leaf:
                continue
            depth, cuts = self._split(lo, hi, depth)
            if not len(cuts):
                continue
            first, begin, made = len(self.lo), lo, []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                # branches that fill no leaf are put together with their neighbours
                if b - begin > leaf:
                    if a > begin:
                        made.append((begin, a, depth))
                    begin = a
                    if b - a > leaf:
                        made.append((a, b, depth + 1))
                        begin = b
            if hi > begin:
                made.append((begin, hi, depth))
            for a, b, d in made:
                todo.append((self._node(a, b), d))
            self.children[node] = (first, len(self.lo))

    def _bound(self) -> None:
        n = len(self.lo)
        most = np.zeros((n, self.size), np.int64)
        self.least_m, self.least_id = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for node in range(n - 1, -1, -1):  # children come after their parent
            (a, b), lo, hi = self.children[node], self.lo[node], self.hi[node]
            if a == b:
                e0, e1 = self.offsets[lo], self.offsets[hi]
                np.maximum.at(most[node], self.terms[e0:e1], self.tfs[e0:e1])
            else:
                most[node] = most[a:b].max(axis=0)
            self.least_m[node], self.least_id[node] = self.m[lo:hi].min(), self.ids[lo:hi].min()
        self.most = np.empty((n, self.size), np.int32)
        for a in range(0, n, 64):
            self.most[a : a + 64] = part(most[a : a + 64], self.least_m[a : a + 64, None])

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int = TOP) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the ``k`` best of the block above 0, best first."""
        dense = np.zeros(self.size, np.int64)
        dense[terms] = weights
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        floor, last = 1, -1  # the score to reach, and the id to come before if it is just reached
        todo = [(int(self.most[0, terms] @ weights), 0)]
        while todo:
            bound, node = todo.pop()
            if bound < floor or (bound == floor and 0 <= last < self.least_id[node]):
                continue
            a, b = self.children[node]
            if a < b:
                bounds = self.most[a:b, terms] @ weights
                order = np.argsort(bounds, kind="stable")
                todo.extend(zip(bounds[order].tolist(), (order + a).tolist(), strict=True))
                continue
            lo, hi = self.lo[node], self.hi[node]
            e0, e1 = self.offsets[lo], self.offsets[hi]
            own = np.add.reduceat(dense[self.terms[e0:e1]] * self.parts[e0:e1], self.offsets[lo:hi] - e0)
            good = np.flatnonzero(own >= floor)
            if len(good):
                docs, scores = np.concatenate([docs, lo + good]), np.concatenate([scores, own[good]])
                best = np.lexsort((self.ids[docs], -scores))[:k]
                docs, scores = docs[best], scores[best]
                if len(docs) == k:
                    floor, last = int(scores[-1]), int(self.ids[docs[-1]])
        return self.docs[docs], scores


def restricted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents with a term: their terms of the vocabulary by number."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by a pass

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            rows, sizes, terms, tfs = [], [], [], []
            for k, text in enumerate(batch.column(1)):
                found = terms_of(text.as_py())
                if found:
                    counts = Counter(filter(lambda t: t is not None, map(number, found)))
                    rows.append(k), sizes.append(len(found)), terms.append(list(counts)), tfs.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.filter("text is not null").select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, docs, entries = [], 0, 0
    for batch in batches:
        more = pc.sum(pc.list_value_length(batch.column("terms"))).as_py() or 0
        if held and (docs + batch.num_rows > BLOCK_DOCS or entries + more > BLOCK_ENTRIES):
            yield pa.Table.from_batches(held).combine_chunks()
            held, docs, entries = [], 0, 0
        held.append(batch)
        docs, entries = docs + batch.num_rows, entries + more
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _best(vectors: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], place: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the best ``k`` of each block for each query."""
    shared = vectors.sparkSession.sparkContext.broadcast((queries, place))  # bounded by a pass

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, place = shared.value
        for block in _blocks(batches):
            ids, lists = block.column("doc_id").combine_chunks(), block.column("terms").combine_chunks()
            order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
            ties = np.empty(len(ids), np.int64)
            ties[order] = np.arange(len(ids))
            m = 75 + (25 * block.column("n").to_numpy().astype(np.int64) * n_docs) // n_terms
            offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
            tree = Tree(m, ties, offsets, place[lists.flatten().to_numpy()], block.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64), len(place))
            for item, (terms, weights) in enumerate(queries):
                found, scores = tree.search(terms, weights, k)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), item, np.int32)), ids.take(pa.array(found)), pa.array(scores)], names=["item", "doc_id", "score"])

    kind = vectors.schema["doc_id"].dataType.simpleString()
    return vectors.filter("size(terms) > 0").mapInArrow(run, f"item int, doc_id {kind}, score long")


def _pass(docs: DataFrame, items: pa.Table, kind: str, k: int) -> DataFrame | None:
    """The answers to the items of one pass."""
    spark = docs.sparkSession
    counts = [Counter(terms_of(t)) for t in items.column("text").to_pylist()]
    vocabulary = {t: v for v, t in enumerate(sorted({t for c in counts for t in c}))}
    if not vocabulary:
        return None
    vectors = stored(restricted(docs, vocabulary), "vectors")
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # a row for each term of the pass at most
        df[term] = n
    place = np.empty(len(df), np.int64)
    place[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    queries = []
    for c in counts:
        own = np.array([vocabulary[t] for t in c], np.int64)
        w = weight[own] * np.array(list(c.values()), np.int64)
        held = (w > 0) & (df[own] > 0)
        queries.append((place[own[held]], w[held]))
    best = _best(vectors, queries, place, n_docs, n_terms, k)
    ids = spark.createDataFrame([(i, x) for i, x in enumerate(items.column("item_id").to_pylist())], f"item int, item_id {kind}")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")  # a pass of items is bounded


def search(docs: DataFrame, items: DataFrame, k: int = TOP, most_terms: int = MOST_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each item (item_id, text), ties by ascending doc_id."""
    asked = items.filter("text is not null").select("item_id", F.col("text").cast("string").alias("text")).distinct()
    asked = asked.withColumn("_n", F.regexp_count("text", F.lit(TERM_RX)))
    total = asked.agg(F.sum("_n")).first()[0] or 0
    passes = max(1, -(-total // most_terms))
    kind = items.schema["item_id"].dataType.simpleString()
    found = []
    for p in range(passes):
        own = asked.filter((F.col("_n") > 0) & (F.pmod(F.xxhash64("text"), F.lit(passes)) == p)).select("item_id", "text").toArrow()
        answers = _pass(docs, own, kind, k) if own.num_rows else None
        if answers is not None:
            found.append(answers)
    if not found:
        found = [docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")]
    return reduce(DataFrame.unionByName, found)
