"""N-gram Jaccard join by the chosen-path method.

Sets are the word 5-shingles of whole texts (a text of one to four words has
one shingle, all its words).  Two texts are linked if the Jaccard similarity of
their sets is ``THRESHOLD`` or more.

1. Each text's set is hashed; texts with equal sets share one *node* (copies
   are never expanded).  A node has ``TOKENS`` sampled tokens: for each of as
   many hash functions the least shingle of the set.
2. Chosen path: a run starts with a few of the sampled tokens; nodes that share
   a token meet in a bucket.  A bucket of over ``LIMIT`` nodes is split again by
   tokens chosen by a hash of its path, unless over half of it came from its
   parent together (then its nodes are alike and splitting can't part them).
   Runs are repeated until a pair at the threshold meets with the chance
   ``RECALL``: each split lets it slip, so ``missed`` takes the deepest split
   that the data brought about.
3. Buckets are compared by brute force in blocks of about ``BLOCK`` nodes and
   ``BLOCK_SHINGLES`` shingles, so that a bucket of any size, and of texts of any
   length, is spread over tasks and no task holds more than two blocks.  Sampled tokens rule pairs out; a pair that meets in several buckets
   counts in the least of them only.
4. Nodes with a candidate fetch their exact sets, and the same blocks count
   exact intersections.  A block returns for each node the number of texts
   linked to it, and a spanning forest of the links: no list of pairs is ever
   made.  Components of the forest are the classes.

Nulls: null and empty texts have no shingle; each is a class of its own without
links.  A null doc_id is less than any other, so a class with one has it as its
class_id.  Rows equal in doc_id and text are each returned, with equal values.  An
empty table gives an empty result.  A doc_id may have any type that has an order;
extra columns are not read.  A very long text is one set, held by one task at a
time with few others; it is compared like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import protected, scratch, stored

SHINGLE = 5
THRESHOLD = 0.8
TOKENS = 64
#: Runs at first; then so many more at a time, until a pair at the threshold meets with the chance RECALL.
RUNS, MORE = 10, 2
RECALL = 0.9999
#: Tokens chosen of a bucket that is split: two of TOKENS on average, so that a pair at the threshold more than survives each split.
SPLIT = 2.0
DEPTH = 4
LIMIT = 1000
BLOCK = 512
#: Shingles of a block: 16 MB of exact sets.
BLOCK_SHINGLES = 2_000_000
#: Equal sampled tokens under which a pair is ruled out: of pairs at the threshold 2e-8 have fewer, below what the buckets miss.
LEAST_EQUAL = 32
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def missed(similarity: float, runs: int = RUNS, splits: int = 0) -> float:
    """The chance that a pair of this similarity meets in no bucket, if all that it meets in are split so many times.

    Of a pair that meets in a bucket each sampled token is chosen for the next
    step with the chance SPLIT / TOKENS, and is shared with that of similarity.
    """
    met = 1.0
    for _ in range(splits):
        met = 1 - (1 - SPLIT / TOKENS * similarity * met) ** TOKENS
    return (1 - similarity * met) ** runs


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """All sets one after the other, each sorted, and the places where they start (and the end)."""
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    split = pc.ascii_split_whitespace(texts)
    offsets = np.asarray(split.offsets, dtype=np.int64)
    offsets, flat = offsets - offsets[0], split.flatten()
    encoded = flat.dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w.encode()) if w else 0 for w in encoded.dictionary.to_pylist()], dtype=np.uint64)
    h = known[encoded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
    n = offsets[1:] - offsets[:-1]
    n = np.where((n == 1) & (np.array([h[o] == 0 if o < len(h) else True for o in offsets[:-1]])), 0, n)  # "" splits in one empty word
    owner, value = [], []
    doc = np.repeat(np.arange(len(n)), offsets[1:] - offsets[:-1])
    with np.errstate(over="ignore"):
        if len(h) >= size:
            s = np.zeros(len(h) - size + 1, dtype=np.uint64)
            for k in range(size):
                s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k]
            whole = doc[: len(s)] == doc[size - 1 :]
            owner.append(doc[: len(s)][whole])
            value.append(_mix(s[whole]))
        for d in np.flatnonzero((n > 0) & (n < size)):
            s = np.uint64(n[d])
            for x in h[offsets[d] : offsets[d + 1]]:
                s = s * np.uint64(0x9E3779B97F4A7C15) + x
            owner.append(np.array([d]))
            value.append(_mix(np.array([s], dtype=np.uint64)))
    owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    value = np.concatenate(value) if value else np.zeros(0, np.uint64)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(len(n) + 1))


def sampled_tokens(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each set and hash function 32 bits of the least hashed shingle (0 for empty sets)."""
    full = np.flatnonzero(starts[1:] > starts[:-1])
    out = np.zeros((len(starts) - 1, TOKENS), dtype=np.uint32)
    if len(full):
        with np.errstate(over="ignore"):
            for t in range(TOKENS):
                v = ((value * _SEEDS[t]) >> np.uint64(32)).astype(np.uint32)
                out[full, t] = np.minimum.reduceat(v, starts[full])
    return out


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, text_id, node, n, tokens) of each document; node is null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            value, starts = shingle_sets(batch.column(2))
            tokens = sampled_tokens(value, starts)
            n = np.diff(starts)
            nodes = [xxhash.xxh3_128_digest(value[a:b].tobytes()) if b > a else None for a, b in zip(starts[:-1], starts[1:], strict=True)]
            ids = [xxhash.xxh3_128_digest((t or "").encode()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(nodes, pa.binary()), pa.array(n, pa.int32()), pa.array([t.tobytes() for t in tokens], pa.binary())],
                names=["doc_id", "tie", "text_id", "node", "n", "tokens"],
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tie long, text_id binary, node binary, n int, tokens binary")


def _chosen(path: np.ndarray, rate: float) -> np.ndarray:
    """Which of the TOKENS places each path chooses: by a hash that all nodes of the bucket share."""
    with np.errstate(over="ignore"):
        h = _mix(path[:, None] ^ _mix(np.arange(TOKENS, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(17)))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53) < rate


def _paths(path: np.ndarray, place: np.ndarray, token: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(_mix(path * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)) + token.astype(np.uint64))


def split(rows: DataFrame, runs: range | None = None) -> DataFrame:
    """(node, tokens, n[, path, size]) → (path, node, n, parent_size): the buckets one step further; at the start those of the given runs."""
    first = runs is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(-1, TOKENS)
            nodes = batch.column(0)
            if first:
                at = np.repeat(np.arange(len(tokens)), len(runs))
                place = np.tile(np.array(runs), len(tokens))  # a run starts with one token, as good as chosen at random
                path = np.zeros(len(at), np.uint64)
            else:
                own = batch.column(3).to_numpy().astype(np.int64).view(np.uint64)
                at, place = np.nonzero(_chosen(own, SPLIT / TOKENS))
                path = own[at]
            new = _paths(path, place, tokens[at, place])
            columns = [pa.array(new.view(np.int64)), nodes.take(pa.array(at)), batch.column(2).take(pa.array(at))]
            names = ["path", "node", "n"]
            if not first:
                columns.append(batch.column(4).take(pa.array(at)))
                names.append("parent_size")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    if first:
        return rows.select("node", "tokens", "n").mapInArrow(run, "path long, node binary, n int").withColumn("parent_size", F.lit(1 << 60).cast("long"))
    return rows.select("node", "tokens", "n", "path", "size").mapInArrow(run, "path long, node binary, n int, parent_size long").dropDuplicates(["path", "node"])


def buckets(nodes: DataFrame) -> DataFrame:
    """(path, node, size, shingles): the buckets of two nodes or more that are compared by brute force."""
    out, splits = _run(nodes, range(RUNS))
    done = RUNS
    while missed(THRESHOLD, done, splits) > 1 - RECALL and done < TOKENS:
        more, deeper = _run(nodes, range(done, min(TOKENS, done + MORE)))
        out, splits, done = out.unionByName(more), max(splits, deeper), done + MORE
    if missed(THRESHOLD, done, splits) > 1 - RECALL:
        raise RuntimeError(f"the {TOKENS} sampled tokens don't reach the recall {RECALL} after {splits} splits: draw more")
    return out


def _run(nodes: DataFrame, runs: range) -> tuple[DataFrame, int]:
    """The buckets of these runs, and how often the most divided were split."""
    level, out = split(nodes, runs), None
    for depth in range(1, DEPTH + 1):
        sizes = level.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")).filter("size > 1")
        level = stored(level.join(sizes, "path"), f"buckets-{depth}")
        last = F.lit(depth == DEPTH) | (F.col("size") <= LIMIT) | (F.col("size") * 2 > F.col("parent_size"))
        leaf = level.filter(last).select("path", "node", "size", "shingles")
        out = leaf if out is None else out.unionByName(leaf)
        big = level.filter(~last)
        if depth == DEPTH or big.isEmpty():
            break
        level = split(big.join(nodes.select("node", "tokens"), "node"))
    return out, depth - 1


def _cells(rows: DataFrame) -> DataFrame:
    """Deal the nodes of each bucket to blocks, and each block to its pairs of blocks: (path, a, b, side) are the cells."""
    n = F.ceil(F.least(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES), F.col("size"))).cast("int")
    own = F.pmod(F.xxhash64("node", "path"), n).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda o: F.struct(F.least(own, o).alias("a"), F.greatest(own, o).alias("b"), F.when(own <= o, 0).otherwise(1).alias("side")),
    )
    return rows.select("*", F.inline(pairs))


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows that are equal in the first columns, of batches sorted by them."""
    rest: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(int(c[a]) for c in cols)
            if now is not None and key != now:
                yield now, pa.Table.from_batches(rest)
                rest = []
            now = key
            rest.append(batch.slice(a, b - a))
    if rest:
        yield now, pa.Table.from_batches(rest)


def _met_before(path: int, left: list, right: list) -> np.ndarray:
    """Pairs that share a bucket with a lesser path: those are counted there."""
    place: dict[int, int] = {}
    for paths in (*left, *right):
        for p in paths:
            if p < path:
                place.setdefault(p, len(place))
    if not place:
        return np.zeros((len(left), len(right)), bool)

    def held(rows: list) -> np.ndarray:
        m = np.zeros((len(rows), len(place)), np.float32)
        for i, paths in enumerate(rows):
            for p in paths:
                if p < path:
                    m[i, place[p]] = 1
        return m

    return held(left) @ held(right).T > 0


def _sides(table: pa.Table, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    side = table.column("side").to_numpy()
    left = np.flatnonzero(side == 0)
    return left, (left if a == b else np.flatnonzero(side == 1))


def candidates(cells: DataFrame) -> DataFrame:
    """(path, a, b, side, node) of the nodes with a pair in a cell that the sampled tokens don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, a, b), t in _grouped(batches, 3):
            left, right = _sides(t, a, b)
            if not len(left) or not len(right) or (a == b and len(left) < 2):
                continue
            n = t.column("n").to_numpy().astype(np.float64)
            tokens = (np.frombuffer(b"".join(t.column("tokens").to_pylist()), dtype=np.uint32).reshape(-1, TOKENS) & 0xFF).astype(np.uint8)
            ok = np.minimum(n[left][:, None], n[right][None, :]) >= THRESHOLD * np.maximum(n[left][:, None], n[right][None, :])
            if a == b:
                ok &= np.triu(np.ones_like(ok), 1)
            equal = np.zeros(ok.shape, np.int16)
            for k in range(TOKENS):
                equal += tokens[left, k][:, None] == tokens[right, k][None, :]
            ok &= equal >= LEAST_EQUAL
            if ok.any():
                paths = t.column("paths").to_pylist()
                ok &= ~_met_before(path, [paths[i] for i in left], [paths[i] for i in right])
            used = np.zeros(t.num_rows, bool)
            used[left[ok.any(axis=1)]] = True
            used[right[ok.any(axis=0)]] = True
            if used.any():
                keep = t.filter(pa.array(used)).select(["path", "a", "b", "side", "node", "n", "weight", "paths"]).combine_chunks()
                yield from keep.to_batches()

    return _in_order(cells.select("path", "a", "b", "side", "node", "n", "weight", "tokens", "paths")).mapInArrow(
        run, "path long, a int, b int, side int, node binary, n int, weight long, paths array<long>"
    )


def _in_order(cells: DataFrame) -> DataFrame:
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, "path", "a", "b").sortWithinPartitions("path", "a", "b")


def _linked(t: pa.Table, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact: which pairs of sets reach the threshold."""
    sets = [np.frombuffer(x, dtype=np.uint64) for x in t.column("set").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[code] > 1  # only shingles of two sets or more can meet
    code, owner = code[shared], owner[shared]
    _, code = np.unique(code, return_inverse=True)
    width = int(code.max()) + 1 if len(code) else 0
    both = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for at in range(0, width, 4096):
        lo, hi = np.searchsorted(code, [at, at + 4096])
        m = np.zeros((len(sets), min(4096, width - at)), np.float32)
        m[owner[lo:hi], code[lo:hi] - at] = 1
        both += m[left] @ m[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return both >= THRESHOLD * union - 1e-6


def verified(cells: DataFrame) -> DataFrame:
    """(node, links, root): for each node of a cell the texts linked to it there, and the least node of its tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, a, b), t in _grouped(batches, 3):
            left, right = _sides(t, a, b)
            if not len(left) or not len(right):
                continue
            ok = _linked(t, left, right)
            if a == b:
                np.fill_diagonal(ok, False)
            paths = t.column("paths").to_pylist()
            ok &= ~_met_before(path, [paths[i] for i in left], [paths[i] for i in right])
            if not ok.any():
                continue
            weight = t.column("weight").to_numpy().astype(np.float64)
            links = np.zeros(t.num_rows)
            np.add.at(links, left, ok @ weight[right])
            if a != b:
                np.add.at(links, right, ok.T @ weight[left])
            nodes = t.column("node").to_pylist()
            rank = np.empty(t.num_rows, np.int64)
            rank[sorted(range(t.num_rows), key=lambda i: nodes[i])] = np.arange(t.num_rows)
            while True:
                old = rank.copy()
                np.minimum.at(rank, left, np.where(ok, rank[right][None, :], 1 << 60).min(axis=1))
                np.minimum.at(rank, right, np.where(ok, rank[left][:, None], 1 << 60).min(axis=0))
                if (rank == old).all():
                    break
            order = sorted(nodes)
            on = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([nodes[i] for i in on], pa.binary()), pa.array(links[on].astype(np.int64)), pa.array([order[rank[i]] for i in on], pa.binary())], names=["node", "links", "root"]
            )

    return _in_order(cells.select("path", "a", "b", "side", "node", "weight", "paths", "set")).mapInArrow(run, "node binary, links long, root binary")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set): the exact sets of the wanted nodes (node, doc_id, tie: one document each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            value, starts = shingle_sets(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([value[x:y].tobytes() for x, y in zip(starts[:-1], starts[1:], strict=True)], pa.binary())], names=["node", "set"])

    texts = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    own = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["tie"] == wanted["tie"])
    found = texts.join(wanted, own).select("node", "text")
    return found.mapInArrow(run, "node binary, set binary").dropDuplicates(["node"])


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, class_id, class_tie, n_links) of every document.

    ``class_id`` is the least doc_id of the class; ``n_links`` the number of
    other distinct texts linked to the document's text; ``tie`` the hash of the
    text, which with doc_id names the row, as class_tie and class_id name the
    first row of the class.
    """
    rows = stored(sketched(docs), "sketches")
    full = rows.filter("node is not null")
    texts = full.groupBy("node", "text_id").agg(F.min(F.struct("doc_id", "tie")).alias("at"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    nodes = stored(texts.groupBy("node").agg(F.count(F.lit(1)).alias("weight"), F.min("at").alias("at"), F.first("n").alias("n"), F.first("tokens").alias("tokens")), "nodes")
    met = buckets(nodes)
    paths = met.groupBy("node").agg(F.collect_list(F.struct("path", "size", "shingles")).alias("met"))  # some RUNS of a node
    each = nodes.join(paths, "node").withColumn("paths", F.transform("met", lambda x: x["path"])).select("node", "n", "weight", "tokens", "paths", F.inline("met"))
    near = stored(candidates(_cells(each)), "candidates")
    wanted = near.select("node").distinct().join(nodes.select("node", "at.doc_id", "at.tie"), "node")
    links = stored(verified(near.join(sets_of(docs, wanted), "node")), "links")
    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(links.select("node", "root"), "node", "root")
    least = nodes.join(classes, "node", "left").select("node", "weight", "at", F.coalesce("component", "node").alias("component")).join(degree, "node", "left")
    named = least.groupBy("component").agg(F.min("at").alias("first"))
    facts = least.join(named, "component").select("node", F.col("first.doc_id").alias("class_id"), F.col("first.tie").alias("class_tie"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = full.select("doc_id", "tie", "node").join(facts, "node").select("doc_id", "tie", "class_id", "class_tie", "n_links")
    return out.unionByName(rows.filter("node is null").select("doc_id", "tie", F.col("doc_id").alias("class_id"), F.col("tie").alias("class_tie"), F.lit(0).cast("long").alias("n_links")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, one of each class: that of the least doc_id, then of the least text hash; one of repeated rows."""
    return protected(docs, ("doc_id", "text"), _one_of_each)


def _one_of_each(docs: DataFrame) -> DataFrame:
    own = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("tie") == F.col("class_tie"))
    with scratch(docs.sparkSession):
        keys = stored(join(docs).filter(own).select(F.col("doc_id").alias("_d"), F.col("tie").alias("_t")).distinct(), "first-of-each", keep=True)
    keyed = docs.withColumns({"_d": F.col("doc_id"), "_t": F.xxhash64("text")})
    kept = keyed.join(keys, keyed["_d"].eqNullSafe(keys["_d"]) & (keyed["_t"] == keys["_t"]), "left_semi")
    return kept.dropDuplicates(["_d", "_t"]).drop("_d", "_t")
