"""Packing documents along a space-filling curve.

1. Each document is tokenized once; a hashed projection of its token counts, by
   the norm of the counts, gives a point in few dimensions.  The rows (point,
   ids as 16-bit words where the vocabulary allows) are written to the shared
   folder, so that no later step tokenizes again.
   Each axis is cut into cells of like numbers of documents by a quantile
   sketch over all points, so that documents of any length spread over the
   whole cube; the cells give the Hilbert key.
2. The rows are cut into ranges of like token counts: of the Hilbert key (a hash
   of the row breaks ties, so copies with one key are split too), or of the
   documents' given order.  The cuts come from a bounded sample in which a row
   stands in proportion to its tokens.
3. Each range is one task: it is sorted by key and cut into sequences of exactly
   ``length`` tokens as a stream; only the last sequence of a range is shorter.

With an ``order`` (the training order of a mix) the ranges follow it, and
neighbours along the curve are packed together inside a range only; ascending
sequence ids then follow the order, range by range.  Each piece carries the
order of its row, which also tells copies of a document apart.

Null and empty texts hold the end id alone.  Repeated rows are packed each, and
so are rows of null or equal doc_ids, of whatever type.  An empty table gives no
pieces.  Very long texts are cut over as many sequences as they need.  Ties in
key are put in order of a hash of the row.  Only ``doc_id``, ``text`` and the
order are read, so extra columns can't clash.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored

DIMS, BITS = 3, 10
AXES = tuple(f"x{k}" for k in range(DIMS))
#: Tokens of a range on average.  At least: one short sequence for so many tokens.  At most: what one task sorts.
LEAST_TOKENS, MOST_TOKENS = 2_000_000, 64_000_000
#: Of the sample that places the cuts: points for each range, and in all.
POINTS, MOST_POINTS = 200, 1_000_000
#: Tokens that a row costs beside its own.
ROW_TOKENS = 64
PIECES = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
_tokenizers: dict = {}


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert curve index of each row of integer coordinates in [0, 2**bits).

    Skilling's transform from axes to the transposed index, on whole columns.
    """
    x = [points[:, i].astype(np.int64).copy() for i in range(points.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ t) >> b) & 1)
    return key


def projection(size: int, dims: int = DIMS) -> np.ndarray:
    """A fixed random sign vector for each token id."""
    i = np.arange(size * dims, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        i = (i ^ (i >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        i = (i ^ (i >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((((i >> np.uint64(40)) & np.uint64(1)).astype(np.float32)) * 2 - 1).reshape(size, dims)


def point(ids: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The projection of the counts of the ids, by their norm: of unit spread whatever the length and the repeats."""
    in_order = np.sort(ids)  # by radix for 16-bit ids
    counts = np.diff(np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1], [True]]))).astype(np.float64)
    return np.array([axis[ids].sum() for axis in signs]) / np.sqrt(counts @ counts)


def axis_cuts(rows: DataFrame) -> list[np.ndarray]:
    """For each axis the sorted values that cut the documents into cells of like numbers (a sketch of bounded size)."""
    at = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    found = rows.agg(*[F.percentile_approx(x, at, 10_000).alias(x) for x in AXES]).first()
    return [np.array(c if c else [0.0], np.float64) for c in found]


def curve_key(points: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The Hilbert key of each point (a row): ``cuts`` give its cell on each axis."""
    return hilbert_key(np.column_stack([np.searchsorted(c, points[:, k], side="right") for k, c in enumerate(cuts)]))


class Tokens:
    """Ids of a byte-level BPE vocabulary.

    ``tokenizers`` defines the ids.  Where the same vocabulary is given as
    ranks, texts of Latin characters without special tokens go through
    ``tiktoken``, which gives the same ids in a quarter of the time; all other
    texts go through ``tokenizers``.
    """

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.size = self.exact.get_vocab_size()
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.other = re.compile("[^\x00-ɏ]")
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> list[int]:
        plain = self.fast is not None and (text.isascii() or not self.other.search(text)) and not any(s in text for s in self.special)
        return self.fast.encode_ordinary(text) if plain else self.exact.encode(text, add_special_tokens=False).ids


def _tokens(path: str, ranks_path: str | None, pattern: str | None) -> Tokens:
    key = (path, ranks_path, pattern)
    if key not in _tokenizers:
        _tokenizers[key] = Tokens(*key)
    return _tokenizers[key]


def tokenized(docs: DataFrame, path: str, ranks_path: str | None = None, pattern: str | None = None, end_id: int = 0, order: Column | None = None) -> DataFrame:
    """(doc_id, position, row, x0, x1, x2, tokens, ids): the point, and ids with the end id as little-endian 16- or 32-bit words; row is unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tok = _tokens(path, ranks_path, pattern)
        word = "<u2" if tok.size <= 1 << 16 else "<u4"
        signs = np.ascontiguousarray(projection(tok.size).T)  # an axis each
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(2)
                arrays, points = [], []
                for text in texts:
                    a = np.array([*tok.ids(text.as_py() or ""), end_id], dtype=word)
                    points.append(point(a, signs))
                    arrays.append(a)
                columns = [pa.array(np.arange(row, row + part.num_rows)), *map(pa.array, np.array(points, np.float64).T), pa.array([len(a) for a in arrays], pa.int64()), pa.array([a.tobytes() for a in arrays], pa.binary())]
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["doc_id", "position", "row", *AXES, "tokens", "ids"])

    rows = docs.select("doc_id", (F.lit(None) if order is None else order).cast("long").alias("position"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, position long, row long, {', '.join(f'{x} double' for x in AXES)}, tokens long, ids binary")


def token_cuts(rows: DataFrame, n: int) -> np.ndarray:
    """``n - 1`` sorted values of ``at`` between which lie about equal shares of the tokens.

    Each row is drawn as many times as its weight holds steps of an even grid
    (its hash decides about the rest), so ``POINTS * n`` points are expected, at
    most ``MOST_POINTS``; they alone come to the driver.
    """
    weight = F.col("tokens") + ROW_TOKENS
    total = rows.agg(F.sum(weight)).first()[0] or 0
    if n < 2 or not total:
        return np.zeros(0, np.int64)
    step = max(1.0, total / min(MOST_POINTS, POINTS * n))
    draw = F.pmod(F.xxhash64("row", F.lit("cuts")), F.lit(1 << 30)) / float(1 << 30)
    points = rows.select("at", F.floor(weight / step + draw).alias("times")).filter("times > 0").toArrow()
    at, times = points.column("at").to_numpy(), points.column("times").to_numpy().astype(np.int64)
    order = np.argsort(at, kind="stable")
    sums = np.cumsum(times[order])
    return np.unique(at[order][np.searchsorted(sums, sums[-1] * np.arange(1, n) / n)])


def pack(
    docs: DataFrame, path: str, ranks_path: str | None = None, pattern: str | None = None, length: int = 1024, end_id: int = 0,
    order: Column | None = None, least_tokens: int = LEAST_TOKENS, most_tokens: int = MOST_TOKENS,
) -> DataFrame:
    """One row per piece: doc_id, ``PIECES``, and with ``order`` (a number, ascending) ``position``; pieces of a sequence are gapless from offset 0."""
    rows = stored(tokenized(docs, path, ranks_path, pattern, end_id, order), "tokens")
    axes = axis_cuts(rows)

    @F.pandas_udf("long")
    def key(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(curve_key(np.column_stack([a, b, c]), axes))

    # the key, then a hash to split copies with one key
    rows = rows.withColumn("key", key(*AXES))
    rows = rows.withColumn("place", F.shiftleft("key", 31) + F.pmod(F.xxhash64("row"), F.lit(1 << 31)))
    rows = rows.withColumn("at", F.col("place") if order is None else F.coalesce("position", F.lit(-1).cast("long")))
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    n = max(1, min(round(total / least_tokens), max(partitions(docs.sparkSession), -(-total // most_tokens))))
    cuts = token_cuts(rows, n)
    kind = docs.schema["doc_id"].dataType.simpleString()
    word = "<u2" if _vocabulary(path) <= 1 << 16 else "<u4"

    @F.pandas_udf("int")
    def range_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, at.to_numpy(), side="right").astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(word).itemsize
        now, seq, at = None, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for k, (rng, ids) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3), strict=True)):
                if rng != now:
                    now, seq, at = rng, rng << 32, 0
                data = np.frombuffer(ids.as_buffer(), dtype=word).astype("<u4").tobytes()
                n_ids, start = len(ids.as_buffer()) // width, 0
                while start < n_ids:
                    take = min(n_ids - start, length - at)
                    out.append((k, start, take, zlib.crc32(data[4 * start : 4 * (start + take)]), n_ids, seq, at))
                    start, at = start + take, at + take
                    if at == length:
                        seq, at = seq + 1, 0
            if out:
                own, *pieces = (pa.array(c, pa.int64()) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(1).take(own), *pieces, batch.column(2).take(own)], names=["doc_id", *PIECES, "position"])

    ranged = rows.withColumn("range", range_of("at")).repartitionById(n, "range").sortWithinPartitions("range", "place", "row")
    found = ranged.select("range", "doc_id", "position", "ids").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in PIECES)}, position long")
    return found if order is not None else found.drop("position")


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()
