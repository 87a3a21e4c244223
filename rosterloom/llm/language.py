"""Language identification by interpolated Kneser-Ney character models.

* ``learn`` counts character n-grams (orders 1 to ``ORDER``) inside words, each
  word with a space before and after it, per language, over a bounded sample of
  rows with a known language.  Counts, continuation counts, discounts and the
  interpolated probabilities are Spark aggregates and joins over the n-grams of
  all languages; none is cut off.
* Each language's model is a sorted array of 64-bit n-gram hashes with the
  probabilities of n-grams and the back-off weights of contexts; a lookup is a
  binary search, and an unseen n-gram backs off to its suffix with the weight of
  its context.
* ``predict`` takes the lowest cross-entropy per character.  ``score`` is the
  probability that the answer is right, from the gap between the two best
  entropies by a logistic curve calibrated on the part of the sample that the
  counts leave out; ``rejected`` marks scores under a floor that ``REJECT`` of
  the right answers of that part don't reach.

Contexts don't cross words, so a word has one score per language: each task
keeps the scores of the words it has met (bounded), and a text's entropy is a
sum over its words.  A word is a letter with the letters and marks after it, in
any script.

Nulls: a text that is null or has no letter gets ``und``, score 0.  Very long
texts are scored whole.  Of languages
with equal entropies the first in order of name is taken.  Repeated rows get
equal answers; extra columns are dropped.  An empty table gives an empty result.
With no labelled row every text gets ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

ORDER = 4
#: Rows per language for the counts and the calibration: these bound the size of its model.
MAX_ROWS = 1_500
#: Share of the right answers of the calibration that the floor rejects.
REJECT = 0.01
MAX_WORDS = 500_000
#: Characters that are scored at a time.
PART = 1 << 20
FLOOR_CHAR = 1e-7
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def split_words(text: str) -> list[str]:
    """Lower-cased runs of letters and the marks on them."""
    return _WORD.findall(text.lower())


def _folded(cp: np.ndarray) -> np.ndarray:
    """16 bits of each code point; the value of one outside the basic plane is mixed."""
    c = np.where(cp < 0x10000, cp, (cp.astype(np.uint64) * np.uint64(2654435761)) & np.uint64(0xFFFF)).astype(np.uint64)
    c[c == 0] = 1
    return c


def gram_hashes(grams: list[str]) -> np.ndarray:
    """64-bit values of grams of at most ``ORDER`` characters: 16 bits each, the last character lowest."""
    cp = np.array(grams, dtype=f"<U{ORDER}").view(np.uint32).reshape(-1, ORDER)
    h = np.zeros(len(cp), np.uint64)
    for k in range(ORDER):
        h = np.where(cp[:, k] > 0, (h << np.uint64(16)) | _folded(cp[:, k]), h)
    return h


@dataclass
class Model:
    """For each language sorted hashes with, for a gram its log probability and for a context its log back-off weight."""

    languages: tuple[str, ...]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    backoff: list[np.ndarray]
    curve: tuple[float, float] = (0.0, 4.0)
    floor: float = 0.5

    def words(self, ws: list[str]) -> np.ndarray:
        """The natural log probability of each word (with the space after it) in every language."""
        cp = np.frombuffer((" " + " ".join(ws) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        c = _folded(cp)
        n, i = len(c), np.arange(len(c))
        space = np.maximum.accumulate(np.where(cp == 32, i, 0))
        order = np.minimum(i[1:] - space[:-1], ORDER - 1)  # characters of context, back to the space before the word
        h = c[1:].copy()
        for k in range(1, ORDER):
            past = np.zeros(n - 1, dtype=np.uint64)
            past[k - 1 :] = c[: n - k]
            h |= np.where(order >= k, past << np.uint64(16 * k), np.uint64(0))
        of = np.empty((n - 1, len(self.languages)))
        for at in range(0, n - 1, PART):
            grams, back = np.unique(h[at : at + PART], return_inverse=True)
            orders = np.zeros(len(grams), np.int64)
            orders[back] = order[at : at + PART]
            for k in range(len(self.languages)):
                of[at : at + PART, k] = self._of(k, grams, orders)[back]
        return np.add.reduceat(of, np.flatnonzero(cp[:-1] == 32), axis=0)

    def _of(self, k: int, grams: np.ndarray, orders: np.ndarray) -> np.ndarray:
        """The log probability of the last character of each gram after the others, in the k-th language."""
        keys, h, order = self.keys[k], grams.copy(), orders.copy()
        total, open_, full = np.zeros(len(h)), np.arange(len(h)), np.uint64(0xFFFFFFFFFFFFFFFF)

        def find(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(keys, x)
            at[at == len(keys)] = 0
            return at, keys[at] == x

        while len(open_):
            at, hit = find(h[open_])
            hit &= ~np.isnan(self.logp[k][at])
            total[open_[hit]] += self.logp[k][at[hit]]
            open_ = open_[~hit]
            last = order[open_] == 0
            total[open_[last]] += np.log(FLOOR_CHAR)
            open_ = open_[~last]
            if len(open_):  # the weight of the context, then the gram without its first character
                at, hit = find(h[open_] >> np.uint64(16))
                total[open_[hit]] += self.backoff[k][at[hit]]
                h[open_] &= full >> (np.uint64(64) - np.uint64(16) * order[open_].astype(np.uint64))
                order[open_] -= 1
        return total


def _counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over the words of ``rows`` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(split_words(text or ""))
            for lang, ws in found.items():
                grams: Counter = Counter()
                for w, n in ws.items():
                    s = f" {w} "
                    for i in range(1, len(s)):
                        for a in range(max(0, i - ORDER + 1), i + 1):
                            grams[s[a : i + 1]] += n
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(list(grams)), pa.array(list(grams.values()), pa.int64())], names=["lang", "gram", "n"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, gram, logp, backoff) from (lang, gram, n) of orders 1 to ``ORDER``: interpolated Kneser-Ney, a discount per order.

    A lower order counts the different characters before it; a gram that begins
    a word keeps its own count.
    """
    rows = counts.withColumn("k", F.length("gram"))
    left = rows.filter("k > 1").groupBy("lang", F.substring("gram", 2, ORDER).alias("gram")).agg(F.count(F.lit(1)).alias("left"))
    own = (F.col("k") == ORDER) | F.startswith("gram", F.lit(" "))
    rows = rows.join(left, ["lang", "gram"], "left").select("lang", "k", "gram", F.when(own, F.col("n")).otherwise(F.coalesce("left", F.lit(1))).alias("a"))
    rows = stored(rows.withColumn("context", F.substring(F.col("gram"), F.lit(1), F.col("k") - 1)), "adjusted")
    n1, n2 = F.count_if(F.col("a") == 1), F.count_if(F.col("a") == 2)
    discounts = rows.groupBy("lang", "k").agg(F.when((n1 > 0) & (n2 > 0), n1 / (n1 + 2 * n2)).otherwise(0.5).alias("d"), F.count(F.lit(1)).alias("kinds_all"))
    contexts = rows.groupBy("lang", "k", "context").agg(F.sum("a").alias("total"), F.count(F.lit(1)).alias("kinds"))
    # a row per language and order
    contexts = contexts.join(F.broadcast(discounts), ["lang", "k"]).withColumn("rest", F.col("d") * F.col("kinds") / F.col("total"))
    facts = rows.join(contexts, ["lang", "k", "context"])
    lower, found = None, None
    for k in range(1, ORDER + 1):
        here = facts.filter(F.col("k") == k)
        if lower is None:
            below = 1 / (F.col("kinds_all") + 1)
        else:
            here = here.withColumn("suffix", F.substring("gram", 2, ORDER)).join(lower, ["lang", "suffix"], "left")
            below = F.coalesce("p_lower", F.lit(FLOOR_CHAR))
        here = stored(here.select("lang", "gram", ((F.col("a") - F.col("d")) / F.col("total") + F.col("rest") * below).alias("p")), f"order-{k}")
        lower = here.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("p_lower"))
        found = here if found is None else found.unionByName(here)
    weights = contexts.filter("context <> ''").select("lang", F.col("context").alias("gram"), F.log("rest").alias("backoff"))
    return found.join(weights, ["lang", "gram"], "full").select("lang", "gram", F.log("p").alias("logp"), "backoff")


def model_of(grams: DataFrame) -> Model | None:
    """The model of (lang, gram, logp, backoff): finished arrays of a bounded sample's n-grams, by language."""
    table = grams.toArrow()
    langs = np.array(table.column("lang").to_pylist(), dtype=object)
    if not len(langs):
        return None
    hashes = gram_hashes(table.column("gram").to_pylist())
    logp, backoff = (table.column(c).to_numpy().astype(np.float32) for c in ("logp", "backoff"))
    model = Model(tuple(sorted(set(langs))), [], [], [])
    for lang in model.languages:
        own = np.flatnonzero(langs == lang)
        own = own[np.argsort(hashes[own], kind="stable")]
        model.keys.append(hashes[own]), model.logp.append(logp[own]), model.backoff.append(np.nan_to_num(backoff[own], nan=0.0))
    return model


def entropies(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with chars, best, second, gap of the cross-entropies per character."""
    fields = [f for f in docs.schema.fields if f.name in keep]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        table = np.zeros((0, len(model.languages)))
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            texts = [split_words(text or "") for text in batch.column(0).to_pylist()]
            new = list(dict.fromkeys(w for ws in texts for w in ws if w not in memo))
            if len(memo) + len(new) > MAX_WORDS:
                memo.clear()
                table, new = table[:0], list(dict.fromkeys(w for ws in texts for w in ws))
            if new:
                memo.update(zip(new, range(len(memo), len(memo) + len(new)), strict=True))
                table = np.vstack([table, model.words(new)])
            best, second, chars, lowest = [], [], [], []
            for ws in texts:
                if not ws:
                    best.append(None), second.append(None), chars.append(0), lowest.append(None)
                    continue
                n = sum(map(len, ws)) + len(ws)
                h = -table[list(map(memo.__getitem__, ws))].sum(axis=0) / n
                order = np.argsort(h, kind="stable")
                best.append(model.languages[order[0]])
                second.append(float(h[order[1]] - h[order[0]]) if len(order) > 1 else 1.0)
                lowest.append(float(h[order[0]]))
                chars.append(n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(best, pa.string()), pa.array(second, pa.float64()), pa.array(lowest, pa.float64()), pa.array(chars, pa.int64())],
                names=[*names, "best", "gap", "entropy", "chars"],
            )

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["best string", "gap double", "entropy double", "chars long"])
    return docs.select("text", *names).mapInArrow(run, schema)


def _evidence() -> "F.Column":
    # the gap per character, counted for the length of the text
    return F.log1p(F.col("gap") * F.sqrt(F.col("chars").cast("double")))


def sample(docs: DataFrame, where, most: int = MAX_ROWS) -> DataFrame:
    """lang, text and part (0 counts, 1 calibration) of at most ``most`` rows a language.

    Rows are drawn by a hash of the document, at a rate set from exact counts,
    then cut at the bound; a hot language so never goes to one task as a whole.
    """
    rows = docs.filter(where).filter("lang is not null and text is not null").select("doc_id", "lang", F.xxhash64("doc_id", F.lit("lang")).alias("h"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    near = rows.join(F.broadcast(sizes), "lang").filter(F.pmod("h", F.lit(1_000_000)) <= 1_300_000.0 * most / F.col("n"))
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("r") <= most)
    ids = first.select("doc_id", "lang", F.when(F.col("r") % 5 == 0, 1).otherwise(0).alias("part")).dropDuplicates(["doc_id", "lang"])
    return docs.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "text", "part")


def learn(train: DataFrame) -> Model | None:
    """``train``: see ``sample``."""
    train = stored(train, "language-sample")
    model = model_of(kneser_ney(stored(_counts(train.filter("part = 0")), "grams")))
    if model is None:
        return None
    held = entropies(train.filter("part = 1"), model, ["lang"]).filter("best is not null")
    cells = held.groupBy(F.round(_evidence(), 1).alias("x"), (F.col("best") == F.col("lang")).alias("right")).count().collect()
    if cells:
        x, y, n = (np.array([float(r[k]) for r in cells]) for k in ("x", "right", "count"))
        w = np.array([0.0, 1.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-(w[0] + w[1] * x)))
            d = np.column_stack([np.ones(len(x)), x])
            step = np.linalg.solve((d * (n * p * (1 - p))[:, None]).T @ d + 0.1 * np.eye(2), d.T @ (n * (y - p)) - 0.1 * (w - [0, 1]))
            w = w + np.clip(step, -2, 2)
        model.curve = (float(w[0]), float(max(0.1, w[1])))
        p = 1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * x)))
        order = np.argsort(p, kind="stable")
        right = np.cumsum((n * y)[order])
        if right[-1]:  # at most REJECT of the right answers lie under the floor
            model.floor = float(p[order][np.searchsorted(right, REJECT * right[-1], side="right")]) - 1e-9
    return model


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with lang_pred, score and rejected."""
    if model is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    a, b = model.curve
    p = 1 / (1 + F.exp(-(F.lit(a) + b * _evidence())))
    out = entropies(docs, model, keep)
    return out.select(
        *keep, F.coalesce("best", F.lit("und")).alias("lang_pred"), F.when(F.col("best").isNull(), 0.0).otherwise(p).alias("score"),
        (F.col("best").isNull() | (p < model.floor)).alias("rejected"),
    )
