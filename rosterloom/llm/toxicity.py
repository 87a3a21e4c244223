"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

* ``fold`` makes look-alikes equal: accented and styled letters (by Unicode
  compatibility), Cyrillic and Greek homoglyphs and digit substitutions are
  mapped to one plain letter each (``l``, ``1``, ``|`` and ``!`` count as
  ``i``).  Letters of other scripts stay; all else becomes a space, one between
  words however many signs stand there.
* ``learn`` takes labelled texts (a bounded sample) and keeps word beginnings
  (4 to ``LONGEST`` letters, or a whole word of any length) whose share of toxic
  texts is far above the clean ones'.  Of beginnings of the same words the
  longest stays; one that holds more words replaces its continuations.  Weights
  are smoothed log odds.
* Exception phrases are those given, and those learned: a word that holds a term
  together with the word before or after it, where the two stand in clean texts
  more often than chance gives and not in toxic ones.
* ``score`` finds all terms of every whole text in one pass, cancels those
  inside an exception phrase, and maps the sum of weights, normalised by the
  number of letters, to a probability by a logistic curve fitted on the sample.

Nulls: null and empty texts hold no term; they get the score of a text without
terms.  Very long texts are scanned once, whole, in time that grows with their
length.  Repeated rows and ties are scored alike, extra columns are ignored by
the operator and dropped.  An empty table gives an empty result.  With no
labelled rows the lexicon is empty and a fixed curve gives every text the same
low score.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Letters of other scripts and symbols that look like a Latin letter.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ø": "o", "ł": "l", "đ": "d", "ɑ": "a", "ɡ": "g", "ƒ": "f",
}
#: Digits and signs written for a letter.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
MAX_TRAIN = 20_000
#: A term stands in so many toxic texts, and in this share of them.
MIN_DOCS, MIN_SHARE = 4, 0.01
SHORTEST, LONGEST = 4, 24
#: A learned exception stands in so many clean texts, and in no toxic one.
MIN_CLEAN = 3
_ZERO_WIDTH = (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)


class _Folds(dict):
    """Code point → plain letters, a space, or None (left out), made when first met."""

    def __missing__(self, cp: int) -> str | None:
        c = chr(cp)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
        plain = "".join(HOMOGLYPHS.get(x, DIGITS.get(x, x)) for x in plain)
        plain = plain.replace("l", "i") if plain.isascii() else plain
        if cp in _ZERO_WIDTH or unicodedata.combining(c):
            out = None
        else:
            out = plain if plain and all(x.isalpha() for x in plain) else " "
        self[cp] = out
        return out


TABLE = _Folds()


def fold(text: str | None) -> str:
    """The text in plain letters, one space between words and on each side, so that a word begins after a space."""
    return f" {' '.join((text or '').translate(TABLE).split())} "


@dataclass(frozen=True)
class Model:
    """Terms (folded, each with a leading space) with weights, exception phrases, and the curve."""

    terms: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-4.0, 4.0, 0.5)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.terms:
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            folded = fold(phrase)  # ends in a space: a whole word
            if folded.strip():
                found.add_word(folded, (len(folded), -1.0))
        if len(found):
            found.make_automaton()
        return found


def matches(automaton, folded: str) -> dict[int, float]:
    """Start → weight of the terms outside exception phrases; of terms with one start the heaviest."""
    if not len(automaton):
        return {}
    safe, hits = [], []
    for end, (size, weight) in automaton.iter(folded):
        (safe if weight < 0 else hits).append((end - size + 1, end, weight))
    if safe and hits:
        safe.sort()
        starts, reach = [], []  # up to each start the furthest end
        for start, end, _ in safe:
            starts.append(start)
            reach.append(max(end, reach[-1]) if reach else end)
        inside = lambda start, end: (k := bisect_right(starts, start)) > 0 and end <= reach[k - 1]
        hits = [h for h in hits if not inside(h[0], h[1])]
    best: dict[int, float] = {}
    for start, _, weight in hits:
        best[start] = max(best.get(start, 0.0), weight)
    return best


def weigh(automaton, folded: str) -> float:
    """The sum of weights of the terms outside exception phrases."""
    return sum(matches(automaton, folded).values())


def _beginnings(folded: str) -> set[str]:
    words = {w for w in folded.split() if len(w) >= SHORTEST}
    return {w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)} | words


def _phrases(automaton, folded: str) -> set[str]:
    """The words that hold a term, each with the word before and with the word after it."""
    found = set()
    for start in matches(automaton, folded):
        end = folded.index(" ", start + 1)
        if start:
            found.add(folded[folded.rindex(" ", 0, start) + 1 : end])
        if end < len(folded) - 1:
            found.add(folded[start + 1 : folded.index(" ", end + 1)])
    return found


def _by_label(rows: DataFrame, found) -> DataFrame:
    """(term, toxic, clean): of what ``found`` gives for a folded text, the number of texts of either label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = found()
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if label else clean).update(of(fold(text)))
            keys = list(toxic)
            keys += [k for k in clean if k not in toxic]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["term", "toxic", "clean"]
            )

    counted = rows.select("text", "toxic").mapInArrow(count, "term string, toxic long, clean long")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn(train: DataFrame, exceptions: tuple[str, ...] = ()) -> Model:
    """``train``: text, toxic (0 or 1) of a bounded sample of labelled rows; ``exceptions``: phrases beside the learned ones.

    Counts come from Spark; what passes the bounds (a share of the bounded
    sample) and three sums per distinct (hits, length) reach the driver.
    """
    rows = train.filter("toxic is not null").select("text", F.col("toxic").cast("int").alias("toxic"))
    # the bounded sample, read four times; copies of a text would lend their rare words false support
    rows = stored(rows.groupBy("text").agg(F.max("toxic").alias("toxic")), "train")
    size = rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    n_toxic, n_clean = max(1, size[0]), max(1, size[1])
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    terms = _by_label(rows, lambda: _beginnings).filter(F.col("toxic") >= max(MIN_DOCS, MIN_SHARE * n_toxic)).withColumn("odds", odds).filter("odds > 3").collect()
    # of beginnings of the same words the longest is the most specific; one that holds more words replaces its continuations
    seen = {r["term"]: r["toxic"] for r in terms}
    short = lambda t: range(SHORTEST, min(len(t), LONGEST + 1))
    same = {t[:k] for t, n in seen.items() for k in short(t) if n >= 0.95 * seen.get(t[:k], n + 1)}
    wide = {t for t in seen if t not in same}
    kept = {" " + r["term"]: float(r["odds"]) for r in terms if r["term"] in wide and not any(r["term"][:k] in wide for k in short(r["term"]))}
    model = Model(tuple(sorted(kept.items())), exceptions)
    if kept:

        def phrases():
            automaton = model.automaton()
            return lambda folded: _phrases(automaton, folded)

        harmless = _by_label(rows, phrases).filter((F.col("toxic") == 0) & (F.col("clean") >= max(MIN_CLEAN, MIN_SHARE * n_clean / 10))).select("term").collect()
        model = Model(model.terms, tuple(sorted({*exceptions, *(r["term"] for r in harmless)})))
    scored = matched(rows, model, ["toxic"])
    sums = scored.groupBy("toxic", F.round("hits", 1).alias("hits"), F.round(F.log1p(F.col("length") / 100), 1).alias("length")).count().collect()
    return Model(model.terms, model.exceptions, _curve(sums)) if sums and size[0] else model


def _curve(sums: list) -> tuple[float, float, float]:
    """A logistic fit by Newton steps, with a slight pull to zero, over counted cells."""
    y = np.array([r["toxic"] for r in sums], float)
    on = np.array([r["hits"] > 0 for r in sums], float)
    x = np.column_stack([np.ones(len(y)), on * np.log1p([r["hits"] for r in sums]), -on * np.array([r["length"] for r in sums], float)])
    n, w = np.array([r["count"] for r in sums], float), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (n * (y - p)) - 0.1 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), float(max(0.0, w[2]))


def matched(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with hits (sum of weights) and length (letters)."""
    fields = [f for f in docs.schema.fields if f.name in keep]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            hits, lengths = [], []
            for text in batch.column(0):
                folded = fold(text.as_py())
                hits.append(weigh(automaton, folded))
                lengths.append(len(folded) - folded.count(" "))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(hits, pa.float64()), pa.array(lengths, pa.int64())], names=[*names, "hits", "length"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["hits double", "length long"])
    return docs.select("text", *names).mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, hits, length, score) of every document."""
    a, b, c = model.curve
    z = F.lit(a) + F.when(F.col("hits") > 0, b * F.log1p("hits") - c * F.log1p(F.col("length") / 100)).otherwise(F.lit(0.0))
    return matched(docs, model, [key]).withColumn("score", 1 / (1 + F.exp(-z)))


def train_sample(docs: DataFrame, labels: DataFrame, where, most: int = MAX_TRAIN) -> DataFrame:
    """text and toxic of at most ``most`` labelled rows that ``where`` allows, those of the lowest hash."""
    ids = labels.filter(where).filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
