"""Document fingerprints by I-Match with randomised lexicons.

Native: DataFrame and SQL functions only.

* ``lexicon`` counts in how many documents each term stands, over all of them,
  and keeps the terms within a band of document frequency.  The lower end of
  the band is a share of the documents, so the lexicon holds at most (mean
  distinct terms of a document) / ``low`` terms, however many documents there
  are; it is broadcast only after its size is checked.
* Each term belongs to some of ``SUBSETS`` random subsets of the lexicon, drawn
  at three rates for short and long texts.
* A fingerprint has a part per subset: the hash of the text's sorted distinct
  terms in it, or ``-`` if it has none there.  A text without any such term is
  hashed whole.  ``likeness`` is the share of the subsets on which two
  fingerprints agree, of those where either has terms, at the best rate.

Nulls: a null text counts as empty.  Rows with equal text get equal
fingerprints.  Repeated rows follow each other in order of doc_id, then of the
text's hash; a null doc_id comes first.  A doc_id is a number.  A very long text
is edited and hashed whole; its terms are spread over rows.  An empty table gives
no rows.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, quantile_cuts, range_of, stored

#: Share of documents that hold a term: the band.
LOW, HIGH = 0.0005, 0.2
#: Tiers of 16 subsets that hold a 32nd, a 128th and a 512th of the lexicon, for short to long texts: a term is in
#: a subset if the first three hex digits of its hash are lower than the bound.
TIER = 16
BOUNDS = ("080",) * TIER + ("020",) * TIER + ("008",) * TIER
SUBSETS = len(BOUNDS)
#: Subsets of a tier in which either text has terms, from which on the tier's own share counts.
ENOUGH = 4
MAX_BROADCAST = 2_000_000
NOT_TERM = r"[\x00-/:-@\[-`{-\x7F]+"


def terms(text: Column) -> Column:
    """Distinct lower-case terms: runs of ASCII letters and digits and of all other characters."""
    # array_distinct compares each string with every other one; neighbours in sorted order don't
    return F.flatten(F.transform(F.array(F.sort_array(F.split(F.lower(text), NOT_TERM))), lambda s: F.filter(s, lambda x, i: (x != "") & ((i == 0) | (x != F.get(s, i - 1))))))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term, members): terms in the band, with the bit set of the subsets they belong to."""
    n = docs.count()
    held = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").count()
    held = held.filter((F.col("count") >= max(2, low * n)) & (F.col("count") <= high * n))
    bits = [F.when(F.substring(F.md5(F.concat(F.col("term"), F.lit(f":{r}"))), 1, 3) < bound, F.lit(1 << r).cast("long")).otherwise(F.lit(0).cast("long")) for r, bound in enumerate(BOUNDS)]
    members = bits[0]
    for b in bits[1:]:
        members = members.bitwiseOR(b)
    # a filter on the term alone would move below the count, and hash every word of every text
    members = F.when(F.col("count") > 0, members)
    return held.select("term", members.alias("members")).filter("members <> 0")


def _masks(first: int, n: int) -> Column:
    """The bits of ``n`` subsets as a tree: of fours for 16, and single bits for four."""
    if n == 4:
        return F.array(*[F.lit(1 << (first + k)).cast("long") for k in range(4)])
    step = TIER if n > TIER else 4
    bits = lambda at: F.lit(((1 << step) - 1) << at).cast("long")
    return F.array(*[F.struct(bits(at).alias("bits"), _masks(at, step).alias("below")) for at in range(first, first + n, step)])


def parts(found: Column) -> Column:
    """Parts of a fingerprint from sorted (term, members).

    Terms are first dealt to tiers, then to fours of subsets, then to the
    subsets: a term is looked at some ten times, not once for each subset.
    """
    held = lambda xs, bits: F.filter(xs, lambda x: x["members"].bitwiseAND(bits) != 0)
    once = lambda value, body: F.flatten(F.transform(F.array(value), body))

    def part(own: Column) -> Column:
        return F.when(F.size(own) == 0, "-").otherwise(F.substring(F.md5(F.array_join(F.transform(own, lambda x: x["term"]), " ")), 1, 6))

    four = lambda f: lambda xs: F.transform(f["below"], lambda bit: F.element_at(F.transform(F.array(held(xs, bit)), part), 1))
    tier = lambda t: lambda xs: F.flatten(F.transform(t["below"], lambda f: once(held(xs, f["bits"]), four(f))))
    return F.flatten(F.transform(_masks(0, SUBSETS), lambda t: once(held(found, t["bits"]), tier(t))))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints: from 0 to 1.

    The highest share of equal parts of a tier with ``ENOUGH`` parts, or of all
    tiers together if none has; 1 or 0 for texts hashed whole.
    """
    pairs = F.arrays_zip(F.split(a, "\\.").alias("a"), F.split(b, "\\.").alias("b"))
    used = lambda p: F.size(F.filter(p, lambda x: (x["a"] != "-") | (x["b"] != "-")))
    same = lambda p: F.size(F.filter(p, lambda x: (x["a"] == x["b"]) & (x["a"] != "-")))
    share = lambda p: same(p) / F.greatest(used(p), F.lit(1))
    tiers = [F.slice(pairs, 1 + k, TIER) for k in range(0, SUBSETS, TIER)]
    best = F.array_max(F.array(*[F.when(used(t) >= ENOUGH, share(t)) for t in tiers]))
    return F.coalesce(best, share(pairs))


def with_next(docs: DataFrame) -> DataFrame:
    """(range, place, real, doc_id, text, next_text) in ascending doc_id; after the last comes the first.

    Documents are dealt once, by ranges of doc_id.  The first of each range also
    goes to the range before it, marked as not real.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = quantile_cuts(base, "doc_id", 4 * partitions(docs.sparkSession))
    base = base.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(range_of(F.col("doc_id"), cuts)))
    every = Window.orderBy("range")
    # a row per range, as many as there are cuts
    firsts = base.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"].alias("first_id"))
    firsts = firsts.select("first_id", F.coalesce(F.lag("range").over(every), F.max("range").over(Window.partitionBy())).alias("before"), F.lag("range").over(every).isNull().alias("wraps"))
    marked = base.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    places = F.array_compact(F.array(
        F.struct(F.col("range").alias("range"), F.lit(True).alias("real"), F.lit(False).alias("wraps")),
        F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("range"), F.lit(False).alias("real"), F.col("wraps").alias("wraps"))),
    ))
    rows = marked.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.inline(places))
    order = Window.partitionBy("range").orderBy("wraps", F.col("doc_id").asc_nulls_first(), F.desc("real"), "tie")
    return rows.select("range", F.row_number().over(order).alias("place"), "real", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def compare(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row per document: the fingerprints of its text and of its edited text, and their likeness.

    The edited text has its last quarter replaced by the beginning of the next document.
    """
    lex = stored(lexicon(docs, low, high), "lexicon")
    lex = F.broadcast(lex) if lex.count() <= MAX_BROADCAST else lex
    rows = with_next(docs)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    rows = rows.withColumn("edited", edited)
    key = ["range", "place"]
    facts = {
        "real": F.col("real"), "doc_id": F.col("doc_id"), "n_chars": F.length("text").cast("long"),
        "edited_sha256": F.sha2(F.encode("edited", "UTF-8"), 256), "whole": F.md5("text"), "edited_whole": F.md5("edited"),
    }
    # one row of facts per document (no term), and a row per term of either text
    texts = F.array(F.struct(F.lit(False).alias("is_edited"), terms(F.col("text")).alias("t")), F.struct(F.lit(True).alias("is_edited"), terms(F.col("edited")).alias("t")))
    each = rows.select(*key, *[v.alias(k) for k, v in facts.items()], F.explode(texts).alias("x"))
    each = each.select(*key, *facts, F.col("x.is_edited").alias("is_edited"), F.explode(F.concat(F.col("x.t"), F.array(F.lit("")))).alias("term"))
    hit = each.join(lex, "term", "left").filter((F.col("term") == "") | F.col("members").isNotNull())
    one = F.when(F.col("term") != "", F.struct("term", "members"))
    found = hit.groupBy(*key).agg(
        *[F.first(k).alias(k) for k in facts],
        F.sort_array(F.collect_list(F.when(~F.col("is_edited"), one))).alias("own"),
        F.sort_array(F.collect_list(F.when(F.col("is_edited"), one))).alias("new"),
    )
    whole = lambda found, hash: F.when(F.size(found) == 0, F.concat(F.lit("whole:"), hash)).otherwise(F.array_join(parts(found), "."))
    out = found.select(*key, *facts, whole(F.col("own"), F.col("whole")).alias("fingerprint"), whole(F.col("new"), F.col("edited_whole")).alias("edited_fingerprint"))
    after = F.lead("fingerprint").over(Window.partitionBy("range").orderBy("place"))
    out = out.withColumn("next_fingerprint", after).filter("real")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
