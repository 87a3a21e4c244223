"""Quality rules: a hashed n-gram log-likelihood ratio with base rules.

Native: DataFrame and SQL functions only.

* ``base_counts`` gives the plain counts of a text (words, symbols, repeated
  lines and repeated 8-word windows).
* ``fit`` counts word unigrams and bigrams of **all** documents in hashed
  buckets (the raw multinomial), and those of **all** trusted documents (the
  target multinomial); the table of log ratios has one number per bucket
  whatever the corpus.
* ``judge`` scores every whole text: the sum of its log ratios over its number
  of n-grams plus ``prior`` (so that a few words can't decide), and compares
  it with one threshold for all documents.

Trusted documents are those that ``trusted`` names by ids of the documents'
type (the query takes every row of ``labels`` with quality 1), however many.
Ids meet texts in a shuffled join; a bitmap of fixed size keeps most other
texts out of the shuffle.  Each trusted document is in the target counts and in
the threshold: the exact ``REJECT`` quantile of the scores that they get from
all others, their own n-grams taken out of the target counts
(``left_out_scores``), so that all but this part of trusted text is kept.

Nulls: a null text has no words, like an empty one; it fails the base rules.
Documents with ties, repeated rows and extra columns are judged row by row.
With no trusted documents every row that passes the base rules is kept.
An extra column with the name of a computed one gives way to it in ``judge``,
and stays in ``kept_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggs import quantiles
from .common import SPACE, protected, scratch, stored, words

BUCKETS = 1 << 16
PRIOR = 50.0
REJECT = 0.002
#: Bits of the map of trusted ids (8 MB in rows of 4 KB), and of one of its rows.
ID_BITS, ROW_BITS = 1 << 26, 1 << 15
SYMBOLS = "#*$%&|<>"
WINDOW = 8
COMPUTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "threshold", "kept")


def pairs_of(hashes: Column, apart: int) -> Column:
    """The hash of each value with the one ``apart`` places on."""
    n = F.size(hashes) - apart
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + apart)))
    return F.when(n > 0, each).otherwise(F.array().cast("array<bigint>"))


def with_hashes(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_one`` and ``_two``: hashes of the words and of the pairs of words that follow each other."""
    return df.withColumn("_one", F.transform(words(F.col(text)), lambda w: F.xxhash64(w))).withColumn("_two", pairs_of(F.col("_one"), 1))


def with_base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the five counts to a table with ``_one`` and ``_two``.

    Words are the runs between space and the controls from tab to carriage
    return.  A repeated window counts all words it covers, the first
    occurrence too.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    # a window of eight words is two of four, each of two pairs
    df = df.withColumn("_four", pairs_of(F.col("_two"), 2)).withColumn("_hashes", pairs_of(F.col("_four"), 4)).withColumn("_lines", lines)
    pairs = F.sort_array(F.transform(F.col("_hashes"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_pairs", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), pairs))
    s, last = F.col("_pairs"), F.size("_pairs") - 1
    twice = F.filter(
        F.sequence(F.lit(0), last),
        lambda j: ((j > 0) & (F.get(s, j)["h"] == F.get(s, j - 1)["h"])) | ((j < last) & (F.get(s, j)["h"] == F.get(s, j + 1)["h"])),
    )
    df = df.withColumn("_at", F.when(s.isNotNull(), F.sort_array(F.transform(twice, lambda j: F.get(s, j)["i"]))))
    at = F.col("_at")
    covered = F.aggregate(
        F.sequence(F.lit(1), F.size(at)),
        F.lit(0).cast("long"),
        # a window covers its words up to the next repeated window
        lambda acc, j: acc + F.when(j < F.size(at), F.least(F.lit(WINDOW), F.get(at, j) - F.get(at, j - 1))).otherwise(F.lit(WINDOW)).cast("long"),
    )
    return df.withColumns({
        "n_words": F.size("_one").cast("long"),
        "word_chars": F.length(F.translate(t, SPACE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(at.isNull(), F.lit(0).cast("long")).otherwise(covered),
    }).drop("_four", "_hashes", "_lines", "_pairs", "_at")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def bucket(h: Column, n: int = BUCKETS) -> Column:
    return F.pmod(h, F.lit(n)).cast("int")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``text`` of the documents whose doc_id stands in ``ids``.

    The bitmap lets through each of them and a few others, which the join drops.
    The join is a shuffled one at any size, so that small tables show what large
    ones cost.
    """
    ids = ids.select(F.col("doc_id").try_cast(docs.schema["doc_id"].dataType).alias("doc_id"))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS))
    row, place = F.floor(bit / ROW_BITS).alias("_row"), (bit % ROW_BITS).alias("_place")
    maps = ids.select(row, place).repartition("_row").groupBy("_row").agg(F.bitmap_construct_agg("_place").alias("_map"))
    # eight places a byte, the lowest bit first
    byte = F.conv(F.hex(F.substring("_map", F.floor(F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = byte.bitwiseAND(F.expr("shiftleft(1, cast(_place % 8 as int))")) != 0
    near = docs.select("doc_id", "text", row, place).join(F.broadcast(maps), "_row").filter(found).select("doc_id", "text")
    # not a semi join: Spark would move it below the filter
    return near.join(ids.distinct().hint("merge"), "doc_id").select("text")


def own_grams(docs: DataFrame, trusted: DataFrame, n: int = BUCKETS) -> DataFrame:
    """A number and ``_grams`` of each trusted document: its buckets, and how many of its unigrams and bigrams are in each."""
    own = with_hashes(texts_of(docs, trusted))
    s, last = F.col("_sorted"), F.size("_sorted") - 1
    own = own.select(F.sort_array(F.transform(F.concat("_one", "_two"), lambda h: bucket(h, n))).alias("_sorted"))
    ends = F.filter(F.sequence(F.lit(0), last), lambda j: (j == last) | (F.get(s, j) != F.get(s, j + 1)))
    own = own.withColumn("_ends", F.when(last >= 0, ends).otherwise(F.array().cast("array<int>")))
    before = lambda k: F.coalesce(F.get(F.col("_ends"), k - 1), F.lit(-1))
    grams = F.transform("_ends", lambda j, k: F.struct(F.get(s, j).alias("bucket"), (j - before(k)).alias("n")))
    return own.select(F.monotonically_increasing_id().alias("_own"), grams.alias("_grams"))


def counted(docs: DataFrame, own: DataFrame, n: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target), ``n`` rows: counts in all documents and in trusted ones, of which ``own`` has the n-grams."""
    grams = with_hashes(docs.select("text")).select(F.explode(F.concat("_one", "_two")).alias("h")).select(bucket(F.col("h"), n).alias("bucket"))
    raw = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"))
    target = own.select(F.inline("_grams")).groupBy("bucket").agg(F.sum("n").alias("target"))
    every = docs.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    return every.join(raw, "bucket", "left").join(target, "bucket", "left").na.fill(0)


def ratios_of(counts: DataFrame, n: int = BUCKETS) -> DataFrame:
    """One row and column ``_ratios``: the ``n`` log ratios of ``counted``."""
    one = counts.groupBy().agg(
        F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"),
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("t"),
    )
    ratio = lambda x: F.log((x["target"] + 1.0) / (F.col("all_target") + n)) - F.log((x["raw"] + 1.0) / (F.col("all_raw") + n))
    return one.select(F.when(F.col("all_target") > 0, F.transform("t", ratio)).otherwise(F.array_repeat(F.lit(0.0), n)).cast("array<float>").alias("_ratios"))


def fit(docs: DataFrame, trusted: DataFrame, n: int = BUCKETS) -> DataFrame:
    """One row and column ``_ratios``: the ``n`` log ratios.  ``trusted``: doc_id."""
    return ratios_of(counted(docs, own_grams(docs, trusted, n), n), n)


def left_out_scores(own: DataFrame, counts: DataFrame, n: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """``score`` of each trusted document by the ratios of all others: those of ``counted`` without its own n-grams in the target."""
    rows = own.select("_own", F.inline_outer("_grams")).join(F.broadcast(counts), "bucket", "left")
    ratio = F.log(F.col("target") - F.col("n") + 1.0) - F.log(F.col("raw") + 1.0)
    sums = rows.groupBy("_own").agg(F.coalesce(F.sum(F.col("n") * ratio), F.lit(0.0)).alias("_sum"), F.coalesce(F.sum("n"), F.lit(0)).alias("_size"))
    both = counts.groupBy().agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    left = F.col("all_target") - F.col("_size")
    total = F.col("_sum") + F.col("_size") * (F.log(F.col("all_raw") + n) - F.log(left + n))
    return sums.crossJoin(F.broadcast(both)).select((F.when(left > 0, total).otherwise(0.0) / (F.col("_size") + prior)).alias("score"))


def with_score(df: DataFrame, ratios: DataFrame, n: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """Add ``score`` to a table with ``_one`` and ``_two``.

    ``ratios`` is the one row of ``fit``, of n numbers: it is broadcast.  (As a
    constant of the query it would stand in every plan text the driver keeps.)
    """
    total = lambda hs: F.aggregate(hs, F.lit(0.0), lambda acc, h: acc + F.get(F.col("_ratios"), bucket(h, n)))
    s = (total(F.col("_one")) + total(F.col("_two"))) / (F.size("_one") + F.size("_two") + prior)
    return df.crossJoin(F.broadcast(ratios)).select(*df.columns, s.alias("score"))


def judge(docs: DataFrame, trusted: DataFrame, n: int = BUCKETS, prior: float = PRIOR, reject: float = REJECT) -> DataFrame:
    """Add the counts, base_failed, score, threshold and kept to every document."""
    return protected(docs, ("doc_id", "text"), lambda d: _judge(d, trusted, n, prior, reject))


def _judge(docs: DataFrame, trusted: DataFrame, n: int, prior: float, reject: float) -> DataFrame:
    with scratch(docs.sparkSession):
        own = stored(own_grams(docs, trusted, n), "grams")
        counts = stored(counted(docs, own, n), "counts")
        ratios = stored(ratios_of(counts, n), "ratios", keep=True)
        cut = quantiles(left_out_scores(own, counts, n, prior), [], "score", [reject]).first()["q"][0]
    scored = with_score(with_base_counts(with_hashes(docs)), ratios, n, prior)
    out = scored.withColumns({"base_failed": base_failed(), "threshold": F.lit(float("-inf") if cut is None else float(cut))})
    # The id (always 0 or more) keeps a later filter on kept above these steps.  Moved below them, the filter would hold
    # all of them in one expression, which hashes a text anew for each of its words.
    kept = ~F.col("base_failed") & (F.col("score") >= F.col("threshold")) & (F.monotonically_increasing_id() >= 0)
    return out.withColumn("kept", kept).select(*docs.columns, *COMPUTED)


def kept_documents(docs: DataFrame, trusted: DataFrame, **options) -> DataFrame:
    """The documents that ``judge`` keeps."""
    return protected(docs, ("doc_id", "text"), lambda d: judge(d, trusted, **options).filter("kept").select(*d.columns))


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Doc_ids of all rows with quality 1."""
    return labels.filter("quality = 1").select("doc_id")


trusted_sample = trusted_documents  # an older name: nothing is left out
