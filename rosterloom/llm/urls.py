"""URL filters: allow and block rules, and gradient-boosted trees on lexical features.

Native: DataFrame and SQL functions and ``pyspark.ml`` only.

* A rule is a host and the beginning of a path; it fits its host and all
  subdomains.  The longest fitting rule wins.
* URLs that no rule fits are judged by boosted trees trained on labelled URLs,
  here those that a rule decides (a bounded sample of at most ``MAX_TRAIN``,
  lowest hash first).  Features see the whole URL: lengths, depth, shares of
  digits and signs, entropy of the host, counts of parameters, and the share of
  blocked URLs among the training URLs with the same suffix, the same last two
  host labels, or the same first path segment (smoothed, so that an unseen
  value gives the mean).  The shares of a training URL come from the other
  folds of the training table, so the trees learn to trust a share no further
  than it holds for new URLs.  Each training URL comes twice, with its shares
  and with the means in their place, each split sees a third of the features,
  and both labels weigh the same: the lexical features have to answer too.
* ``learn`` and ``probability`` can be used apart: ``held_out`` trains on a part of
  the labelled URLs and scores the rest, ``rule_held_out`` trains without the URLs
  of one rule and scores those.

The statistics and the trees come from the bounded sample alone, so they hold at
most as many values as it has rows, however many URLs are judged.

Nulls: a null url, or one without ``://``, has an empty host and path; no rule
fits it and the trees judge its (empty) features.  Empty and very long urls,
ties and repeated rows are judged row by row; other columns are not read.  With
no blocked or no allowed training URL the verdict is that of all the others,
``allow`` if there are none.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MAX_TRAIN = 20_000
TREES, DEPTH, SEED = 20, 4, 7
#: URLs of the mean that a share of blocked URLs is smoothed with.
SMOOTH = 10
#: Features that each split of a tree may use: with all of them the shares would decide alone.
SUBSET = "onethird"
#: Folds of the training table for the shares of its own URLs.
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ``://`` in lower case (A-Z only), and the path up to ``?`` or ``#``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, r.text).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    df = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return df.withColumns({"rule": rule, "by_rule": verdict})


def lexical(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add the numeric features of ``url``, ``host`` and ``path`` and the three keys of the statistics."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    chars = F.filter(F.split(host, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1))
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    labels = F.split(host, r"\.")
    count = lambda col, rx: F.regexp_count(col, F.lit(rx)).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    features = {
        "f_length": F.length(url).cast("double"),
        "f_host_length": F.length(host).cast("double"),
        "f_path_length": F.length(path).cast("double"),
        "f_depth": count(path, "/+[^/]"),
        "f_labels": F.size(labels).cast("double"),
        "f_digits": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
        "f_host_digits": count(host, "[0-9]"),
        "f_hyphens": count(host, "-"),
        "f_signs": count(url, "[^A-Za-z0-9/.:]"),
        "f_entropy": F.when(host == "", 0.0).otherwise(entropy),
        "f_params": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
        "f_query_length": F.length(query).cast("double"),
        "f_fragment": F.when(F.contains(url, F.lit("#")), 1.0).otherwise(0.0),
        "f_secure": F.when(F.startswith(url, F.lit("https://")), 1.0).otherwise(0.0),
        "f_www": F.when(F.startswith(host, F.lit("www.")), 1.0).otherwise(0.0),
        "f_ends_slash": F.when(F.endswith(path, F.lit("/")), 1.0).otherwise(0.0),
    }
    keys = {
        "k_suffix": F.element_at(labels, -1),
        "k_site": F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), "."),
        "k_first": F.regexp_extract(path, r"\A/([^/]*)", 1),
    }
    return df.withColumns(features).withColumns(keys), list(features)


KEYS = ("k_suffix", "k_site", "k_first")


class Trees(NamedTuple):
    """Boosted trees with the sums of their training URLs; ``model`` is None where only one label was seen, ``mean`` its share."""

    model: object
    names: list[str]
    sums: dict[str, DataFrame]
    mean: float


def with_shares(df: DataFrame, sums: dict[str, DataFrame], mean: float, own: bool = False) -> DataFrame:
    """Add the smoothed share of blocked URLs of each key; ``own``: rows of the training table, whose fold doesn't count."""
    for key, found in sums.items():
        # as many rows as the bounded training table at most
        every = found.groupBy(key).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        df = df.join(F.broadcast(every), key, "left")
        n, s = F.coalesce("n", F.lit(0)), F.coalesce("s", F.lit(0.0))
        if own:
            df = df.join(F.broadcast(found.withColumnsRenamed({"n": "n_own", "s": "s_own"})), [key, "fold"], "left")
            n, s = n - F.coalesce("n_own", F.lit(0)), s - F.coalesce("s_own", F.lit(0.0))
        df = df.withColumn(key.replace("k_", "f_block_"), (s + SMOOTH * mean) / (n + SMOOTH)).drop("n", "s", "n_own", "s_own")
    return df


def learn(train: DataFrame) -> Trees:
    """``train``: the columns of ``lexical`` with label (1: block), a bounded table."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    n, blocked = train.agg(F.count(F.lit(1)), F.sum("label")).first()
    names = [c for c in train.columns if c.startswith("f_")] + [k.replace("k_", "f_block_") for k in KEYS]
    if not n or blocked in (0, n):
        return Trees(None, names, {}, 1.0 if n and blocked else 0.0)
    mean = blocked / n
    train = train.withColumn("fold", F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS)))
    sums = {k: stored(train.groupBy(k, "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("s")), k) for k in KEYS}
    known = with_shares(train, sums, mean, own=True)
    masked = known.withColumns({k.replace("k_", "f_block_"): F.lit(mean) for k in KEYS})
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(known.unionByName(masked))
    weight = F.when(F.col("label") == 1, 0.5 / mean).otherwise(0.5 / (1 - mean)).alias("weight")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=32, subsamplingRate=1.0, featureSubsetStrategy=SUBSET, weightCol="weight")
    model = trees.fit(rows.select("features", "label", weight))
    return Trees(model, names, sums, mean)


def probability(rows: DataFrame, trees: Trees) -> DataFrame:
    """Add ``p``, the probability of a block, to a table of ``lexical``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    if trees.model is None:
        return rows.withColumn("p", F.lit(trees.mean))
    every = VectorAssembler(inputCols=trees.names, outputCol="features").transform(with_shares(rows, trees.sums, trees.mean))
    return trees.model.transform(every).withColumn("p", F.get(vector_to_array("probability"), F.lit(1)))


def labelled(rows: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """At most ``most`` rows that a rule decides, those of the lowest hash, with ``label``."""
    found = rows.filter("by_rule is not null").orderBy(F.xxhash64("url"), "page_id").limit(most)
    return stored(found.withColumn("label", F.when(F.col("by_rule") == "block", 1.0).otherwise(0.0)), "urls")


def judge(pages: DataFrame, rules=RULES, most: int = MAX_TRAIN) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block) of every page; p_block is null where a rule decides."""
    rows, _ = lexical(parsed(pages, rules))
    judged = probability(rows, learn(labelled(rows, most)))
    p = F.when(F.col("by_rule").isNull(), F.col("p"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("p") >= 0.5, "block").otherwise("allow")).alias("verdict"), p.alias("p_block"))


def held_out(pages: DataFrame, rules=RULES, most: int = MAX_TRAIN, folds: int = 3) -> DataFrame:
    """(page_id, label, p) of the labelled URLs whose host is in the last of ``folds`` parts: the trees learn from the others."""
    rows = labelled(lexical(parsed(pages, rules))[0], most)
    last = F.pmod(F.xxhash64("host", "path"), F.lit(folds)) == folds - 1
    return probability(rows.filter(last), learn(rows.filter(~last))).select("page_id", "label", "p")


def rule_held_out(pages: DataFrame, rule: str, rules=RULES, most: int = MAX_TRAIN) -> DataFrame:
    """(page_id, label, p) of the labelled URLs that ``rule`` decides: the trees learn from those of the other rules."""
    rows = labelled(lexical(parsed(pages, rules))[0], most)
    own = F.col("rule") == rule
    return probability(rows.filter(own), learn(rows.filter(~own))).select("page_id", "label", "p")
