"""The registered queries of this subpackage: thin digests of the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, jaccard, language, lexical, linededup, mixing, packing, periodic, quality, sharding, tokencount, toxicity, urls
from .common import new_path, table


def tokenizer_paths(name: str = "byte_bpe_50k") -> dict[str, str]:
    import public_tokenizers

    return {"path": public_tokenizers.path(f"{name}.json"), "ranks_path": public_tokenizers.path(f"{name}.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a null doc_id are never learned from: they are held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = toxicity.learn(toxicity.train_sample(docs, labels, third != 1))
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(third == 1, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "hits", "length")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in 16 batches, are compacted, and are read back through the manifest.

    ``compacted`` is what the newest manifest says of the shards: they hold as
    many rows as arrived in files near the target size, and no shard is left
    whose files could be halved.
    """
    docs = table(spark, sf_dir, "documents")
    store = sharding.Store(spark, new_path(spark, "store"), docs.schema)
    store.append(docs.withColumn("_batch", F.pmod(F.xxhash64("doc_id"), F.lit(16))), by="_batch")
    arrived = sum(s.rows for s in store.shards())
    store.compact_fully(vacuum=0.0)  # nobody else reads this store
    live = store.shards()
    compacted = store.version() > 1 and not store.plan() and sum(s.rows for s in live) == arrived and all(s.files < 2 * s.wanted(store.target) for s in live)
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"), F.lit(compacted).alias("compacted"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.judge(docs.select("doc_id", "text"), quality.trusted_documents(labels)).drop("text")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).drop("tie", "class_tie")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.take(table(spark, sf_dir, "documents"))
    return mixing.in_order(out.select("doc_id", "size", "source_size", "target", "taken", "position", "position_2"), "position")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **tokenizer_paths())


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a null doc_id are never learned from: they are held out."""
    docs = table(spark, sf_dir, "documents")
    quarter = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = language.learn(language.sample(docs, quarter != 2))
    out = language.predict(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(quarter == 2, F.lit(True)).alias("held_out"), "lang_pred", "score", "rejected")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_paths()["path"])


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest run of each document, and digests of all its runs and of the collapsed text."""
    out = periodic.periodic_runs(periodic.with_loops(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("_start"), (-r["period"]).alias("_period"))))
    start, length, period = -best["_start"], best["length"], -best["_period"]
    exponent = F.floor(1000 * length / period).alias("exponent_milli")
    digests = F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256), F.sha2("collapsed", 256)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), exponent, digests[0].alias("runs_sha256"), digests[1].alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_sharding": op3_sharding,
    "op4_urls": op4_urls,
    "op5_quality": op5_quality,
    "op6_jaccard": op6_jaccard,
    "op7_fingerprints": op7_fingerprints,
    "op8_mixing": op8_mixing,
    "op9_packing": op9_packing,
    "op10_language": op10_language,
    "op11_token_counts": op11_token_counts,
    "op12_lexical_search": op12_lexical_search,
    "op13_periodic_runs": op13_periodic_runs,
}
