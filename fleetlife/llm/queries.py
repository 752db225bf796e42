"""The numbered queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlife.llm import (
    decontaminate,
    htmltext,
    jaccardjoin,
    lexicalsearch,
    licenses,
    minhash,
    mixing,
    pii,
    prefixtrie,
    qualityrules,
    sharding,
    substringdedup,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Shards of equal weight in op2, and after one more was added.
SHARDS = 24


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@query
def op2_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 equal shards by law ``key``. Groups play no part: doc_id decides alone."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    rows = sharding.shard_table(docs, [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document; a null id list is the empty list's hash."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scanned = decontaminate.scan_benchmark(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    rows = scanned.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
    )
    return rows.withColumn("contaminated", decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")))


@query
def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to targets of 100 % of all words."""
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    rows = qualityrules.apply_rules(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = pii.find_pii(table(spark, sf_dir, "documents", "doc_id", "text"))
    counts = {f"n_{k.name}": F.size(pii.of_kind(k.name)).cast("long") for k in pii.KINDS if k.base}
    return found.withColumns(counts).select(
        "doc_id",
        *counts,
        F.sha2(pii.span_list(F.filter("pii", lambda s: s["base"])), 256).alias("base_sha256"),
        pii.span_list(F.col("pii")).alias("spans"),
    )


@query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document. Score: the largest containment of a notice, or 1 for a phrase."""
    scanned = licenses.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))
    base, more = F.transform("places", lambda p: p["label"]), F.transform("blocks", lambda b: b["label"])
    at = F.transform("places", lambda p: p["word"])
    best = F.array_max(F.transform("blocks", lambda b: b["containment"]))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


@query
def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = htmltext.extract_main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select(
        "page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars")
    )


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = toxicity.score(docs, machine)
    return scored.select(
        "doc_id",
        toxicity.is_held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.REJECT).cast("int").alias("predicted"),
    )


@query
def op10_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose four-word shingles are 85 % the same."""
    return jaccardjoin.link_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat 50 bytes of an earlier one."""
    cut = substringdedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return cut.select(
        "doc_id",
        "n_bytes",
        n_removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op12_nra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return lexicalsearch.search(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), k=50)


@query
def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return prefixtrie.conversation_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


@query
def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose two-word shingles are 80 % the same."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), n=2, percent=80)
