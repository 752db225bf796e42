"""From raw documents to training shards: five stages, each one operator of ``fleetlife.llm``.

Each stage gets what the stage before it kept and returns the columns of ``documents`` (the last adds the
shard). Texts that are null or empty are not toxic, not duplicates and not contaminated; they have no words,
so the mix never takes them. Rows that share a doc_id are one document for the near-duplicate stage, and all
of them stay or go. Columns beyond those of ``documents`` pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlife.llm import decontaminate, jaccardjoin, mixing, sharding, toxicity
from fleetlife.llm.textparts import put_back, set_aside
from fleetlife.session import stage

#: Near duplicates: words of a shingle, and per cent of all shingles of two documents that both have.
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80

#: Shards of equal weight.
SHARDS = 24


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the limit; learned from the labelled ones among them."""
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    free, moved = set_aside(docs, ["toxicity"])
    return put_back(toxicity.score(free, machine).where(F.col("toxicity") < toxicity.REJECT), docs, moved)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    groups = jaccardjoin.link_groups(docs, n=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    gone = groups.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without much benchmark text."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once, or up to three times."""
    mixed = mixing.mix(docs).select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), "copies")
    own = Window.partitionBy("_id").orderBy("_size", F.desc("copies"))
    mixed = mixed.withColumn("_nth", F.row_number().over(own))
    names, moved = set_aside(docs, ["copies", "_nth", "_id", "_size", "_words", "_n", "_copy"])
    same = Window.partitionBy("doc_id").orderBy("_words")
    numbered = names.withColumn("_words", mixing.word_count("text")).withColumn("_n", F.row_number().over(same))
    taken = numbered.join(mixed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_n") == F.col("_nth")))
    repeated = taken.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return put_back(repeated, docs, moved)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard. Copies of a document are in one shard."""
    return sharding.assign_shards(docs, [1.0] * SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The first stage is a trained model, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. Each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
