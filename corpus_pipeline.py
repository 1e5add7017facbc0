"""A training corpus from documents: STAGES in order, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import decontaminate, mixing, quality, sharding, simhash
from postmill.llm.common import shared_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    Null and empty texts have no words and go; rows that repeat share their verdict, an empty table stays empty, and
    all columns are kept whatever their names.
    """
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id, and of those the one with the smallest hash.

    A null doc_id counts as a hash of the text. Rows that share a doc_id are one only if they are equal throughout.
    Texts without words are near copies of one another; an empty table stays empty. Columns may have any type and name.
    """
    own = F.coalesce("doc_id", F.xxhash64("text")).alias("own")
    cells = [F.col(f"`{c}`") for c in docs.columns]
    # Maps have no hash: they count by their JSON.
    hashed = [F.to_json(F.struct(c)) if "map<" in kind else c for c, (_, kind) in zip(cells, docs.dtypes)]
    tag = F.xxhash64(*(x for c, h in zip(cells, hashed) for x in (c.isNull(), h))).alias("tag")
    first = simhash.first_rows(docs.select(own.alias("doc_id"), tag, "text")).select(F.col("doc_id").alias("own"), "tag")
    rows = docs.select(own, tag, F.struct(*cells).alias("row"))
    return rows.join(first, ["own", "tag"], "left_semi").dropDuplicates(["own", "tag"]).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    A text of fewer than five words, or none, holds none; rows that repeat stay or go together; without documents or
    items the rows stay as they are.
    """
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources draws them, up to three times.

    Null is a source of its own; texts without words are not drawn; rows that share a doc_id are drawn apart; an empty
    table stays empty.
    """
    return mixing.mixed(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and place in it of every document that the mix drew.

    Copies share a shard unless together they are more than one holds; null ids, sources and languages come first; an empty
    table gives no rows.
    """
    return sharding.shard(docs, shards=40)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("mixing", source_mixing),
    ("sharding", sharding_stage),
]

#: SimHash, MinHash and the k-d tree are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
