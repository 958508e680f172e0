"""The corpus pipeline: what is left of the documents, packed into sequences.

STAGES are run one after the other, each written as Parquet and reread as the
documents of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegauge.llm.host_quality import host_quality
from framegauge.llm.line_dedup import line_dedup
from framegauge.llm.queries import TOKENIZER, TOXIC_SCORE, table
from framegauge.llm.sequences import pieces_of
from framegauge.llm.simhash_dedup import simhash_groups
from framegauge.llm.toxicity import fit_toxicity, toxic_passages
from framegauge.llm.window_packing import window_pack
from framegauge.session import checkpointed, clear_scratch, scratch_mark, scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject.

    The model learns from the labelled ones among ``docs``; without labels of both kinds
    it rejects nothing.  Null and empty texts stay, repeated rows share their fate, and
    a text of any length is scored whole.
    """
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxic_passages(docs, model).where(F.col("toxicity") < TOXIC_SCORE).select(COLUMNS)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, of hosts that are not rejected.

    Null and empty texts have too few words and go; rows without a source belong to no
    host and are judged by themselves; repeated rows count as often as they are there.
    """
    return host_quality(docs).where("kept").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines, however short; n_chars is that of the remaining text.

    Null texts stay null, texts of nothing but repeated lines become empty; rows equal
    in id and text keep the same lines.
    """
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near copies: the one with the smallest id.

    The operator's own parameters: shingles of three words, at most two differing bits.
    Documents that have lost all their words in the stage before have one fingerprint
    and stay only as one.  Rows without an id cannot be told apart and stay; rows of one
    id stay together.  No documents give none.
    """
    groups = checkpointed(simhash_groups(docs.where("doc_id is not null")).select(F.col("doc_id").alias("id"), "component_id"))
    first = groups.where("id = component_id").select("id").distinct()
    kept = docs.where("doc_id is not null").join(first, F.col("doc_id") == F.col("id"), "left_semi")
    return kept.unionByName(docs.where("doc_id is null")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; one row per piece of a document.

    Null and empty texts are their end token alone; long texts are cut into pieces, of
    which none is lost; repeated rows are packed each by itself.
    """
    return pieces_of(window_pack(docs, TOKENIZER), "ids")


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_poor), ("line dedup", drop_repeated_lines),
          ("SimHash near-dedup", drop_near_copies), ("packing", packed)]

# Neither the tokenizer nor the toxicity model can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what all stages keep of the documents; an empty table gives no rows.

    Stages are written to the shared scratch folder, and each goes when the next one
    stands; what operators have left there goes with it.
    """
    docs = table(spark, sf_dir, "documents")
    before, mark = None, scratch_mark(spark)
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        clear_scratch(spark, mark, [before] if before else [])
        before = path
    return docs
