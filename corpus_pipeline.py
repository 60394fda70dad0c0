"""A corpus pipeline over `documents`: five stages, each applying one operator to all that its predecessor kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of docs.  Between stages the rows are written as Parquet to the
shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, language, line_dedup, ngram_join, unigram
from gridloom.llm.queries import TOKENIZERS
from gridloom.llm.store import kept

#: A document of which no language holds this share of the pooled probability is rejected.
LEAST_SCORE = 0.4
#: Ids to remove up to which they are broadcast; more are removed by a merge join.
FEW_IDS = 200_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: not null, with a letter, and at the least score."""
    net = language.learn(docs)
    told = language.label(docs, net, lang_col="_lang_pred", score_col="_score")
    return told.where((F.col("_lang_pred") != language.UNDETERMINED) & (F.col("_score") >= LEAST_SCORE)).select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that stay; those of which no line stays go."""
    out = line_dedup.dedup_lines(docs)
    return out.where(F.length(F.trim("text")) > 0).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id; of rows that share an id, one."""
    groups = kept(ngram_join.ngram_jaccard_join(docs), "components")
    lost = groups.where("doc_id <> component_id").select("doc_id").distinct()
    lost = F.broadcast(lost) if lost.count() <= FEW_IDS else lost.hint("merge")
    out = docs.join(lost, "doc_id", "left_anti").select(*docs.columns)
    if groups.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return out
    return out.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).union(out.where("doc_id IS NULL"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Documents with their piece ids, and as text what those decode to."""
    model = f"{tokenizers}/piece_bpe_32k.model"
    return unigram.encode_and_decode(docs, model, decoded_col="text").select(*docs.columns, F.coalesce(F.size("ids"), F.lit(0)).alias("n_pieces"), "ids")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: No SQL expresses the trained network of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = kept(docs, f"pipeline-{place + 1}")
    return docs
