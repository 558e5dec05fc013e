"""From raw documents to token files: toxicity, near duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with their columns; the last gives
a row for each document of the token files.  Between stages the rows are written and read again.

Rows that share a document id are judged together; a null id or text never removes a row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import common, decontaminate, jaccard, mixing, token_files, toxicity

#: Near duplicates: words of a shingle, and per cent of similarity.
WORDS, PERCENT = 5, 80


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without those in ``ids``: by broadcast if these are few enough, else by a shuffle."""
    ids = common.materialize(ids.where("doc_id IS NOT NULL").distinct(), "removed")
    few = ids.count() <= jaccard.BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(docs.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold."""
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = f"_score_{uuid.uuid4().hex}"
    return model.score(docs, to=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    found = jaccard.components(docs.select("doc_id", "text"), WORDS, PERCENT)
    return _without(docs, found.where("component_id <> doc_id").select("doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontaminate.find(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where(F.size("items") > 0).select("doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have the tempered marginals of source, language and topic."""
    return mixing.sample(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and a row per document read from them."""
    uri = common.scratch_dir(spark, "tokens")
    token_files.write(docs.select("doc_id", "text"), uri)
    return token_files.read(spark, uri)


STAGES = [
    ("toxicity", reject_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token files", write_tokens),
]

#: A fitted classifier and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, from ``documents`` on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
