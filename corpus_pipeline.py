"""Corpus pipeline: toxicity, near duplicates, benchmark leaks, source mix, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows it is given.
All but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquill.llm import decontamination, mixing, near_dedup, token_output, toxicity
from netquill.llm.common import stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids to remove that may be broadcast; beyond it they are joined by shuffle.
BROADCAST_IDS = 500_000


def other_columns_aside(stage):
    """Under names no operator uses while ``stage`` runs, so that none is replaced by a column an operator adds."""

    @functools.wraps(stage)
    def run_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {c: f"other {i}" for i, c in enumerate(docs.columns) if c not in COLUMNS}
        out = stage(spark, docs.withColumnsRenamed(aside), sf_dir)
        return out.withColumnsRenamed({v: k for k, v in aside.items()})

    return run_stage


@other_columns_aside
def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. The model is fitted on the documents at hand that have labels."""
    model = toxicity.fit_from_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs, model).where(F.col("score") < 0.5).select(docs.columns)


@other_columns_aside
def one_of_each_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five words, 0.8) the one with the smallest id stays; of rows equal in id and text one.

    Rows are told apart by id and text, so another text of a removed row's id
    stays.  A row without id goes if its group has one with an id, or the same
    text without id; a group of different texts that all lack ids stays.
    """
    found = near_dedup.near_groups(docs, with_print=True)
    gone = stash(found.where("not kept").select(F.col("id").alias("gone id"), F.col("print").alias("gone text")).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    same = docs["doc_id"].eqNullSafe(F.col("gone id")) & (near_dedup.text_print(docs["text"]) == F.col("gone text"))
    kept = docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
    again = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates(["doc_id", "text"]) if again else kept).select(docs.columns)


@other_columns_aside
def drop_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    marked = decontamination.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where(F.size("bench_items") == 0).select(docs.columns)


@other_columns_aside
def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy that the mix takes, in training order."""
    return mixing.training_order(mixing.mix(docs)).select(docs.columns)


def token_ids(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token store of the mix, read back: per copy its place, length and checksum."""
    root = token_output.write_tokens(docs, token_output.default_tokenizer())
    return token_output.summary(spark, root)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", one_of_each_group),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_output", token_ids),
]

#: Toxicity and decontamination cannot be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = len(STAGES) - 1
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < last:
            docs = stash(docs, name)
    return docs
