"""A corpus pipeline over ``documents``: each stage works on all rows its predecessor kept.

Stages: quality classifier, quality rules, near-duplicate removal, benchmark decontamination,
tokenization.  A stage takes (spark, docs, sf_dir); all but the last return the columns of
documents.  ``run`` writes each stage's rows to the shared folder and reads them back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from objectlens.llm import bpe, cnn, minhash, rules, suffixes
from objectlens.llm.common import forget, frozen
from objectlens.llm.queries import TOKENIZER, table

#: Learned scores, verdicts and labels hang on fitted models, which SQL can't express.
ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores below its cutoff go.

    Learns from the labelled documents of its input; without labels of both kinds nothing is
    learned and all documents stay.  Null and empty texts are scored like others; every row is
    judged by its own text, whatever its id.
    """
    net = cnn.train(docs, table(spark, sf_dir, "labels"))
    if net.constant is not None:
        return docs.select(*COLUMNS)
    return cnn.quality_scores(docs, net, keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified threshold go.

    Null and empty texts fail the base rules; rows that share a doc_id, or have none, are judged
    each by its own text.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text_key"))
    verdicts = rules.quality_rules(keyed.select("doc_id", "text", "_text_key"), table(spark, sf_dir, "labels"), keep=["doc_id", "_text_key"])
    gone = verdicts.where("NOT kept").select("doc_id", "_text_key").distinct()
    match = keyed["doc_id"].eqNullSafe(gone["doc_id"]) & (keyed["_text_key"] == gone["_text_key"])
    return keyed.join(gone, match, "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id.

    Rows that share a doc_id are one document: the least of them by text, lang, source and n_chars
    (nulls first) stays.  Rows without a doc_id can't be told apart from others and stay, as do
    null and empty texts, which are linked with nothing.
    """
    found = minhash.near_duplicates(docs, k=5, percent=80)
    gone = found.where("NOT kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    once = left.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return once.unionByName(left.where("doc_id IS NULL"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold any benchmark window verbatim go.

    Null and empty texts hold none; each row is judged by its own text; an empty benchmark leaves all.
    """
    judged = suffixes.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return judged.where("NOT contaminated").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text of every whole text.

    A null text counts as empty and has no tokens; each row, repeated or without an id, gives one.
    """
    return bpe.bpe_encode(docs, public_tokenizers.path(TOKENIZER), keep=["doc_id"], digest=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = frozen(stage(spark, docs, sf_dir), name)
        if last is not None:
            forget(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
